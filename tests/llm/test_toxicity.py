import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from docloom.llm.labelled import labelled_sample
from docloom.llm.toxicity import BlockMaxIndex, fit_toxicity, score_toxicity, toxicity

from .helpers import doc_frame

BAD = ["vile", "rotten", "grubby", "wretchedly", "wretchedness"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(2 + len(text) // 40):
                text.insert(rng.randrange(len(text)), rng.choice(BAD).upper())
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame([(i, 1, t, "x") for i, t in labels], "doc_id long, quality int, toxic int, text string")


def flat(vectors):
    """Terms, rows and weights of sparse vectors."""
    each = [(t, row, w) for row, v in enumerate(vectors) for t, w in v.items()]
    return [np.array([x[i] for x in each]) for i in range(3)]


def query(vector):
    terms = sorted(vector)
    return np.array(terms, np.int64), np.array([vector[t] for t in terms], np.float64)


def test_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        terms = rng.choice(30, rng.integers(0, 5), replace=False)
        raw = rng.random(len(terms)) + 0.01
        vectors.append({int(t): float(w) for t, w in zip(terms, raw / np.sqrt((raw**2).sum() or 1), strict=True)})
    index = BlockMaxIndex(*flat(vectors), 30, rng.permutation(len(vectors)))
    for q in (v for v in vectors[:60] if v):
        full = [(round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors) if i != 3]
        want = sorted(((s, i) for s, i in full if s > 0), key=lambda x: (-x[0], x[1]))[:15]
        assert [(round(s, 9), i) for s, i in index.nearest(*query(q), 15, 3)] == [(round(s, 9), i) for s, i in want]


def test_neighbours_are_those_of_brute_force(spark):
    """Over the whole vocabulary: weights, norms and neighbours recomputed word by word."""
    rows, labels = corpus(240, 5)
    model = fit_toxicity(doc_frame(spark, rows), label_frame(spark, labels))
    used = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert model.ids == used
    truth, texts = dict(labels), dict(rows)
    words = {i: Counter(t.lower() for t in re.findall("[A-Za-z]+", texts[i])) for i, _ in rows}
    known = {w for i in used for w in words[i]}
    assert set(model.terms) == known
    df = {w: sum(w in words[i] for i, _ in rows) for w in known}
    weight = {}
    for w in known:
        a, c = (sum(w in words[i] and truth[i] == x for i in used) for x in (1, 0))
        weight[w] = (math.log((1 + len(rows)) / (1 + df[w])) + 1) * math.log2(2 + a / max(1, c)) ** 2
    vector = lambda i: {w: (1 + math.log(n)) * weight[w] for w, n in words[i].items() if w in known}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i in [r[0] for r in rows[:30]]:
        q = vector(i)
        full = [(sum(x * v.get(w, 0) for w, x in q.items()) / norm(q) / norm(v), j) for j, v in ((j, vector(j)) for j in used)]
        want = sorted(((round(s, 9), j) for s, j in full if s > 0), key=lambda x: (-x[0], x[1]))[:15]
        got = [(round(s, 9), model.ids[r]) for s, r in model.index.nearest(*model.vector(texts[i]), 15)]
        assert got == want


def test_ids_are_no_input(spark):
    rows, labels = corpus(300, 9)
    model = fit_toxicity(doc_frame(spark, rows), label_frame(spark, labels))
    shifted = [(7 * i + 13, text) for i, text in rows]
    one = {r.doc_id: r.score for r in score_toxicity(doc_frame(spark, rows), model).collect()}
    two = {r.doc_id: r.score for r in score_toxicity(doc_frame(spark, shifted), model).collect()}
    assert {7 * i + 13: s for i, s in one.items()} == two


def test_sample_is_bounded_and_stable(spark):
    rows, labels = corpus(200, 3)
    repeated = [(8, "zz of id eight"), (8, "aa of id eight")]
    docs = doc_frame(spark, [r for r in rows if r[0] != 8] + repeated)
    marks = spark.createDataFrame([(i, t) for i, t in labels], "doc_id long, toxic int")
    sample = labelled_sample(docs, marks, "toxic", 5, 0, 50, most_chars=3000)
    got = sample.collect()
    assert 0 < len(got) <= 50 and sum(len(r.text) for r in got) <= 3000
    whole = {r.id: r.text for r in labelled_sample(docs, marks, "toxic", 5, 0, 1000).collect()}
    assert whole[8] == "aa of id eight" and len(whole) == len(set(whole))


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(900)
    return rows, labels, toxicity(doc_frame(spark, rows), label_frame(spark, labels)).collect()


def test_held_out_accuracy(fitted):
    rows, labels, got = fitted
    truth = dict(labels)
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    voters = {e.id for r in got for e in r.evidence}
    assert voters and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in voters)


def test_labels_of_held_out_rows_change_nothing(spark, fitted):
    rows, labels, got = fitted
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    again = toxicity(doc_frame(spark, rows), label_frame(spark, flipped)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_awkward_rows(spark):
    rows, labels = corpus(300)
    extra = [(None, "vile rotten " * 5), (1001, None), (1002, ""), (1003, "\n"), (5, "vile rotten"), (1004, "vile rotten words " * 20000)]
    marks = labels + [(None, 1), (5, 1), (7, None), (99999, 1)]
    got = toxicity(doc_frame(spark, rows + extra), label_frame(spark, marks)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert by[1001].predicted == by[1002].predicted == by[1003].predicted == 0
    assert by[None].predicted == 1 and by[None].held_out is False
    assert toxicity(doc_frame(spark, []), label_frame(spark, [])).count() == 0
    docs = doc_frame(spark, rows)
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, label_frame(spark, []))).collect()} == {0.0}
