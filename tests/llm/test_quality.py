import random
import zlib

import numpy as np
from docloom.llm import quality as q
from docloom.llm.quality import QualityModel, bag, blocks_of, feature_buckets, quality

from .helpers import doc_frame


def slow_buckets(text):
    """The features of a text, one by one."""
    mask = 2**32 - 1
    blank = " \t\n\v\f\r"
    data = "".join(" " if c in blank else c for c in f" {text} ")
    out = []
    for n in (3, 4):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if " " in gram[1:-1] or (gram[0] == " " and gram[-1] == " "):
                continue
            h = 0
            for c in gram:
                h = (h * q.STEP + ord(c)) & mask
            h = h * int(q.MIX[n]) & mask
            out.append(((h ^ h >> 15) * q.STEP & mask) >> (32 - q.BUCKET_BITS))
    last = None
    for word in data.split(" "):
        if not word:
            continue
        h = sum(ord(c) * int(q.POWERS[i % len(q.POWERS)]) for i, c in enumerate(word)) & mask
        h = (h * int(q.MIX[0]) + len(word)) & mask
        out.append(((h ^ h >> 16) * int(q.MIX[0]) & mask) >> (32 - q.BUCKET_BITS))
        if h == last:
            out.append(int(q.REPEATED))
        last = h
    return sorted(out)


def test_features_equal_plain_loop():
    for text in ["", " ", "a", "the the cat", "Ünï cødé\tx\n\nfoo|bar !! 😀😀", "ab " * 20 + "longerword" * 700]:
        assert sorted(feature_buckets(text)[0].tolist()) == slow_buckets(text)


def test_blocks_lose_nothing(monkeypatch):
    text = " ".join("w%d" % (i // 2 % 97) for i in range(5000)) + " é" + "z" * 900
    parts = list(blocks_of(text, 1000))
    assert "".join(parts) == text and len(parts) > 20
    whole = np.bincount(slow_buckets(text), minlength=1 << q.BUCKET_BITS)
    monkeypatch.setattr(q.blocks_of, "__defaults__", (1000,))
    rows, counts = bag(text)
    assert (whole[rows] == counts).all() and counts.sum() == whole.sum()
    # without white space a run is cut, so that no block grows
    assert max(map(len, blocks_of("y" * 5000))) == 1000


def test_collapsed_model_equals_its_layers():
    bags = [bag(t) for t in ["good plain words here", "!!! ### $$$", "more plain words", "$$$ !!!"]]
    model = QualityModel.train(bags, np.array([1, 0, 1, 0]))
    assert model.score("plain words") > 0.5 > model.score("### !!!") and model.score(None) == model.score("")
    weights = model.weights[feature_buckets("plain words")[0]].astype(np.float64)
    assert abs(model.score("plain words") - 1 / (1 + np.exp(-model.bias - weights.mean()))) < 1e-9


def label_frame(spark, labels):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in labels], "doc_id long, quality int, toxic int, text string")


def corpus(n):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([8, 60, 300]))]
        good = int(rng.random() < 0.7)
        if not good:
            kind = rng.randrange(3)
            words = [w + "$$$" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:1] * len(words)
        rows.append((i, " ".join(words)))
        labels.append((i, good))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    truth = dict(labels)
    extra = [(None, "abc def"), (2001, None), (2002, ""), (2003, " \n"), (5, "same id"), (2004, "abc def gh " * 300_000)]
    got = quality(doc_frame(spark, rows + extra), label_frame(spark, [*labels, (None, 1), (3, None), (99999, 0)])).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[2001].score == by[2002].score == by[2003].score and by[None].held_out is False
    flipped = [(i, 1 - v if zlib.crc32(str(i).encode()) % 3 == 1 else v) for i, v in labels]
    again = quality(doc_frame(spark, rows), label_frame(spark, flipped)).collect()
    assert {r.doc_id: r.score for r in again} == {i: by[i].score for i in truth if i != 5} | {5: next(r.score for r in again if r.doc_id == 5)}


def test_empty(spark):
    assert quality(doc_frame(spark, []), label_frame(spark, [])).count() == 0
    assert [r.score for r in quality(doc_frame(spark, [(1, "a b c")]), label_frame(spark, [])).collect()] == [0.5]
