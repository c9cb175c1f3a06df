import hashlib
import random
import re

import pytest
import xxhash
from docloom.llm import sketches
from docloom.llm.sketches import FRACTION, LEAST_KEPT, SHINGLE_WORDS, WHOLE_RANGE, containment, fingerprints, likeness, merged, shingle_hashes, sketch, with_next
from pyspark.sql import functions as F

from .helpers import AWKWARD, doc_frame

FOLD = str.maketrans(sketches.UPPER, sketches.LOWER)


def hashes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    out = []
    for i in range(max(1, len(words) - SHINGLE_WORDS + 1) if words else 0):
        h = 42
        for w in words[i : i + SHINGLE_WORDS]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.append(h & WHOLE_RANGE)
    return out


def brute_sketch(text):
    every = sorted(set(hashes(text)))
    below = [h for h in every if h <= FRACTION]
    if len(below) >= LEAST_KEPT:
        return FRACTION, below
    return (WHOLE_RANGE, every) if len(every) <= LEAST_KEPT else (every[LEAST_KEPT - 1], every[:LEAST_KEPT])


def brute_likeness(one, two):
    a, b = ({h for h in s[1] if h <= min(one[0], two[0])} for s in (one, two))
    if not a or not b:
        return float(not one[1] and not two[1])
    return len(a & b) / min(len(a), len(b))


def brute(rows):
    text = lambda r: r[1] or ""
    spark_hash = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(text(r))))
    out = []
    for k, r in enumerate(order):
        t, following = text(r), text(order[(k + 1) % len(order)])
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, other, new = brute_sketch(t), brute_sketch(edited), brute_sketch(following)
        written = lambda s: f"{s[0]:016x}:" + "".join(f"{h:016x}" for h in s[1])
        out.append((str(r[0]), len(t), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other), round(brute_likeness(own, other), 9), round(brute_likeness(own, new), 9)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def words(rng, n, vocabulary=4000):
    return " ".join(f"{rng.choice(['Wort', 'mot', 'Ünit', 'x'])}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(10 + 3 * i, words(rng, rng.choice([1, 3, 5, 40, 70, 200, 900]))) for i in range(150)]
    out += [(2000 + i, out[9][1]) for i in range(60)]  # copies
    out += [(3000, words(rng, 30_000)), (3001, out[5][1].upper()), (3002, "x" * 9999), (-5, "negative id"), (2**63 - 1, "largest 😀 id here"), (-(2**63), "least")]
    return out + AWKWARD


def test_equals_brute_force(spark, rows):
    assert found(fingerprints(doc_frame(spark, rows))) == brute(rows)


def test_many_ranges_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_ROWS", 9)
    got = [(str(r.doc_id), r.text, r.next) for r in with_next(doc_frame(spark, rows).select("doc_id", "text")).collect()]
    monkeypatch.setattr(sketches, "RANGE_ROWS", 10**6)
    want = [(str(r.doc_id), r.text, r.next) for r in with_next(doc_frame(spark, rows).select("doc_id", "text")).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows)


def test_few_rows_and_none(spark):
    assert fingerprints(doc_frame(spark, [])).count() == 0
    for few in ([(1, "alone in the world with nobody near")], [(1, "a b c"), (2, "")], [(7, None), (7, None), (7, None)]):
        assert found(fingerprints(doc_frame(spark, few))) == brute(few)


def test_merging_and_containment_of_unequal_documents(spark):
    rng = random.Random(6)
    parts = [words(rng, n, 10**6) for n in (1200, 20_000, 20)]
    long = parts[0] + " . " + parts[1]
    row = spark.createDataFrame([(parts[0], parts[1], long, parts[2])], "a string, b string, long string, c string").select(
        *[sketch(F.col(c)).alias(c) for c in ("a", "b", "long", "c")]
    )
    got = row.select(
        merged(F.col("a"), F.col("b")).alias("both"), F.col("long").alias("long"), containment(F.col("a"), F.col("long")).alias("ab"),
        containment(F.col("long"), F.col("a")).alias("ba"), likeness(F.col("long"), F.col("a")).alias("near"), containment(F.col("b"), F.col("a")).alias("none"),
    ).first()
    assert got.ab == 1.0 == got.near and abs(got.ba - 1200 / 21_200) < 0.03 and got.none == 0.0
    joints = set(hashes(long)) - set(hashes(parts[0])) - set(hashes(parts[1]))
    assert set(got.long.kept) - set(got.both.kept) <= joints and set(got.both.kept) <= set(got.long.kept)


def test_plan_shuffles_the_text_once_and_runs_no_python(spark, rows):
    plan = fingerprints(doc_frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1


def test_hashes_of_one_text(spark):
    text = "A b\tc\nd e f é É 😀"
    assert spark.createDataFrame([(text,)], "t string").select(shingle_hashes(F.col("t"))).first()[0] == hashes(text)
