import random
from collections import Counter, defaultdict

import pytest
from docloom.operators.mining import heavy_hitters, mine_patterns
from docloom.operators.patterns import normalize
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, h long, n string"


def corpus(seed, docs=120):
    rng = random.Random(seed)
    common = [f"Sentence number {k} of the common ones here." for k in "abcdefgh"]
    rows = []
    for i in range(docs):
        own = [f"Only {rng.randrange(10**9)} here w{rng.randrange(10**9)} and w{rng.randrange(10**9)} now." for _ in range(6)]
        shared = [s for k, s in enumerate(common) if rng.random() < 1 / (k + 1)]
        dated = [f"Signed on {rng.randrange(1, 28)}.{rng.randrange(1, 12)}.2020 by the court."] * (i % 3)
        text = own + shared + dated
        rng.shuffle(text)
        rows.append((i, " ".join(text), 1, "x"))
    return rows


def brute(rows, min_docs, top):
    docs, first = defaultdict(set), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        for pos, s in enumerate(x + "." for x in text.rstrip(".").split(". ")):
            p = normalize(s)
            docs[p].add(i)
            first.setdefault(p, ((i, pos), s))
    found = sorted(((-len(d), first[p][0], p, first[p][1]) for p, d in docs.items() if len(d) >= min_docs))[:top]
    return [(p, s, -n) for n, _, p, s in found]


@pytest.mark.parametrize("counters,top", [(1 << 17, 5), (40, 4), (8, 9), (8, 3)])
def test_mining_equals_brute_force_whatever_the_summary_holds(spark, counters, top):
    rows = corpus(1)
    got = [(r.pattern, r.example, r.doc_count) for r in mine_patterns(spark.createDataFrame(rows, SCHEMA), 3, top, counters=counters).collect()]
    assert got == brute(rows, 3, top)


def test_no_value_is_counted_too_little_beyond_the_error(spark):
    rng = random.Random(2)
    values = [[rng.choice([1, 2, 3, rng.randrange(10**6)]) for _ in range(9)] for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "h array<long>").select(F.array_distinct("h").alias("h"))
    counted = {r.h: r.n for r in heavy_hitters(rows, "h", 50).groupBy("h").agg(F.sum("n").alias("n")).collect()}
    error = counted.pop(None)
    true = Counter(x for v in values for x in set(v))
    assert all(counted.get(x, 0) <= n <= counted.get(x, 0) + error for x, n in true.items())
    assert {1, 2, 3} <= set(counted) and len(counted) <= 50 * 8
