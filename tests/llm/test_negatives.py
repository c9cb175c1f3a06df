import math

import numpy as np
import pytest
from docloom.llm import negatives
from docloom.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, win int, shard long"


def brute(rows, positives=5, n_negatives=10, every=100):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], c)
        for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, v, c) in enumerate(usable):
        if i % every:
            continue
        near = sorted((-dot(v, w), j) for k, (j, w, d) in enumerate(usable) if d == c and k != at)[:positives]
        for s, j in near:
            far = sorted((-dot(v, w), m) for m, w, d in usable if d != c and 30 * -s <= 100 * dot(v, w) <= 90 * -s)
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(far[:n_negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, 2) for i, v, c in rows], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(i, [float(x) for x in rng.normal(size=8) / 3 + 0.2], i % 3) for i in range(420)]
    out += [(1000 + i, out[7][1], 2) for i in range(150)]  # a third of the rows are one vector
    out += [(100, out[3][1], 1), (100, out[3][1], 1), (200, [0.5, 0.25], 0)]  # repeated ids, a short vector
    out += [(500, None, 1), (600, [0.1, None], 1), (700, [float("nan")] * 8, 1), (800, [float("inf")] * 8, 1), (None, out[0][1], 1), (900, out[0][1], None)]
    return out


def test_equals_brute_force(spark, rows):
    assert found(hard_negatives(frame(spark, rows))) == brute(rows)


def test_digits_of_three_bits(spark, rows):
    # many passes, ranges cut off by their window, final ranges of several scores
    assert found(hard_negatives(frame(spark, rows), 4, 3, digit_bits=3)) == brute(rows, 4, 3)


def test_one_label_one_row_and_none(spark):
    assert hard_negatives(frame(spark, [])).count() == 0
    assert hard_negatives(frame(spark, [(0, [1.0, 0.0], 1)])).count() == 0
    assert hard_negatives(frame(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1)])).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.0], 2), (4, [0.1, 0.0], 2), (5, [-1.0, 0.0], 1)]
    assert found(hard_negatives(frame(spark, few))) == brute(few) != []


def test_huge_components_are_clipped(spark):
    rows = [(0, [1e17, 1e17], 1), (1, [1e17, 0.0], 1), (2, [3e8, 1.0], 2), (3, [0.5, 0.5], 2), (4, [-3e30, 1.0], 2)]
    got = found(hard_negatives(frame(spark, rows)))
    assert got == []  # both positives and negatives stand at the limit or far below it
    near = rows[:2] + [(5, [40.0, 0.0], 2)] + [(i, [1e9, 1e9], 1) for i in (6, 100)]
    assert all(p <= negatives.MOST_SCORE for *_, p, n in found(hard_negatives(frame(spark, near))))
