import math
from fractions import Fraction

import numpy as np
from docloom.llm import whitening
from docloom.llm.whitening import Fit, enough_primes, primes_below, quantised, reconstruct, residue_scatter, whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n string, w0 double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], SCHEMA)


def whole(rows):
    width = max(len(v) for _, v in rows)
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (width - len(v))) for i, v in rows]


def check(spark, rows, usable, components=8):
    got = whiten(frame(spark, rows), components).collect()
    x = whole(usable)
    n, d = len(x), len(x[0][1])
    sums = [sum(v[k] for _, v in x) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for _, v in x), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    assert len(got) == n * len(values)
    by: dict = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-6 * abs(r.explained) + 1e-12
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for i, v in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert (i, deviation) in by
        for k, e in enumerate(values):
            if e > 1e-9 * values[0]:
                want = float(sum((a - s / n) * q for a, s, q in zip(v, sums, vectors[:, k], strict=True))) / math.sqrt(e)
                assert any(abs(abs(w) - abs(want)) < 1e-5 for w in by[i, deviation][k + 1])
    return got


def test_equals_exact_fractions(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(10, 10))
    rows = [(i, [float(c) for c in rng.normal(size=10) @ mix / 9]) for i in range(300)]
    rows += [(7, rows[3][1])] * 60 + [(None, rows[5][1]), (400, rows[6][1][:4]), (401, [])]
    bad = [(500, None), (501, [0.1, None]), (502, [float("nan")] * 10), (503, [float("inf")] * 10)]
    got = check(spark, rows + bad, rows)
    signs = {}
    for r in got:  # one sign for all rows: copies agree
        signs.setdefault((r.deviation, r.component), set()).add(round(r.whitened, 9))
    assert all(len(s) == 1 for s in signs.values())


def test_few_entries_flat_components_and_none(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [float(c), 1.0, float(2 * c)]) for i, c in enumerate(rng.integers(-8, 8, 50) / 8)]
    got = check(spark, flat, flat)
    assert {r.component for r in got} == {1, 2, 3} and {r.whitened for r in got if r.component == 3} == {0.0}
    same = whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(0.0, 0.0, 0, 0.0)}
    assert len(whiten(frame(spark, [(1, [0.25])])).collect()) == 1
    assert whiten(frame(spark, [])).count() == 0 == whiten(frame(spark, [(1, None), (2, [])])).count()


def test_residues_and_reconstruction_are_exact():
    rng = np.random.default_rng(3)
    rows = rng.integers(-(2**50), 2**50, (9000, 3))
    primes = enough_primes(9000 * 2**100)
    assert primes == list(__import__("itertools").islice(primes_below(20), len(primes))) and all(p < 2**20 for p in primes)
    held = residue_scatter(rows[:5000], primes)
    got = reconstruct(residue_scatter(rows[5000:], primes, held), primes)
    big = rows.astype(object)
    assert (got == big.T @ big).all()


def test_deviations_beyond_long_are_clipped():
    rows = quantised(np.array([[1e30, 0.0], [-1e30, 0.5], [1e9, 0.0], [0.25, 0.0]]))
    assert rows.max() == 2**whitening.ENTRY_BITS
    one = np.concatenate([rows, np.ones((4, 1), np.int64)], axis=1).astype(object)
    fit = Fit(one.T @ one, 2)
    deviation, _ = fit.apply(rows)
    want = [min(2**63 - 1, sum((4 * int(a) - s) ** 2 for a, s in zip(r, fit.sums, strict=True))) for r in rows]
    assert deviation.tolist() == want
    small = np.array([[100_000 + 2**29, 100_000], [100_000, 100_000], [100_001, 99_999]], np.int64)
    one = np.concatenate([small, np.ones((3, 1), np.int64)], axis=1).astype(object)
    fit = Fit(one.T @ one, 2)
    assert fit.apply(small)[0].tolist() == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, fit.sums, strict=True)) for r in small]
