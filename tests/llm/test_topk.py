import math

import numpy as np
from docloom.llm.topk import NONE, BallTree, CoarseTree, bounds_of, norms_of, top_k

SCHEMA = "vec_id long, embedding array<float>, shard int, floor string"


def brute(rows, k=5, every=50):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in usable:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != q)
        out += [(q, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(120)]  # copies: ties
    rows += [(5000, None), (5050, [0.1, None]), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8)]
    rows += [(None, rows[0][1]), (5200, []), (5250, [0.5, 0.25])]
    got = sorted(tuple(r) for r in top_k(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.25, 0.5]), (2, [0.25, 0.5])]
    assert sorted(tuple(r) for r in top_k(frame(spark, rows)).collect()) == brute(rows)
    assert top_k(frame(spark, [])).count() == 0


def test_tree_visits_part_of_the_leaves():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    points = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + 0.02 * rng.normal(size=(8000, 16))))
    tree = BallTree(points, np.arange(8000))
    queries = tree.points[[7, 4000, 7999]]
    scores, names = tree.search(queries, np.full(3, -1), 5, np.full(3, NONE))
    for q, got, ids in zip(queries, scores, names, strict=True):
        want = sorted((-int(s), int(i)) for s, i in zip(tree.points @ q, tree.ids, strict=True))[:5]
        assert [(-s, i) for s, i in zip(got.tolist(), ids.tolist(), strict=True)] == want
    assert tree.scored < 3 * 8000 / 2


def test_shards_are_even_and_hold_all():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-99, 99, (4000, 6)).astype(float), np.tile([5.0, 1, 1, 1, 1, 1], (2000, 1))])
    tree = CoarseTree(points[::3], 12)
    shard = tree.deal(points, np.arange(6000))
    sizes = np.bincount(shard, minlength=12)
    assert sizes.sum() == 6000 and sizes.max() < 1500
    assert (shard == tree.deal(points, np.arange(6000))).all()
    far = tree.away(points, shard)
    queries = points[:20]
    for s in range(12):
        inside = points[shard == s]
        bound = bounds_of(queries, norms_of(queries), tree.centres[[s]], np.array([far[shard == s].max()]))
        assert ((queries @ inside.T) <= bound).all()


def test_huge_components_are_clipped(spark):
    rows = [(0, [1e17, 1e17]), (1, [1e17, 0.0]), (2, [3e30, 1.0]), (3, [-3e30, 1.0]), (4, [0.5, 0.5]), (50, [0.5, 0.25])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(frame(spark, rows)).collect()}
    top = 2**63 - 1
    assert [got[0, r] for r in range(1, 6)] == [(1, top), (2, top), (4, top), (50, top), (3, -top + 1)]


def test_one_vector_holds_half_of_the_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) / 3]) for i in range(1200)]
    rows += [(2000 + i, rows[3][1]) for i in range(1200)]
    got = sorted(tuple(r) for r in top_k(frame(spark, rows)).collect())
    assert got == brute(rows)
