import random
from collections import defaultdict

from docloom.llm.mixing import mix_sources

from .helpers import AWKWARD, doc_frame


def brute_targets(sizes):
    """Targets by repeated resharing: sources in order -> {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        share = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"])
        rows.append((i, " ".join(["word"] * rng.randint(0, 60)) + " %%%" * rng.choice([0, 0, 5]), source))
    return rows + [(n + 1, "tiny", "z")]


def test_targets_and_amounts(spark):
    rows = corpus(3000)
    got = mix_sources(doc_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = brute_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.epochs:
            assert r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6


def test_selection_follows_keys(spark):
    """Within a source the documents of the last, partial epoch are those of the lowest keys."""
    import hashlib
    import math

    got = mix_sources(doc_frame(spark, corpus(3000))).collect()
    by = defaultdict(list)
    for r in got:
        u = (int(hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if r.size:
            by[r.source].append((-math.log(u) / r.quality, r.taken > r.epochs * r.size))
    for rows in by.values():
        picks = [p for _, p in sorted(rows)]
        assert picks == sorted(picks, reverse=True)


def test_awkward_rows_and_reruns(spark):
    docs = doc_frame(spark, AWKWARD)
    one, two = (sorted(map(str, mix_sources(docs).collect())) for _ in range(2))
    assert one == two and len(one) == len(AWKWARD)
    assert mix_sources(doc_frame(spark, [])).count() == 0
    zero = mix_sources(doc_frame(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in zero] == [(0, 0.0, 0)] * 2


def test_repeated_and_null_ids_hold_half_of_the_rows(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 40), "s%d" % (i % 4)) for i in range(600)]
    rows += [(7, "the same row again and again", "s1")] * 12_345 + [(8, "w " * (i % 30), "s2") for i in range(300)]
    rows += [(None, "text %d" % i, "s3") for i in range(300)] + [(None, None, None)] * 50
    one = mix_sources(doc_frame(spark, rows)).collect()
    two = mix_sources(doc_frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    for r in one:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 20
    # the partial epoch of the repeated row is cut in its middle
    assert len({r.taken for r in one if r.doc_id == 7 and r.size == 6}) <= 2
