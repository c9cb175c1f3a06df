import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from docloom.llm.components import components
from docloom.llm.simhash import fingerprint, keys_of, links, near_duplicates

from .helpers import AWKWARD, doc_frame


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def slow_roots(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Three Words É", "four Words in here", "a b c d e f g A B C D " * 9])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_keys_reach_every_pair_within_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for errors in range(1, 5):
        flips = np.array(
            [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, errors, replace=False).astype(np.uint64)) for _ in base]
        )
        (rows, index), _ = keys_of(base)
        _, (others, probe) = keys_of(base ^ flips)
        stored = set(zip(rows.tolist(), index.tolist(), strict=True))
        met = {r for r, k in zip(others.tolist(), probe.tolist(), strict=True) if (r, k) in stored}
        assert len(met) == len(base)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0}
    for p in list(prints)[:150]:
        for errors in (1, 3, 4, 5):
            q = p
            for b in rng.sample(range(64), errors):
                q ^= 1 << b
            prints.add(q)
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert {(r.a, r.b) for r in links(frame).collect()} == want


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    pairs += [(7, 7), (-5, 60), (1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p}
    want = slow_roots(pairs, nodes)
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_documents(spark):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(3000)]
    rows = [(10 * r[0] if r[0] else None, *r[1:]) for r in AWKWARD]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([3, 80, 400]))]
        for copy in range(4):
            changed = list(text)
            if copy:
                changed[rng.randrange(len(text))] = "other"
            rows.append((1000 + 10 * i + copy, " ".join(changed)))
    got = near_duplicates(doc_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {r[1] or "": slow_fingerprint(r[1]) for r in rows}
    fps = sorted(set(prints.values()))
    roots = slow_roots([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4], fps)
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            root = roots[prints[text or ""]]
            least[root] = min(i, least.get(root, i))
    want = sorted((str(i), f"{prints[t or '']:016x}", str(least.get(roots[prints[t or ""]]))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert near_duplicates(doc_frame(spark, [])).count() == 0


def test_one_text_in_half_of_the_rows_and_a_hub(spark):
    rng = random.Random(31)
    base = ["w%d" % rng.randrange(900) for _ in range(400)]
    texts = [" ".join(base)] * 600
    for i in range(300):  # near copies around one text
        changed = list(base)
        changed[rng.randrange(400)] = "x%d" % i
        texts.append(" ".join(changed))
    texts += [" ".join("v%d" % rng.randrange(9000) for _ in range(30)) for _ in range(300)]
    docs = doc_frame(spark, list(enumerate(texts))).repartition(8)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    prints = [fingerprint(t) for t in texts]
    close = [(i, j) for i in range(599, 1200) for j in range(599, i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = slow_roots(close, range(599, 1200))
    least = {}
    for i in range(599, 1200):
        least[roots[i]] = min(least.get(roots[i], i), 0 if i == 599 else i)
    assert all(got[i] == 0 for i in range(600))
    assert all(got[i] == least[roots[i]] for i in range(600, 1200))
