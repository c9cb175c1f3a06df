import random
import re
from collections import Counter

from docloom.llm.decontamination import candidate_pairs, find_leaks, print_of, shared_weight
from pyspark.sql import functions as F

from .helpers import AWKWARD, doc_frame


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute(rows, items, least=0.8):
    best = {}
    for i, text, *_ in rows:
        doc = grams(text)
        for item, item_text in items:
            want = grams(item_text)
            if not want or not doc:
                continue
            size, want_n = min(len(want), len(doc)), Counter(want)
            for s in range(len(doc) - size + 1):
                both = sum((Counter(doc[s : s + size]) & want_n).values())
                sim = both / (size + len(want) - both)
                if sim >= least:
                    best[(i, item)] = max(best.get((i, item), (0, 0)), (round(sim, 6), -s))
    return sorted((str(i), str(item), sim, -s) for (i, item), (sim, s) in best.items())


def test_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(200)] + ["é", "ß", "là"]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randint(6, 60)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "Only Four words here"), (23, "again and " * 12), (None, "an item without id of ten words or so ok")]
    items += [(0, " ".join(draw(20)))]
    rows = list(AWKWARD)
    for i in range(60):
        before, after = draw(rng.randint(0, 60)), draw(rng.randint(0, 60))
        passage = items[i % 12][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(passage))
            passage[at : at + rng.choice([0, 1])] = draw(rng.choice([0, 1]))
        cutoff = rng.choice([0, 0, 3, 8])
        text = " ".join(before + passage[cutoff:] + after)
        rows.append((100 + i, text.upper().replace(" ", "%% ") if i % 5 == 0 else text))
    rows += [(200, items[0][1]), (201, " ".join(items[1][1].split()[:-1])), (202, "only four WORDS here!"), (203, "again and " * 40)]
    rows += [(204, "an item without id of ten words or so ok"), (None, items[2][1]), (205, items[3][1] + " " + items[3][1]), (206, items[-1][1])]
    bench = spark.createDataFrame([(*r, 1.0, 2) for r in items], "item_id long, text string, h double, m int")
    got = find_leaks(doc_frame(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.similarity, r.start) for r in got) == brute(rows, items)
    assert len(got) > 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(doc_frame(spark, AWKWARD), none).count() == 0
    assert find_leaks(doc_frame(spark, []), none).count() == 0


def test_blocks_reach_the_radius(spark):
    rng = random.Random(9)
    signed = lambda v: v - 2**64 if v >> 63 else v
    items = [(i, 7, signed(rng.getrandbits(64))) for i in range(30)]
    windows = []
    for i, _, fp in items:
        for errors in (0, 9, 23, 24):
            v = fp & (2**64 - 1)
            for b in rng.sample(range(64), errors):
                v ^= 1 << b
            windows.append((len(windows), 7, signed(v)))
    got = candidate_pairs(
        spark.createDataFrame(windows, "row long, m int, fp long"),
        spark.createDataFrame([(i, *r, [i]) for i, r in enumerate(items)], "key long, item long, m int, fp long, shingles array<long>"),
    ).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 23
    want = sorted((w, i) for w, _, a in windows for i, _, b in items if near(a, b))
    assert sorted((r.row, r.item) for r in got) == want


def test_prints_and_weights(spark):
    rng = random.Random(10)
    rows = [([rng.randint(-(2**63), 2**63 - 1) for _ in range(rng.choice([1, 2, 7, 40]))],) for _ in range(20)]
    got = [r.fp for r in spark.createDataFrame(rows, "h array<long>").select(print_of(F.col("h")).alias("fp")).collect()]
    ones = lambda hs, b: sum(h >> b & 1 for h in hs)
    assert [fp & (2**64 - 1) for fp in got] == [sum(1 << b for b in range(64) if 2 * ones(hs, b) > len(hs)) for (hs,) in rows]
    pairs = [([1, 2, 3], [2, 3, 4]), ([1, 1, 1, 2], [1, 1, 2, 2]), ([5], [6])]
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>").select(shared_weight(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in frame.collect()] == [2, 3, 0]


def test_a_text_full_of_passages(spark):
    rng = random.Random(21)
    draw = lambda n: " ".join("v%d" % rng.randrange(900) for _ in range(n))
    items = [(i, draw(rng.randrange(20, 70))) for i in range(25)]
    text = " ".join(items[rng.randrange(25)][1] + " " + draw(rng.randrange(30)) for _ in range(40))
    rows = [(1, text), (2, draw(1500)), (3, items[4][1])] + [(4, text)] * 30
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(doc_frame(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.similarity, r.start) for r in got) == brute(rows[:4], items)
    assert len({r.item_id for r in got if r.doc_id == 1}) > 15
