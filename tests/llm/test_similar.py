import random

import corpus_pipeline
from docloom.llm import similar
from docloom.llm.similar import shingle_set, similar_groups

from .test_simhash import slow_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_groups(texts):
    sets = [set(shingle_set(t).tolist()) for t in texts]
    linked = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    ]
    return slow_roots(linked, range(len(texts))), linked


def partition(pairs):
    found = {}
    for row, group in pairs:
        found.setdefault(group, set()).add(row)
    return sorted(map(sorted, found.values()))


def near_copies(rng):
    words = ["w%d" % i for i in range(500)]
    line = "this very common line is in a third of all texts"
    texts = [None, "", " \n", "one", "One", "a b c d e", "a b c d e f"]
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([3, 7, 30, 200]))]
        for copy in range(6):
            changed = list(text)
            for _ in range(copy * len(text) // 130):
                changed[rng.randrange(len(text))] = "other"
            texts.append(" ".join(changed) + (line if i % 3 == 0 else ""))
    return texts


def test_groups_equal_brute_force(spark, monkeypatch):
    texts = near_copies(random.Random(8))
    want, linked = slow_groups(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    for sample in (1, 16):
        monkeypatch.setattr(similar, "SAMPLE", sample)
        got = similar_groups(frame, "row").collect()
        assert len(got) == len(texts)
        assert partition((r.row, r.group) for r in got) == partition(want.items())
    assert 60 < len(set(want.values())) < len(texts) - 100 and linked
    assert similar_groups(frame.limit(0), "row").count() == 0


def test_stage_drops_pairs_of_similarity_08(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(4000)]
    rows, near = [], set()
    for i in range(30):
        text = [rng.choice(words) for _ in range(300)]
        changed = list(text)
        for at in range(20, 280, 52):
            changed[at] = "other"  # 5 words, 25 of 296 shingles: similarity 271/321 = 0.84
        rows += [(i, " ".join(text), "en", "s", 1), (100 + i, " ".join(changed), "en", "s", 1)]
        near.add(100 + i)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id for r in kept} == set(range(30))


def test_null_and_repeated_ids_are_judged_by_text(spark, tmp_path):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(4000)]
    a, b, item = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    texts = [(None, a), (1, a), (7, a), (7, b), (None, b + " " + item), (9, "x y z " + item), (9, "kept")]
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted((str(i), t) for i, t in [(1, a), *texts[3:]])
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (7, b), (9, "kept")]


def test_shared_keys_are_found_without_a_broadcast(spark, monkeypatch):
    from docloom.llm import similar

    asked = []
    monkeypatch.setattr(similar, "small", lambda df, most: asked.append(df.columns) or df)
    rows = [(i, f"one two three four five six seven eight nine ten eleven w{i}") for i in range(3)]
    groups = similar.similar_groups(spark.createDataFrame(rows, "row long, text string"), "row").collect()
    assert len(groups) == 3
    assert len(asked) == 1  # the open keys at the end; the keys of all prefixes went the same way before
