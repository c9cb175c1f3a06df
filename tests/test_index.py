import numpy as np
import pytest
from docloom.functions.lineage import fresh_path
from docloom.functions.shards import SHARD_ROWS, grid, meet
from docloom.operators import index as index_module
from docloom.operators import search
from docloom.operators.index import UnevenVectors, VectorIndex
from docloom.operators.semantic import redundancy

SCHEMA = "chunk_id long, embedding array<double>, shard string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)


def clustered(seed, n, groups=20, width=6):
    rng = np.random.default_rng(seed)
    centres = 10 * rng.normal(size=(groups, width))
    return [(i, centres[i % groups] + 0.05 * rng.normal(size=width)) for i in range(n)]


def brute(queries, rows, k, others=False):
    out = []
    for q, v in queries:
        scored = sorted((round(float(((np.array(v) - np.array(w)) ** 2).sum()), 12), i) for i, w in rows if w is not None and not (others and i == q))
        out += [(q, r, i, round(d, 8)) for r, (d, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.distance, 8)) for r in df.collect())


def test_queries_as_a_table_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5)) for i in range(900)] + [(2000 + i, np.ones(5)) for i in range(300)] + [(5000, None), (5001, [1.0])]
    queries = [(i, rows[i % 900][1]) for i in range(600)] + [(700, np.ones(5)), (701, [0.5])]
    asked = frame(spark, queries).withColumnRenamed("chunk_id", "query_id")
    full = [(i, w) for i, w in rows if w is not None and len(w) == 5]
    want = sorted(brute(queries[:-1], full, 4) + [(701, 1, 5001, 0.25)])
    plan = search.knn(asked, frame(spark, rows), 4, most=100, shards=3)
    assert found(plan) == want  # two blocks of queries, three shards
    assert found(search.knn(asked, frame(spark, rows), 4)) == want  # few queries: the corpus stays in place
    assert "BroadcastNestedLoopJoin" not in plan._jdf.queryExecution().toString()


def test_queries_and_rows_go_to_the_root_of_the_tasks_each():
    for n, tasks in ((10, 1), (1000, 4), (1000, 200), (615_000, 600), (10_000_000, 600)):
        shards, blocks = grid(n, tasks)
        assert shards * blocks >= tasks and n <= shards * SHARD_ROWS
        assert shards + blocks <= max(2 * tasks**0.5 + 2, -(-n // SHARD_ROWS) + blocks) and blocks <= tasks**0.5 + 1


def test_knn_sends_each_query_to_few_tasks(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(search, "meet", lambda pool, asked, *a: dealt.append((pool.count(), asked.count())) or meet(pool, asked, *a))
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4)) for i in range(700)]
    asked = frame(spark, rows).withColumnRenamed("chunk_id", "query_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        assert found(search.knn(asked, frame(spark, rows), 3, most=0)) == brute(rows, rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert dealt == [(5 * 700, 5 * 700)]  # 25 tasks: every query went to each of them before


def test_search_sends_a_query_to_a_shard_once(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(index_module, "meet", lambda pool, asked, *a: dealt.append(asked.count()) or meet(pool, asked, *a))
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12)) for i in range(600)]  # no clusters: nearly all of the 25 cells are within reach
    path = fresh_path(spark, "index")
    VectorIndex.build(frame(spark, rows), path, cells=25)
    asked = frame(spark, rows).withColumnRenamed("chunk_id", "query_id")
    assert found(VectorIndex(spark, path).search(asked, 2, others=True)) == brute(rows, rows, 2, others=True)
    assert dealt[0] <= 2 * 600 and dealt[1] <= 4 * 600  # four tasks: two or three shards


def test_index_is_reopened_pruned_and_exact(spark):
    rows = clustered(1, 1200) + [(9000 + i, np.full(6, 3.0)) for i in range(200)] + [(9999, None)]
    path = fresh_path(spark, "index")
    VectorIndex.build(frame(spark, rows), path, cells=24)
    index = VectorIndex(spark, path)
    queries = [(i, rows[i][1]) for i in range(0, 40, 20)] + [(7, np.full(6, 3.0))]
    asked = frame(spark, queries).withColumnRenamed("chunk_id", "query_id")
    assert found(index.search(asked, 5)) == brute(queries, rows, 5)
    assert 1 <= len(index.cells_read) <= 6 < len(index.centroids)
    # only the folders of these cells are scanned
    plan = index.vectors(cells=[1])._jdf.queryExecution().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # more neighbours than a cell holds
    assert found(index.search(asked, 150)) == brute(queries, rows, 150)


def test_batches_are_added_replaced_and_taken_back(spark):
    rows, path = clustered(2, 300, 6), fresh_path(spark, "index")
    index = VectorIndex.build(frame(spark, rows), path, cells=6)
    more = [(1000 + i, np.full(6, 50.0) + i) for i in range(5)]
    index.append(frame(spark, more), 1)
    index.append(frame(spark, more), 1)
    gone = frame(spark, [(1000, None), (3, None)])
    index.append(frame(spark, [(2000, np.full(6, 49.0))]), 2, gone=gone)
    live = [(i, v) for i, v in rows + more + [(2000, np.full(6, 49.0))] if i not in (1000, 3)]
    queries = [(1, np.full(6, 49.5)), (3, rows[3][1])]
    asked = frame(spark, queries).withColumnRenamed("chunk_id", "query_id")
    assert found(VectorIndex(spark, path).search(asked, 3)) == brute(queries, live, 3)
    # a batch whose last part was not written does not exist
    frame(spark, [(7777, np.full(6, 49.5))]).selectExpr("chunk_id", "embedding", "0D AS away", "0 AS cell").write.partitionBy("cell").parquet(f"{path}/vectors/batch=3")
    assert found(VectorIndex(spark, path).search(asked, 3)) == brute(queries, live, 3)


def test_widths_and_empty(spark):
    with pytest.raises(UnevenVectors):
        VectorIndex.build(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]), fresh_path(spark, "index"))
    empty = VectorIndex.build(frame(spark, []), fresh_path(spark, "index"))
    asked = frame(spark, [(1, [1.0])]).withColumnRenamed("chunk_id", "query_id")
    assert empty.search(asked, 3).count() == 0


def test_nearest_other_for_all_rows(spark):
    rows = clustered(4, 500) + [(600 + i, np.full(6, 2.0)) for i in range(120)]
    index = VectorIndex.build(frame(spark, rows), fresh_path(spark, "index"))
    asked = frame(spark, rows).withColumnRenamed("chunk_id", "query_id")
    assert found(index.search(asked, 1, others=True)) == brute(rows, rows, 1, True)
    docs = frame(spark, rows).selectExpr("chunk_id", "embedding", "cast(chunk_id % 2 AS string) AS original_doc_id")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    near = {q: (i, d) for q, _, i, d in brute(list(unit.items()), list(unit.items()), 1, True)}
    want = sum(round(1 - d / 2, 9) >= 0.95 and (i % 2 != q % 2) for q, (i, d) in near.items())
    assert redundancy(docs, docs).first().asDict() == {"n_probes": 620, "n_redundant": want, "rate": round(want / 620, 6)}
