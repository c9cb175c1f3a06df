import time

import pytest
from docloom.config import EngineConfig
from docloom.functions.lineage import fresh_path
from docloom.operators.cleaning import clean_filter_dedup
from docloom.operators.embedding import CharacterEmbedder
from docloom.operators.index import VectorIndex
from docloom.streaming import incremental, ingest
from pyspark.sql import functions as F

CONFIG = EngineConfig(min_text_chars=10)
LETTERS = CharacterEmbedder("abc")
SCHEMA = "doc_ord long, text string"

#: Arrivals: copies before and after their first, in one batch and across batches, short and null texts, a null order.
BATCHES = [
    [(50, "aaa bbb ccc long"), (40, "aaa bbb  ccc long"), (41, "cab cab cab cab"), (7, None)],
    [(30, "aaa bbb ccc long"), (90, "aaa bbb ccc long"), (42, "bbbbbbbbbbbbbbb"), (8, "short")],
    [(31, "aaa bbb ccc long"), (10, "cab cab cab cab"), (None, "a text without order"), (42, "bbbbbbbbbbbbbbb")],
]


def new_index(spark):
    sample = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [9.0, 0.0, 0.0]), (2, [0.0, 9.0, 9.0])], "chunk_id long, embedding array<double>")
    return VectorIndex.fit(sample, fresh_path(spark, "index"), cells=3)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, index, state, **more):
    stream = ingest.read_arrivals(spark, path, SCHEMA)
    query = ingest.index_batches(stream, CONFIG, LETTERS, index, state, **more)
    assert query.awaitTermination(240), 'the stream does not end'
    return query


def live(index):
    return sorted((r.chunk_id, r.embedding) for r in index.vectors().collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_any_order_of_arrival_gives_the_batch_result(spark, order):
    path, index, state = fresh_path(spark, "arrived"), new_index(spark), fresh_path(spark, "state")
    for k in order:
        arrive(spark, path, BATCHES[k])
        if k == 1:
            run(spark, path, index, state)  # stopped in between: the rest is taken up by a second run
    run(spark, path, VectorIndex(spark, index.path), state)
    rows = [r for batch in BATCHES for r in batch if r[0] is not None]
    batch = LETTERS.embed(clean_filter_dedup(spark.createDataFrame(rows, SCHEMA), CONFIG, order_col="doc_ord"))
    want = sorted((r.doc_ord, r.embedding) for r in batch.collect())
    assert live(VectorIndex(spark, index.path)) == want and [c for c, _ in want] == [10, 30, 42]
    asked = spark.createDataFrame([(1, [3.0, 3.0, 3.0])], "query_id long, embedding array<double>")
    assert [r.chunk_id for r in index.search(asked, 2).orderBy("rank").collect()] == [30, 10]


def test_a_time_out_forgets(spark):
    path, index, state = fresh_path(spark, "arrived"), new_index(spark), fresh_path(spark, "state")
    arrive(spark, path, [(5, "aaa bbb ccc long")])
    run(spark, path, index, state, time_out="1 second")
    time.sleep(2)
    arrive(spark, path, [(6, "aaa bbb ccc long")])
    run(spark, path, index, state, time_out="1 second")
    assert [c for c, _ in live(index)] == [5, 6]


def test_texts_are_cleaned_once(spark):
    docs = spark.createDataFrame(BATCHES[0], SCHEMA)
    for rows in (ingest.first_texts(docs, CONFIG), incremental.clean_stream(docs, CONFIG), clean_filter_dedup(docs, CONFIG, order_col="doc_ord")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"(?U)\.(?:") == 1  # the orphan periods, which a second cleaning in a filter would name again


def test_texts_are_embedded_once(spark):
    made = spark.sparkContext.accumulator(0)

    class Counting(CharacterEmbedder):
        def embed(self, df, text_col="text", out="embedding"):
            @F.udf("array<double>")
            def vector(text):
                made.add(1)
                return [float(text.count(c)) for c in "abc"]

            return df.withColumn(out, vector(text_col))

    path, index, state = fresh_path(spark, "arrived"), new_index(spark), fresh_path(spark, "state")
    arrive(spark, path, [(3, "abc abc abc"), (4, "abc abc  abc"), (5, "ccccccccccc"), (6, "short")])
    query = ingest.index_batches(ingest.read_arrivals(spark, path, SCHEMA), CONFIG, Counting("abc"), index, state)
    assert query.awaitTermination(240) and live(index) == [(3, [3.0, 3.0, 3.0]), (5, [0.0, 0.0, 11.0])] and made.value == 2
