import json

import pytest
from docloom.config import EngineConfig
from docloom.operators import evaluate, search, semantic
from docloom.operators.embedding import HashingEmbedder, ModelEmbedder
from docloom.service import parse_request, respond
from pyspark.sql import functions as F

CORPUS = [
    (0, [1.0, 0.0], "alpha text", "KARAR", "a"),
    (1, [1.0, 0.0], "alpha text", "OYAL", "b"),
    (2, [0.0, 1.0], "beta words here", "GENEL", "a"),
    (3, [-1.0, 0.0], "gamma", "KANUN", "c"),
    (4, [0.6, 0.8], "delta alpha", "KARAR", "d"),
]
SCHEMA = "chunk_id long, embedding array<double>, text string, section string, original_doc_id string"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, SCHEMA).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, embedding array<double>")


def test_knn_ties_and_short_corpora(asked, corpus):
    got = [(r.query_id, r.rank, r.chunk_id, r.distance) for r in search.knn(asked, corpus, 9).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(7, 1, 0, 0.0), (7, 2, 1, 0.0), (7, 3, 4, 0.8), (7, 4, 2, 2.0), (7, 5, 3, 4.0)] and len(got) == 10


def test_search_scores(asked, corpus):
    plain = {(r.query_id, r.rank): r for r in search.search(asked, corpus, EngineConfig(), 3).collect()}
    assert [plain[7, i].chunk_id for i in (1, 2, 3)] == [0, 1, 4] and plain[7, 3].final_score == 0.6
    weighed = {(r.query_id, r.rank): r for r in search.search(asked, corpus, EngineConfig(), 0, True).collect()}
    assert [weighed[7, i].chunk_id for i in (1, 2, 3)] == [0, 4, 1] and weighed[7, 2].final_score == 1.2
    assert weighed[7, 5].similarity_score == 0.0  # opposite vectors are cut to 0


def test_diversify(spark):
    hits = [(1, 1, 0, "a", 0.9, "x", "same words of text"), (1, 2, 1, "b", 0.8, "x", "same words of text"), (1, 3, 2, "a", 0.7, "x", "else"),
            (1, 4, 3, "b", 0.6, "x", "other things"), (1, 5, 4, "c", 0.5, "x", ""), (1, 6, 5, "d", 0.4, "x", "")]
    frame = spark.createDataFrame(hits, "query_id long, rank int, chunk_id long, original_doc_id string, similarity_score double, section string, text string")
    assert [r.chunk_id for r in search.diversify(frame, 3).orderBy("place").collect()] == [0, 3, 4]
    assert search.diversify(frame, 9).count() == 4  # empty texts are near nothing


def test_semantic(spark, corpus):
    groups = {r.original_doc_id: r.coherence for r in semantic.mean_pairwise_cosine(corpus, "original_doc_id").collect()}
    assert groups["a"] == 0.0 and groups["b"] is None
    assert semantic.separability(corpus).first().mean_cross is None  # one section of two vectors, the others are left out
    two = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.6, 0.8]), ("y", [0.0, 2.0]), ("y", [0.0, 1.0])], "section string, embedding array<double>")
    row = semantic.separability(two).first()
    assert (row.mean_within, row.mean_cross, row.margin) == (0.8, 0.4, 0.4)
    red = semantic.redundancy(corpus, corpus)
    assert red.first().n_redundant == 2


def test_benchmark(spark, asked, corpus):
    queries = spark.createDataFrame([(7, "q", ["alpha"]), (8, "r", []), (9, "none", [])], "query_id long, query string, keywords array<string>")
    config = EngineConfig()
    hits = evaluate.label_hits(search.search(asked, corpus, config, 3), queries, config)
    precision = {r.query_id: (r.num_results, round(r.accuracy, 3)) for r in evaluate.precision(hits, queries).collect()}
    assert precision == {7: (3, 1.0), 8: (3, 0.667), 9: (0, 0.0)}
    row = evaluate.report(hits, hits, queries, 12.345).first()
    assert (row.total_queries, row.accuracy, row.false_positive_rate, row.rerank_delta, row.latency_ms_mean) == (3, 0.556, 0.444, 0.0, 12.3)
    nested = {r.query_id: r for r in evaluate.nested_report(hits, queries).collect()}
    assert len(nested[7].results) == 3 and nested[9].results is None


class Model:
    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_embedders_and_engine(spark):
    rows = spark.createDataFrame([(0, "dava dosyası"), (1, "kira sözleşmesi"), (2, "")], "chunk_id long, text string")
    full = rows.withColumn("section", F.lit("GENEL")).withColumn("original_doc_id", F.col("chunk_id").cast("string"))
    engine = search.SearchEngine(HashingEmbedder(64).embed(full), HashingEmbedder(64), EngineConfig())
    best = engine.search("kira sözleşmesi")[0]
    assert best["chunk_id"] == 1 and best["similarity_score"] == 1.0 and best["rank"] == 1
    assert engine.get_stats() == {"total_chunks": 3, "model": EngineConfig().st_model_name, "vector_dim": 64}
    vectors = ModelEmbedder(Model, 2, EngineConfig()).embed(rows).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in vectors)
    status, content = respond(engine, "POST", "/search", json.dumps({"query": "dava", "top_k": 2}).encode())
    assert status == 200 and len(content["results"]) == 2
    assert respond(engine, "POST", "/search", b'{"query": "x"}')[0] == 400
    assert respond(None, "GET", "/stats")[0] == 503 and respond(None, "GET", "/health")[0] == 200
    assert respond(engine, "GET", "/stats")[0] == 200 and respond(engine, "GET", "/x")[0] == 404


def test_requests():
    assert parse_request(b'{"query": "ab"}', 5) == ("ab", 5)
    for bad in (b'{"query": "ab", "top_k": 0}', b'{"query": "ab", "top_k": 51}', b"{", b'{"query": 5}'):
        with pytest.raises(ValueError):
            parse_request(bad, 5)
