import pytest
from docloom.config import EngineConfig
from docloom.operators.embedding import HashingEmbedder
from docloom.operators.patterns import pattern_file
from docloom.plans.batch import build
from docloom.sources import io
from docloom.streaming.incremental import chunk_batches, clean_stream, read_stream


def test_aliases(spark):
    raw = spark.createDataFrame([("t", None, "k", 5), (None, "c", "", 6)], "text string, content string, kaynak string, doc_id int")
    rows = io.map_columns(raw).orderBy("doc_ord").collect()
    assert [(r.text, r.source, r.id, r.esasNo) for r in rows] == [("t", "k", "5", ""), ("c", "", "6", "")]
    assert [r.id for r in io.head(io.map_columns(raw), 1).collect()] == ["5"]


def test_query_lists(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n plain query \na | B, ,c\nx | y | Z\nlast|\n", encoding="utf-8")
    rows = io.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()
    assert [(r["query"], r.keywords) for r in rows] == [("plain query", []), ("a", ["b", "c"]), ("x", ["y | z"]), ("last", [])]
    (tmp_path / "t.json").write_text('{"description": "d", "queries": [{"id": "q1", "query": "x", "topic": "t", "expected_keywords": ["k"]}]}')
    assert io.read_test_queries(spark, str(tmp_path / "t.json")).first().expected_keywords == ["k"]


def test_csv_and_patterns(spark, tmp_path):
    rows = spark.createDataFrame([('line one\nline "two", x', "s", "1", "", "", "", "")], io.DECISION)
    io.write_csv(rows, str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv")).first().text == 'line one\nline "two", x'
    assert io.read_decisions(spark, str(tmp_path / "csv"), "csv").first().id == "1"
    assert io.read_patterns(spark, str(tmp_path / "none")) == {}
    (tmp_path / "broken.json").write_text("{not json")
    assert not any(io.read_patterns(spark, str(tmp_path / "broken.json")).values())
    io.write_patterns(spark, pattern_file([], [], {}), str(tmp_path / "p"))
    assert len(io.read_patterns(spark, str(tmp_path / "p"))["seed_patterns"]) == 16
    with pytest.raises(io.MissingInput):
        io.require(spark, str(tmp_path / "none"))


def test_materialise_and_join(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3).withColumnRenamed("id", "chunk_id")
    for _ in range(2):
        chunks = io.materialise(spark, str(tmp_path / "m"), make)
    assert len(calls) == 1
    vectors = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (5, [1.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(io.RowMismatch):
        io.join_vectors(chunks, vectors)
    assert io.join_vectors(chunks, vectors, strict=False).count() == 2


def test_batch_and_stream(spark, tmp_path):
    texts = ["OYAL: davacı alacak istedi ve süre verildi. KARAR: istemin tümüyle kabul edildiği %d numara ile yazıldı, dosya kapandı." % i for i in range(6)]
    rows = [(str(i), t) for i, t in enumerate([*texts, texts[0], "kısa"])]
    raw = spark.createDataFrame(rows, "id string, text string")
    raw.coalesce(1).write.parquet(str(tmp_path / "raw"))
    config = EngineConfig(min_text_chars=50)
    engine = build(spark, str(tmp_path / "raw"), str(tmp_path / "out"), HashingEmbedder(32), config)
    assert engine.get_stats()["total_chunks"] == spark.read.parquet(str(tmp_path / "out/chunks")).count() == 7
    assert engine.search("istemin kabul edildiği", 2)[0]["section"] == "KARAR"
    stream = clean_stream(read_stream(spark, str(tmp_path / "raw"), raw.schema), config)
    chunk_batches(stream, config, str(tmp_path / "s"), str(tmp_path / "c"), "id").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).select("doc").distinct().count() == 6
