import pytest
from docloom.__main__ import parser, run
from docloom.config import EngineConfig, ensure_dirs, read_env
from docloom.console import hit_lines
from docloom.functions.lineage import dense_ids, first_by, shared_dir
from docloom.operators.embedding import CharacterEmbedder, HashingEmbedder, ModelEmbedder
from docloom.operators.mining import mine_patterns, stratified_sample
from docloom.operators.search import SearchEngine
from docloom.operators.semantic import chunk_coherence
from docloom.operators.sections import extract_sections
from docloom.operators.validate import word_coverage
from docloom.sources import io
from pyspark.sql import functions as F


def test_settings(spark, tmp_path):
    (tmp_path / ".env").write_text("# note\nexport TOP_K=7\nCHUNK_SIZE='500'\nbroken line\nST_MODEL_NAME=\"e5-base\"\n")
    assert read_env(str(tmp_path / ".env")) == {"TOP_K": "7", "CHUNK_SIZE": "500", "ST_MODEL_NAME": "e5-base"}
    assert read_env(str(tmp_path / "none")) == {}
    config = EngineConfig.from_env({"TOP_K": "9"}, str(tmp_path / ".env"))
    assert (config.top_k, config.chunk_size, config.embedding_dim) == (9, 500, 768)
    assert "top_k" in config.summary() and config.summary().endswith("768")
    for path in ensure_dirs(spark, str(tmp_path / "project")):
        assert io.exists(spark, path)


def test_commands(spark, tmp_path):
    texts = ["OYAL: davacı alacak istedi ve süre verildi. KARAR: istemin tümüyle kabul edildiği %d numara ile yazıldı, dosya kapandı." % i for i in range(6)]
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    spark.createDataFrame([(str(i), t, "court") for i, t in enumerate(texts)], "id string, text string, source string").write.parquet(raw)
    config = EngineConfig(min_text_chars=50)
    call = lambda *args: run(spark, parser().parse_args(list(args)), config)
    assert any("n_rows=6" in line for line in call("profile", raw))
    assert "total_chunks: 7" in call("build", raw, out)
    assert any("n_chunks=7" in line for line in call("chunks", out))
    assert call("sample", out, "2")[0].startswith("[1/2] chunk ")
    assert any("[KARAR]" in line for line in call("search", out, "istemin kabul edildiği"))
    (tmp_path / "q.txt").write_text("istemin kabul edildiği | kabul\nsüre verildi |\n")
    (report,) = [line for line in call("benchmark", out, str(tmp_path / "q.txt")) if "total_queries" in line]
    assert "total_queries=2" in report and float(report.split("latency_ms_mean=")[1]) > 0
    with pytest.raises(io.MissingInput):
        call("chunks", str(tmp_path / "nothing"))
    assert hit_lines("q", []) == ["Query: q", "     no hits", ""]


def test_coverage_takes_the_last_text_of_an_id(spark):
    rows = [(1, 0, "OYAL: birinci metin burada duruyor ve yeter. "), (1, 1, "OYAL: ikinci yazı burada bitiyor ve yeter. "), (2, 0, "")]
    got = word_coverage(spark.createDataFrame(rows, "doc_id long, ord int, text string"), EngineConfig(), order_col="ord").collect()
    assert [(r.doc, r.n_words, r.n_covered) for r in got] == [(1, 7, 7)]


def test_coherence_of_chunks(spark):
    rows = [(1, "aa aa. aa aa.", False), (2, "aa. ee.", False), (3, "one sentence", False), (4, "aa. ee.", True), (5, None, False), (6, "aa. ***.", None)]
    got = chunk_coherence(spark.createDataFrame(rows, "chunk_id long, text string, is_atomic boolean"), CharacterEmbedder("ae")).collect()
    assert {r.chunk_id: r.coherence for r in got} == {1: 1.0, 2: 0.0, 6: 0.0}


def test_columns_of_any_name_pass(spark):
    schema = "doc_id long, text string, first string, key string, part int, row int, place int, text_ string, section string"
    rows = spark.createDataFrame([(i, f"OYAL: text {i % 3}.", "f", "k", 1, 2, 3, "t", "OYAL") for i in range(9)], schema)
    assert first_by(rows, F.md5(F.col("text").cast("binary")), ["doc_id"]).columns == rows.columns
    numbered = dense_ids(rows, ["doc_id"], "n").collect()
    assert sorted((r.n, r.doc_id, r.part, r.row) for r in numbered) == [(i, i, 1, 2) for i in range(9)]
    assert {r.text_ for r in extract_sections(rows).collect()} == {"t"}
    assert stratified_sample(rows, 5, None, id_col="doc_id").columns == rows.columns
    load = lambda: type("Model", (), {"encode": staticmethod(lambda texts: [[float(len(t)), 1.0] for t in texts])})
    assert ModelEmbedder(load, 2, EngineConfig()).embed(rows).columns == [*rows.columns, "embedding"]


def test_patterns_without_ids(spark):
    rows = spark.createDataFrame([(None, "the same words in here 12."), (1, "the same words in here 7."), (2, "other")], "doc_id long, text string")
    assert [(r.pattern, r.doc_count) for r in mine_patterns(rows, min_docs=2).collect()] == [("the same words in here <NUM>.", 2)]


def test_latency_and_engine(spark):
    chunks = HashingEmbedder(16).embed(spark.createDataFrame([(0, "alpha beta", "OYAL", "d")], "chunk_id long, text string, section string, original_doc_id string"))
    assert SearchEngine(chunks, HashingEmbedder(16), EngineConfig()).search("alpha beta")[0]["similarity_score"] == 1.0


def test_shared_folder_is_asked_for(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
