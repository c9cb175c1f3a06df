"""Registered queries of the engine's own operators; their DuckDB SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import service
from ..config import SECTIONS, EngineConfig, model_width
from ..functions import text as tx
from ..functions.lineage import cut, fresh_path
from ..operators import chunking, cleaning, evaluate, inspection, mining, patterns, profile, search, semantic, validate
from ..operators.embedding import CharacterEmbedder, HashingEmbedder, ModelEmbedder
from ..operators.index import VectorIndex
from ..operators.sections import HEADERS, explode_sections
from ..sources import io, npy
from ..streaming import incremental, ingest
from .oracles import ORACLE_SQL

CONFIG = EngineConfig()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

__all__ = ["ORACLE_SQL", "QUERIES"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def digest(col: str = "text"):
    return F.md5(F.col(col).cast("binary"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made of all letters of each document, one of nine templates by doc_id: the documents hold no headers.

    Four quarters of the letters fill the templates; the last template goes through all header variants.
    """
    letters = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " "))
    rows = documents(spark, sf_dir).select("doc_id", letters.alias("b")).withColumn("q", F.floor(F.length("b") / 4).cast("int"))
    p1, p2, p3 = (F.trim(F.substring("b", F.col("q") * i + 1, F.col("q"))) for i in range(3))
    p4 = F.trim(F.substring("b", F.col("q") * 3 + 1, F.length("b")))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    variants = F.array(*[F.lit(v) for names in HEADERS.values() for v in names])
    variant = F.get(variants, F.pmod(F.floor(F.col("doc_id") / 9), F.size(variants)).cast("int"))
    templates = [
        join("OYAL: ", p1, ". KANUN: ", p2, ". KARAR: ", p3, ". GEREKÇE: ", p4, "."),
        join("OLAYLAR: ", p1, ". DEĞERLENDİRME: ", p2, " ", p3, ". HÜKÜM: ", p4, "."),
        join("DAVA VE KARAR: ", p1, " ", p2, ". SONUÇ ", p3, " ", p4, "."),
        join("zz ", p1, ". ", p2, ". ", p3, ". ", p4, "."),
        join("zz ", p1, ". Gereği görüşülüp düşünüldü; ", p2, " ", p3, ". ", p4, " reddine karar verilmiştir."),
        join("zz ", p1, ". ", p2, " ", p3, ". ", p4, " reddine karar verilmiştir."),
        join("KARAR: ", p1, ". ", p2, ". ", p3, ". ", p4, "."),
        join("zz ", F.col("b"), " onanmasına karar verildi."),
        join(variant, ": ", F.col("b"), "."),
    ]
    text = F.get(F.array(*[F.when(F.pmod("doc_id", F.lit(9)) == k, t) for k, t in enumerate(templates)]), F.pmod("doc_id", F.lit(9)).cast("int"))
    # written once: the sectioning expressions name their text often, and it should be a column, not this expression
    return cut(rows.select("doc_id", text.alias("text")), "decisions")


# -- ingest and cleaning -------------------------------------------------------------------------


@query
def ingest_alias_head(spark, sf_dir):
    raw = documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"), F.col("source").alias("kaynak"))
    mapped = io.map_columns(raw, F.col("doc_id"))
    return io.head(mapped, 100).select("doc_ord", "id", "source", "esasNo", F.length("text").alias("n"))


@query
def ingest_first_files(spark, sf_dir):
    """The first 500 decisions of a table of many files in reading order: footers tell which files hold them, no other is opened."""
    path = fresh_path(spark, "files")
    documents(spark, sf_dir).repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    rows = io.map_columns(io.first_rows(spark, path, 500), F.col("doc_ord"))
    return rows.select("doc_ord", "id", "source", F.length("text").alias("n"))


@query
def clean_text(spark, sf_dir):
    return cleaning.clean(documents(spark, sf_dir)).select("doc_id", F.length("text").alias("n"), digest().alias("digest"))


@query
def clean_filter_dedup(spark, sf_dir):
    return cleaning.clean_filter_dedup(documents(spark, sf_dir), CONFIG).select("doc_id", "source", F.length("text").alias("n"))


@query
def clean_report(spark, sf_dir):
    return cleaning.clean_report(documents(spark, sf_dir), CONFIG)


@query
def clean_profile(spark, sf_dir):
    return profile.length_stats(cleaning.clean_filter_dedup(documents(spark, sf_dir), CONFIG), "lang")


@query
def pattern_apply(spark, sf_dir):
    found = patterns.pattern_file([{"pattern": "the <NUM>"}], [], {})
    regexes = [*patterns.select_patterns(found, mined=True), r"(?iU)token\s+=\s+"]
    return cleaning.clean(documents(spark, sf_dir), regexes).select("doc_id", digest().alias("digest"))


@query
def pattern_apply_mined(spark, sf_dir):
    """Texts without the templates that are mined from them: hundreds of patterns, of which a text only tries those it can match."""
    docs = documents(spark, sf_dir)
    mined = [{"pattern": r.pattern} for r in mining.mine_patterns(docs, min_docs=3, top=500).select("pattern").collect()]  # 500 at most
    regexes = patterns.select_patterns(patterns.pattern_file(mined, [], {}), mined=True)
    return cleaning.clean(docs, regexes).select("doc_id", F.length("text").alias("n"), digest().alias("digest"))


# -- profile -------------------------------------------------------------------------------------


@query
def profile_length(spark, sf_dir):
    return profile.length_stats(documents(spark, sf_dir))


@query
def profile_hist(spark, sf_dir):
    return profile.length_histogram(documents(spark, sf_dir))


@query
def profile_source(spark, sf_dir):
    return profile.value_shares(documents(spark, sf_dir), "source")


@query
def profile_nulls(spark, sf_dir):
    return profile.null_counts(documents(spark, sf_dir))


@query
def profile_dups(spark, sf_dir):
    return profile.duplicate_count(documents(spark, sf_dir))


@query
def profile_encoding(spark, sf_dir):
    return profile.encoding_count(documents(spark, sf_dir))


@query
def profile_sample(spark, sf_dir):
    return profile.sample(documents(spark, sf_dir), 50).select("doc_id")


# -- text functions ------------------------------------------------------------------------------


@query
def text_snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.snippet(F.col("text"), 120).alias("snippet"))


@query
def token_set(spark, sf_dir):
    sets = documents(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"), tx.first_tokens(F.col("text")).alias("t"))
    return sets.select("doc_id", F.size("w").alias("n_words"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query
def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.word_count(F.col("text")).alias("n"))


@query
def sentence_split(spark, sf_dir):
    each = documents(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return each.select("doc_id", "pos", digest("sentence").alias("digest"))


@query
def template_normalize(spark, sf_dir):
    extra = F.concat(F.lit("12/03/2019 gün 2018/1234 sayılı m.141 ve Madde 5 ile 77 "), F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", tx.normalize_template(extra).alias("pattern"))
    return rows.select("doc_id", F.length("pattern").alias("n"), digest("pattern").alias("digest"))


# -- mining and inspection -----------------------------------------------------------------------


@query
def mine_boilerplate(spark, sf_dir):
    return mining.mine_patterns(documents(spark, sf_dir), min_docs=3, top=30)


@query
def review_counts(spark, sf_dir):
    marks = documents(spark, sf_dir).select(F.col("lang").alias("category"), (F.col("doc_id") % 3 == 0).alias("is_boilerplate"))
    return mining.review_counts(marks)


@query
def header_candidates(spark, sf_dir):
    return inspection.header_candidates(decisions(spark, sf_dir))


@query
def cue_coverage(spark, sf_dir):
    return inspection.cue_coverage(decisions(spark, sf_dir))


@query
def section_coverage(spark, sf_dir):
    return inspection.section_coverage(decisions(spark, sf_dir))


@query
def general_docs(spark, sf_dir):
    return inspection.general_only(decisions(spark, sf_dir)).select("doc_id")


@query
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return mining.stratified_sample(rows, 60, None, "label", tuple(range(10)), "vec_id")


# -- sections and chunks -------------------------------------------------------------------------


@query
def sections(spark, sf_dir):
    return explode_sections(decisions(spark, sf_dir))


@query
def section_dist(spark, sf_dir):
    return chunking.share_of(chunking.chunk_decisions(decisions(spark, sf_dir), CONFIG), "section")


@query
def chunk_pack(spark, sf_dir):
    pieces = chunking.pack(tx.clean_text(F.col("text")), 300, 30)
    each = documents(spark, sf_dir).select("doc_id", F.posexplode_outer(pieces).alias("piece_ord", "piece")).filter("piece IS NOT NULL")
    return each.select("doc_id", "piece_ord", F.length("piece").alias("n"), digest("piece").alias("digest"))


@query
def chunk_policy(spark, sf_dir):
    return chunking.chunk_decisions(decisions(spark, sf_dir), CONFIG)


@query
def chunk_dedup_ids(spark, sf_dir):
    return chunking.chunk_table(decisions(spark, sf_dir), CONFIG)


@query
def chunk_metrics(spark, sf_dir):
    docs = decisions(spark, sf_dir)
    return chunking.chunk_stats(chunking.chunk_table(docs, CONFIG), docs.count())


# -- validation ----------------------------------------------------------------------------------


def bent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a chunk table with faults of every kind, by doc_id."""
    d, t = F.col("doc_id"), F.col("text")
    return documents(spark, sf_dir).select(
        F.when(d % 50 == 1, d - 1).otherwise(d).alias("chunk_id"),
        F.when(d % 70 == 0, F.lit(" ")).otherwise(t).alias("text"),
        F.get(F.array(*map(F.lit, [*SECTIONS, "BAŞKA"])), (d % 6).cast("int")).alias("section"),
        d.cast("string").alias("original_doc_id"),
        (F.length(t) + F.when(d % 90 == 0, 1).otherwise(0)).cast("int").alias("length"),
        (d % 4 == 0).alias("is_atomic"),
    )


@query
def chunk_invariants(spark, sf_dir):
    return validate.check_invariants(bent_chunks(spark, sf_dir), CONFIG)


@query
def general_rate(spark, sf_dir):
    return validate.general_rate(chunking.chunk_decisions(decisions(spark, sf_dir), CONFIG).withColumnRenamed("doc", "original_doc_id"))


@query
def word_coverage(spark, sf_dir):
    return validate.word_coverage(decisions(spark, sf_dir), CONFIG)


@query
def coverage_summary(spark, sf_dir):
    return validate.coverage_summary(decisions(spark, sf_dir), CONFIG)


@query
def chunk_overlap(spark, sf_dir):
    return validate.chunk_overlap(chunking.chunk_decisions(decisions(spark, sf_dir), CONFIG), CONFIG)


# -- vectors and search --------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: sections and documents by label, texts by id; a vector without a text has an empty one."""
    v = table(spark, sf_dir, "embeddings")
    name = F.get(F.array(*map(F.lit, SECTIONS)), (F.col("label") % 5).cast("int"))
    rows = v.select(F.col("vec_id").alias("chunk_id"), "embedding", name.alias("section"), F.col("label").cast("string").alias("original_doc_id"))
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    return rows.join(texts, "chunk_id", "left").withColumn("text", tx.text_of(F.col("text")))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = vector_queries(spark, sf_dir).withColumn(
        "value", F.when(F.col("query_id") % 100 == 0, F.lit(" of the | THE, und , ")).otherwise(F.lit("no words"))
    )
    return io.parse_queries(asked)


@query
def knn_l2(spark, sf_dir):
    near = search.knn(vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), 10)
    return near.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query
def knn_all(spark, sf_dir):
    """The nearest of every vector: as many queries as vectors, both dealt into shards."""
    v = table(spark, sf_dir, "embeddings")
    near = search.knn(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id"), 3, most=0)
    return near.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query
def index_search(spark, sf_dir):
    """The same queries as ``knn_l2``, answered by an index that was written and is opened again."""
    path = fresh_path(spark, "index")
    VectorIndex.build(table(spark, sf_dir, "embeddings"), path, id_col="vec_id")
    near = VectorIndex(spark, path).search(vector_queries(spark, sf_dir), 10)
    return near.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query
def search_plain(spark, sf_dir):
    found = search.search(vector_queries(spark, sf_dir), corpus(spark, sf_dir), CONFIG, None, False)
    return found.withColumn("text", F.md5(F.col("text").cast("binary")))


@query
def search_rerank(spark, sf_dir):
    found = search.search(vector_queries(spark, sf_dir), corpus(spark, sf_dir), CONFIG, 7, True)
    return found.withColumn("text", F.md5(F.col("text").cast("binary")))


@query
def knn_diversify(spark, sf_dir):
    hits = search.search(vector_queries(spark, sf_dir), corpus(spark, sf_dir), CONFIG, 60, False)
    return search.diversify(hits, 5)


@query
def intra_coherence(spark, sf_dir):
    return semantic.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), "label")


@query
def coherence_summary(spark, sf_dir):
    return semantic.coherence_summary(table(spark, sf_dir, "embeddings"), "label")


@query
def within_section(spark, sf_dir):
    return semantic.within_section(corpus(spark, sf_dir))


@query
def separability(spark, sf_dir):
    return semantic.separability(corpus(spark, sf_dir))


@query
def redundancy(spark, sf_dir):
    every = corpus(spark, sf_dir)
    return semantic.redundancy(every, every, 0.5)


@query
def index_stats(spark, sf_dir):
    return io.metadata(table(spark, sf_dir, "embeddings"), CONFIG.st_model_name, True, "2025-01-01")


@query
def hashing_vectors(spark, sf_dir):
    return HashingEmbedder(32).embed(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# -- benchmark -----------------------------------------------------------------------------------


@query
def bench_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.when(F.col("item_id") % 7 == 0, F.lit("# note"))
        .when(F.col("item_id") % 7 == 1, F.lit("  "))
        .when(F.col("item_id") % 7 == 2, F.concat(F.lit(" "), F.col("text")))
        .otherwise(F.concat(F.col("text"), F.lit(" | Alpha, ,BETA | c,"), F.col("text")))
        .alias("value"),
    )
    return io.parse_queries(lines).withColumn("keywords", F.array_join("keywords", ";"))


def labelled(spark: SparkSession, sf_dir: str, weigh: bool) -> tuple[DataFrame, DataFrame]:
    asked = keyword_queries(spark, sf_dir)
    hits = search.search(vector_queries(spark, sf_dir), corpus(spark, sf_dir), CONFIG, None, weigh)
    return evaluate.label_hits(hits, asked, CONFIG), asked


@query
def bench_relevance(spark, sf_dir):
    hits, _ = labelled(spark, sf_dir, True)
    return hits.select("query_id", "rank", "chunk_id", "relevant")


@query
def bench_precision(spark, sf_dir):
    hits, asked = labelled(spark, sf_dir, True)
    return evaluate.precision(hits, asked)


@query
def bench_report(spark, sf_dir):
    (hits, asked), (plain, _) = labelled(spark, sf_dir, True), labelled(spark, sf_dir, False)
    return evaluate.report(hits, plain, asked).drop("latency_ms_mean")


@query
def bench_nested(spark, sf_dir):
    """The nested report, a row a hit."""
    hits, asked = labelled(spark, sf_dir, True)
    found = evaluate.nested_report(hits, asked)
    each = found.select("query_id", "num_results", "accuracy", F.explode("results").alias("r"))
    return each.select("query_id", "num_results", "accuracy", "r.rank", "r.chunk_id", digest("r.text").alias("digest"), "r.similarity", "r.relevant")


# -- sources, sinks and settings -----------------------------------------------------------------


@query
def csv_round_trip(spark, sf_dir):
    """Documents as decisions written as CSV and read again under their schema."""
    path = fresh_path(spark, "csv")
    raw = documents(spark, sf_dir).select(F.col("doc_id").alias("_id"), F.col("text").alias("karar_metni"), F.col("source").alias("court"))
    io.write_csv(io.map_columns(raw).drop("doc_ord"), path)
    return io.read_csv(spark, path).select("id", "source", digest().alias("digest"))


@query
def csv_decisions(spark, sf_dir):
    """The same file read as raw decisions, under whatever names its columns have."""
    path = fresh_path(spark, "csv")
    raw = documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"), F.col("source").alias("kaynak"))
    io.write_csv(raw, path)
    return io.read_decisions(spark, path, "csv").select("id", "source", F.length("text").alias("n"))


@query
def npy_round_trip(spark, sf_dir):
    """Vectors written as parts of a NumPy matrix in the order of their ids, and read again by ranges of rows."""
    path = fresh_path(spark, "npy")
    vectors = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    npy.save_vectors(vectors, path, id_col="vec_id")
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 4096))
    return npy.load_vectors(spark, path, id_col="vec_id").select("row", "vec_id", F.size("embedding").alias("width"), total.alias("total"))


@query
def pattern_round_trip(spark, sf_dir):
    """What is mined from the documents written to a pattern file beside the seeds, and read again; a missing file is empty."""
    path = fresh_path(spark, "patterns")
    mined = [r.asDict() for r in mining.mine_patterns(documents(spark, sf_dir), min_docs=3, top=30).collect()]  # 30 at most
    io.write_patterns(spark, patterns.pattern_file(mined, [], {}), path)
    found, none = io.read_patterns(spark, path), io.read_patterns(spark, path + "-none")
    rows = [(m["pattern"], m["doc_count"], len(found["seed_patterns"]), len(none)) for m in found["mined_patterns"]]
    return spark.createDataFrame(rows, "pattern string, doc_count long, n_seeds int, n_missing int")


@query
def stage_outputs(spark, sf_dir):
    """Chunks and vectors written as stages, each made once however often it is asked for, and joined by chunk id."""
    top, made = fresh_path(spark, "stages"), []
    chunks, vectors = (
        lambda: made.append("chunks") or corpus(spark, sf_dir).select("chunk_id", "section", "text"),
        lambda: made.append("vectors") or corpus(spark, sf_dir).select("chunk_id", "embedding"),
    )
    for _ in range(2):
        tables = [io.materialise(spark, f"{top}/{name}", make) for name, make in (("chunks", chunks), ("vectors", vectors))]
    joined = io.join_vectors(*tables)
    return joined.select("chunk_id", "section", F.size("embedding").alias("width"), F.lit(len(made)).alias("times_made"))


@query
def dataset_metrics(spark, sf_dir):
    return io.dataset_metrics(documents(spark, sf_dir)).drop("rows_per_second")


@query
def passage_prefix(spark, sf_dir):
    prefix = EngineConfig(st_model_name="intfloat/multilingual-e5-large").passage_prefix
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.with_prefix(F.col("text"), prefix).cast("binary")).alias("digest"))


@query
def model_widths(spark, sf_dir):
    """For each model the width of its vectors, and how many benchmark texts an embedder of that width gives vectors of."""
    names = ["intfloat/multilingual-e5-large", "e5-base-v2", "E5-Small", "all-mpnet-base-v2", CONFIG.st_model_name, "other"]
    models = spark.createDataFrame([(n, model_width(n)) for n in names], "model string, width int")
    made = [
        HashingEmbedder(w).embed(table(spark, sf_dir, "benchmark")).filter(F.size("embedding") == w).agg(F.lit(w).alias("width"), F.count(F.lit(1)).alias("n_texts"))
        for w in sorted({model_width(n) for n in names})
    ]
    return models.join(F.broadcast(reduce(DataFrame.unionByName, made)), "width").select("model", "width", "n_texts")  # a row a width


@query
def query_vectors(spark, sf_dir):
    """Queries with their prefix, embedded and looked up among embedded documents."""
    prefix = EngineConfig(st_model_name="e5-base").query_prefix
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.with_prefix(F.col("text"), prefix).alias("text"))
    embedder = CharacterEmbedder("aeinorst")
    chunks = embedder.embed(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"))
    near = search.knn(embedder.embed(asked), chunks, 3)
    return near.select("query_id", "rank", "chunk_id", "distance")


@query
def sample_strata(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return mining.stratified_sample(rows, 60, 42, "label", tuple(range(10)), "vec_id")


@query
def chunk_coherence(spark, sf_dir):
    """Coherence of documents as chunks: those that are not atomic and have two sentences, by their sentences' letters."""
    chunks = documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 4 == 0).alias("is_atomic")
    )
    return semantic.chunk_coherence(chunks, CharacterEmbedder("aeinorst"))


@query
def stream_clean(spark, sf_dir):
    """The documents arriving as a stream, cleaned and reduced to the first of equal texts."""
    path, state = fresh_path(spark, "stream"), fresh_path(spark, "state")
    docs = documents(spark, sf_dir)
    files = fresh_path(spark, "arrived")
    docs.select("doc_id", "text").write.parquet(files)
    cleaned = incremental.clean_stream(incremental.read_stream(spark, files, docs.select("doc_id", "text").schema), CONFIG)
    digests = cleaned.select(F.md5(tx.fold(F.col("text")).cast("binary")).alias("digest"))
    digests.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("digest string").parquet(path)


@query
def stream_index(spark, sf_dir):
    """Documents that arrive in three parts, later ones before their firsts, embedded into an index; its live rows."""
    arrived, state = fresh_path(spark, "arrived"), fresh_path(spark, "state")
    embedder, docs = CharacterEmbedder("aeinorst"), documents(spark, sf_dir).select("doc_id", "text")
    index = VectorIndex.fit(embedder.embed(table(spark, sf_dir, "benchmark")), fresh_path(spark, "index"), id_col="item_id")
    for part in (2, 1, 0):
        docs.filter(F.pmod("doc_id", F.lit(3)) == part).write.mode("append").parquet(arrived)
        stream = incremental.read_stream(spark, arrived, docs.schema)
        ingest.index_batches(stream, CONFIG, embedder, index, state, order_col="doc_id").awaitTermination()
    return index.vectors().select("chunk_id", F.transform("embedding", lambda x: x.cast("int")).alias("embedding"))


@query
def preconditions(spark, sf_dir):
    """Which inputs a stage would find, asked of the store that Spark reads, and how many rows those hold."""
    found = []
    for name in ("documents", "embeddings", "benchmark", "no_such_table"):
        try:
            io.require(spark, f"{sf_dir}/{name}.parquet")
            rows = table(spark, sf_dir, name)
        except io.MissingInput:
            rows = None
        n = F.count(F.lit(1)) if rows is not None else F.count(F.lit(None))
        frame = rows if rows is not None else spark.range(0)
        found.append(frame.agg(F.lit(name).alias("input"), F.lit(rows is not None).alias("found"), n.alias("n_rows")))
    return reduce(DataFrame.unionByName, found)


@query
def settings_from_env(spark, sf_dir):
    """Documents that cleaning keeps under settings from variables and under the defaults, by language; the settings beside."""
    changed = {"MIN_TEXT_CHARS": "1200", "TOP_K": "9", "USE_SECTION_RERANK": "1", "BENCHMARK_REL_THRESHOLD": "0.5", "ST_MODEL_NAME": "e5-large"}
    names = ("top_k", "use_section_rerank", "benchmark_rel_threshold", "chunk_size", "min_text_chars", "embedding_dim", "query_prefix")

    def kept(env: dict[str, str]) -> DataFrame:
        config = EngineConfig.from_env(env)
        rows = cleaning.clean_filter_dedup(documents(spark, sf_dir), config).groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))
        return rows.select("lang", "n_kept", *[F.lit(str(getattr(config, n))).alias(n) for n in names])

    return kept(changed).unionByName(kept({}))


@query
def service_answers(spark, sf_dir):
    """What the service answers to good and bad requests, with an engine over the documents and without one."""
    embedder = CharacterEmbedder("aeinorst")
    chunks = embedder.embed(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"))
    engine = search.SearchEngine(
        chunks.withColumn("section", F.lit("KARAR")).withColumn("original_doc_id", F.col("chunk_id").cast("string")), embedder, CONFIG
    )
    asked = [
        ("GET", "/health", ""), ("GET", "/stats", ""), ("POST", "/search", '{"query": "nothing but this", "top_k": 3}'),
        ("POST", "/search", '{"query": "x"}'), ("POST", "/search", '{"query": "long enough", "top_k": 0}'), ("POST", "/search", "no json"),
        ("GET", "/search", ""), ("POST", "/other", ""),
    ]
    rows = []
    for i, (method, path, body) in enumerate(asked):
        status, content = service.respond(engine, method, path, body.encode())
        rows.append((i, method, path, status, service.respond(None, method, path, body.encode())[0], len(content.get("results", []))))
    engine.corpus.unpersist()
    return spark.createDataFrame(rows, "n int, method string, path string, status int, status_without int, n_results int")


class _LetterModel:
    """A stand-in for a trained model: its vectors are counts of letters."""

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float((t or "").lower().count(c)) for c in "aeinorst"] for t in texts]


@query
def model_embedder(spark, sf_dir):
    """A model behind ``encode``, loaded once a task, with the passage prefix its name asks for."""
    config = EngineConfig(st_model_name="e5-small", normalize_embeddings=False)
    rows = ModelEmbedder(_LetterModel, 8, config).embed(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.transform("embedding", lambda x: x.cast("int")).alias("embedding"))
