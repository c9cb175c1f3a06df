"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Canonical columns of a raw decision and the names they are accepted under, in order.
ALIASES = {
    "text": ("text", "content", "karar_metni", "decision_text"),
    "source": ("source", "kaynak", "court"),
    "id": ("id", "doc_id", "_id"),
    "esasNo": ("esasNo", "esas_no", "esasNumarasi"),
    "kararNo": ("kararNo", "karar_no", "kararNumarasi"),
    "kararTarihi": ("kararTarihi", "karar_tarihi", "date"),
    "cluster_ids": ("cluster_ids", "cluster_id", "clusters"),
}

DECISION = T.StructType([T.StructField(c, T.StringType()) for c in ALIASES])

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("original_doc_id", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("is_atomic", T.BooleanType()),
    ]
)

SECTION_LIST = "array<struct<section:string,text:string>>"

PATTERNS = T.StructType(
    [
        T.StructField(
            "seed_patterns",
            T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("category", "regex", "example")])),
        ),
        T.StructField(
            "mined_patterns",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("pattern", T.StringType()),
                        T.StructField("example", T.StringType()),
                        T.StructField("doc_count", T.LongType()),
                        T.StructField("doc_coverage", T.DoubleType()),
                        T.StructField("category", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "reviewed",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("chunk_id", T.LongType()),
                        T.StructField("section", T.StringType()),
                        T.StructField("original_doc_id", T.StringType()),
                        T.StructField("is_boilerplate", T.BooleanType()),
                        T.StructField("category", T.StringType()),
                        T.StructField("first_sentence", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

TEST_QUERIES = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField(
            "queries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("query", T.StringType()),
                        T.StructField("topic", T.StringType()),
                        T.StructField("expected_keywords", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)
