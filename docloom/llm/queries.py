"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontamination import find_leaks
from .html_text import main_text
from .licenses import scan_licenses
from .mixing import mix_sources
from .negatives import hard_negatives
from .quality import quality
from .secrets import BASE_KINDS, COPIED_OWNERS, COPIED_REPOS, LEAST_VALUE, PATTERNS, PLACEHOLDERS, scan_secrets
from .simhash import near_duplicates
from .sketches import fingerprints
from .tokens import count_tokens
from .topk import top_k
from .toxicity import toxicity
from .whitening import whiten


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved on by one, so that labels and directions disagree somewhere."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Matches of one pattern: where the gaps before it and the matches before it end.
_MATCHES = " UNION ALL ".join(
    f"""SELECT row, doc_id, source, {kind} AS kind, '{name}' AS name, regexp_extract_all(t, {_quoted(pattern)}, 0) AS m,
        regexp_extract_all(t, {_quoted(pattern)}, {group}) AS v, list_transform(regexp_split_to_array(t, {_quoted(pattern)}), lambda x: length(x)) AS gaps FROM d"""
    for kind, (name, pattern, group) in enumerate(PATTERNS)
)

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
matches AS ({_MATCHES}),
each AS (SELECT row, doc_id, source, kind, name, v[i] AS v, m[i] AS m, (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM matches, unnest(range(1, len(m) + 1)) AS u(i)),
spans AS (SELECT *, s + length(m) AS e FROM each WHERE (kind <> 0 OR length(v) >= {LEAST_VALUE})
    AND (kind <> {len(PATTERNS) - 1} OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9].*[0-9].*[0-9]')))),
owned AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners,
    count(DISTINCT coalesce('=' || source, '') || chr(1) || coalesce(doc_id::VARCHAR, '')) AS repos FROM spans GROUP BY v),
known AS (SELECT row, kind, name, s, e, owners < {COPIED_OWNERS} AND repos < {COPIED_REPOS} AND NOT regexp_matches(lower(v), {_quoted(PLACEHOLDERS)}) AS live
    FROM spans JOIN owned USING (v)),
base AS (SELECT * FROM known WHERE kind < {BASE_KINDS}),
wide AS (SELECT * FROM known k WHERE kind >= {BASE_KINDS} AND live AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = k.row AND b.s < k.e AND k.s < b.e)),
kept AS (SELECT * FROM base UNION ALL SELECT * FROM wide w WHERE NOT EXISTS
    (SELECT 1 FROM wide o WHERE o.row = w.row AND o.s < w.e AND w.s < o.e AND (o.s < w.s OR (o.s = w.s AND o.kind < w.kind))))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < {BASE_KINDS}), '')) AS base_sha256,
    coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind), '') AS spans,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM d LEFT JOIN kept USING (row) GROUP BY row""",
    "op10_benchmark_decontamination": r"""
WITH texts AS (SELECT 0 AS side, row_number() OVER () AS key, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
words AS (SELECT side, key, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM texts),
sized AS (SELECT *, greatest(len(w) - 4, 1) AS n FROM words WHERE len(w) > 0),
shingles AS (SELECT side, key, id, n, p::INT AS p, array_to_string(w[p + 1:p + 5], ' ') AS h FROM sized, unnest(range(n)) AS u(p)),
items AS (SELECT key AS item, id AS item_id, n AS m, h, count(*) AS c FROM shingles WHERE side = 1 GROUP BY ALL),
hits AS (SELECT s.key, s.id, s.n, s.p, i.item, i.item_id, i.m, i.h, i.c FROM shingles s JOIN items i ON s.h = i.h WHERE s.side = 0),
windows AS (SELECT DISTINCT key, id, n, item, item_id, m, least(m, n) AS size, b::INT AS b FROM hits, unnest(range(greatest(0, p - m + 1), least(p, n - least(m, n)) + 1)) AS u(b)),
shared AS (SELECT w.key, w.id, w.item, w.item_id, w.m, w.size, w.b, h.h, least(count(*), any_value(h.c)) AS overlap
    FROM windows w JOIN hits h ON h.key = w.key AND h.item = w.item AND h.p >= w.b AND h.p < w.b + w.size GROUP BY ALL),
scored AS (SELECT id, item_id, m, size, b, sum(overlap) AS overlap FROM shared GROUP BY key, id, item, item_id, m, size, b),
near AS (SELECT *, overlap::DOUBLE / (size + m - overlap) AS s FROM scored WHERE overlap::DOUBLE / (size + m - overlap) >= 0.8)
SELECT id AS doc_id, item_id, round(s, 6) AS similarity, b::BIGINT AS start, size::BIGINT AS n_shingles FROM near
QUALIFY row_number() OVER (PARTITION BY id, item_id ORDER BY s DESC, b) = 1""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[\p{L} ]+', '', 'g')) / length(text) END AS other,
        (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
q AS (SELECT *, (CASE WHEN other <= 0.05 THEN 1.0 WHEN other <= 0.15 THEN 0.75 WHEN other <= 0.30 THEN 0.5 ELSE 0.25 END)::DOUBLE AS quality FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM q GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM w) AS total, cap / weight AS level FROM w),
g AS (SELECT a.*, (SELECT sum(least(b.cap, a.level * b.weight)) FROM l b) < total AS capped FROM l a),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE least(cap, weight * ((total - coalesce((SELECT sum(cap) FROM g WHERE capped), 0))
        / (SELECT sum(weight) FROM g WHERE NOT capped))) END AS target FROM g),
e AS (SELECT q.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
        sum(q.size) OVER (PARTITION BY q.source ORDER BY -ln(u) / quality, doc_id, q.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, quality, epochs,
    (size * (epochs + CASE WHEN 2.0 * upto - size <= 2.0 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e""",
    "op7_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INT AS rank,
    c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 5""",
    "op11_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r AS a, p.r AS p, a.vec_id AS anchor_id, a.label, a.e, p.vec_id AS positive_id, list_inner_product(a.e, p.e)::BIGINT AS positive_score
    FROM v a JOIN v p ON p.label = a.label AND p.r <> a.r WHERE a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.e, p.e) DESC, p.vec_id) <= 5),
n AS (SELECT p.*, n.vec_id AS negative_id, list_inner_product(p.e, n.e)::BIGINT AS negative_score FROM p JOIN v n ON n.label <> p.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY a, p ORDER BY negative_score DESC, negative_id)::INT AS rank, negative_id, positive_score, negative_score
FROM n WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score QUALIFY rank <= 10""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_exact_topk": op7_exact_topk,
    "op8_main_text": op8_main_text,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_document_fingerprints": op13_document_fingerprints,
}
