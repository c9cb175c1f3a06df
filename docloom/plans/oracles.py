"""DuckDB SQL of the catalogue's queries, written independently of the Spark expressions where it can be."""

from __future__ import annotations

from ..operators.inspection import CUES
from ..operators.patterns import SEEDS
from ..operators.sections import HEADERS

#: White space as the engine defines it, for an engine whose \\s is ASCII.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LABELS = "MAHKEMESİ|MAHKEMESI|DAVA TÜRÜ|DAVA TURU|TARİHİ|TARIHI|ESAS NO|KARAR NO|NUMARASI|İTHAL|TAtarafLAR|TARAFLAR|İNCELENEN KARARIN|INCELENEN KARARIN"


def sub(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, '{pattern}', '{to}', 'g')"


def strip(e: str) -> str:
    return sub(e, f"^{WS}+|{WS}+$", "")


def collapse(e: str) -> str:
    return sub(e, f"{WS}+", " ")


def clean(e: str, patterns: tuple[str, ...] = ()) -> str:
    e = sub(f"coalesce({e}, '')", rf"(?im)^{WS}*(?:{LABELS})\b.*$", " ")
    e = sub(sub(e, r"\*+", " "), rf'(?i)"?{WS}*İçtihat{WS}+Metni{WS}*"?', " ")
    e = collapse(e)
    for p in patterns:
        e = sub(e, p, " ")
    return f"trim({collapse(sub(e, rf'\.(?:{WS}*\.)+', '.'))})"


def sentences(e: str) -> str:
    marked = f"regexp_replace({e}, '([.!?…]){WS}+', '\\1' || chr(1), 'g')"
    each = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({each}, lambda s: s <> '')"


def split_words(e: str) -> str:
    return f"list_filter(string_split(trim({collapse(e)}), ' '), lambda w: w <> '')"


def fold(e: str) -> str:
    return f"replace(replace(lower({e}), 'ß', 'ss'), 'ς', 'σ')"


def normalize(e: str) -> str:
    e = fold(strip(e))
    for name, p in (
        ("<DATE>", r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}"),
        ("<NO>", r"\b\d{4}\s*/\s*\d+\b"),
        ("<MADDE>", r"\bm(?:adde|\.)\s*\d+\b"),
        ("<NUM>", r"\b\d+\b"),
    ):
        e = sub(e, p, name)
    return f"trim({collapse(e)})"


def pack(e: str, size: int, overlap: int) -> str:
    """Chunks of a stripped text, by folding its sentences."""
    step = size - overlap
    nxt = f"trim(right(a.cur, {overlap}) || ' ' || x.cur)"
    cuts = f"greatest(0, ceil((length({nxt}) - {size}) / {step}.0))::INT"
    flushed = "CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END"
    pieces = f"list_transform(range({cuts}), lambda i: substr({nxt}, (i * {step} + 1)::INT, {size}))"
    start = "{'done': []::VARCHAR[], 'cur': ''}"
    rows = f"list_transform({sentences(e)}, lambda s: {{'done': []::VARCHAR[], 'cur': s}})"
    folded = f"""list_reduce({rows}, lambda a, x: CASE WHEN length(a.cur) + length(x.cur) + 1 <= {size}
        THEN {{'done': a.done, 'cur': trim(a.cur || ' ' || x.cur)}}
        ELSE {{'done': list_concat({flushed}, {pieces}), 'cur': substr({nxt}, {cuts} * {step} + 1)}} END, {start})"""
    return f"""(CASE WHEN {e} = '' THEN []::VARCHAR[] WHEN length({e}) <= {size} THEN [{e}]
        ELSE (SELECT CASE WHEN f.cur <> '' THEN list_append(f.done, f.cur) ELSE f.done END FROM (SELECT {folded} AS f)) END)"""


STATS = """count(*) AS n, min(length({t})) AS min_len, max(length({t})) AS max_len, round(avg(length({t})), 6) AS mean_len,
    round(median(length({t})), 6) AS median_len, round(stddev_pop(length({t})), 6) AS std_len"""

CLEANED = f"""cleaned AS (SELECT doc_id, source, lang, {clean("text")} AS text FROM documents),
kept AS (SELECT * FROM cleaned WHERE length(text) >= 100 QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"""

#: The decisions by their parts; what each template's sections are is stated from the parts.
PARTS = """parts AS (SELECT doc_id, doc_id % 9 AS k, (doc_id // 9) % 36 AS v, b, trim(substr(b, 1, q)) AS p1, trim(substr(b, q + 1, q)) AS p2,
    trim(substr(b, 2 * q + 1, q)) AS p3, trim(substr(b, 3 * q + 1)) AS p4
    FROM (SELECT doc_id, b, length(b) // 4 AS q FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g')) AS b FROM documents)))"""
#: Header variants whose inner word is a header too: the first word then stands by itself, as facts.
PARTED = {
    "DAVA VE KARAR": ("DAVA VE", "KARAR"),
    "İLGİLİ KANUN": ("İLGİLİ", "KANUN"),
    "ILGILI KANUN": ("ILGILI", "KANUN"),
    "İLGİLİ MEVZUAT": ("İLGİLİ", "MEVZUAT"),
    "ILGILI MEVZUAT": ("ILGILI", "MEVZUAT"),
}
SECTION_OF = {v: "KARAR" if v == "DAVA VE KARAR" else s for s, names in HEADERS.items() for v in names}
VARIANTS = "[" + ", ".join(
    f"{{'v': '{v}', 'front': '{PARTED.get(v, ('', ''))[0]}', 'head': '{PARTED.get(v, ('', v))[1]}', 'section': '{SECTION_OF[v]}'}}"
    for names in HEADERS.values()
    for v in names
) + "][v + 1]"
DECISIONS = f"""{PARTS}, decisions AS (SELECT doc_id, CASE k
    WHEN 0 THEN 'OYAL: ' || p1 || '. KANUN: ' || p2 || '. KARAR: ' || p3 || '. GEREKÇE: ' || p4 || '.'
    WHEN 1 THEN 'OLAYLAR: ' || p1 || '. DEĞERLENDİRME: ' || p2 || ' ' || p3 || '. HÜKÜM: ' || p4 || '.'
    WHEN 2 THEN 'DAVA VE KARAR: ' || p1 || ' ' || p2 || '. SONUÇ ' || p3 || ' ' || p4 || '.'
    WHEN 3 THEN 'zz ' || p1 || '. ' || p2 || '. ' || p3 || '. ' || p4 || '.'
    WHEN 4 THEN 'zz ' || p1 || '. Gereği görüşülüp düşünüldü; ' || p2 || ' ' || p3 || '. ' || p4 || ' reddine karar verilmiştir.'
    WHEN 5 THEN 'zz ' || p1 || '. ' || p2 || ' ' || p3 || '. ' || p4 || ' reddine karar verilmiştir.'
    WHEN 6 THEN 'KARAR: ' || p1 || '. ' || p2 || '. ' || p3 || '. ' || p4 || '.'
    WHEN 7 THEN 'zz ' || b || ' onanmasına karar verildi.'
    ELSE ({VARIANTS}).v || ': ' || b || '.' END AS text FROM parts)"""
EXPECTED = f"""{DECISIONS}, expected AS (SELECT doc_id AS doc, CASE k
    WHEN 0 THEN [{{'section': 'OYAL', 'text': 'OYAL: ' || p1 || '.'}}, {{'section': 'KANUN', 'text': 'KANUN: ' || p2 || '.'}},
                 {{'section': 'KARAR', 'text': 'KARAR: ' || p3 || '.'}}, {{'section': 'GEREKÇE', 'text': 'GEREKÇE: ' || p4 || '.'}}]
    WHEN 1 THEN [{{'section': 'OYAL', 'text': 'OLAYLAR: ' || p1 || '.'}}, {{'section': 'GEREKÇE', 'text': 'DEĞERLENDİRME: ' || p2 || ' ' || p3 || '.'}},
                 {{'section': 'KARAR', 'text': 'HÜKÜM: ' || p4 || '.'}}]
    WHEN 2 THEN [{{'section': 'OYAL', 'text': 'DAVA VE'}},
                 {{'section': 'KARAR', 'text': 'KARAR: ' || p1 || ' ' || p2 || '. SONUÇ ' || p3 || ' ' || p4 || '.'}}]
    WHEN 3 THEN [{{'section': 'GENEL', 'text': text}}]
    WHEN 4 THEN [{{'section': 'OYAL', 'text': 'zz ' || p1 || '.'}}, {{'section': 'GEREKÇE', 'text': '; ' || p2 || ' ' || p3 || '.'}},
                 {{'section': 'KARAR', 'text': trim(p4 || ' reddine karar verilmiştir.')}}]
    WHEN 5 THEN [{{'section': 'OYAL', 'text': 'zz ' || p1 || '. ' || p2 || ' ' || p3 || '.'}},
                 {{'section': 'KARAR', 'text': trim(p4 || ' reddine karar verilmiştir.')}}]
    WHEN 6 THEN [{{'section': 'KARAR', 'text': text}}]
    WHEN 7 THEN [{{'section': CASE WHEN length(text) < 400 THEN 'KARAR' ELSE 'GENEL' END, 'text': text}}]
    ELSE CASE WHEN ({VARIANTS}).front = '' THEN [{{'section': ({VARIANTS}).section, 'text': text}}]
         ELSE [{{'section': 'OYAL', 'text': ({VARIANTS}).front}}, {{'section': ({VARIANTS}).section, 'text': ({VARIANTS}).head || ': ' || b || '.'}}] END
    END AS found FROM parts JOIN decisions USING (doc_id)),
sections AS (SELECT doc, i::INT AS sec_ord, found[i + 1].section AS section, found[i + 1].text AS text
    FROM expected, unnest(range(len(found))) AS u(i))"""
CHUNKS = f"""{EXPECTED}, sized AS (SELECT *, section IN ('KANUN', 'KARAR') AND length(text) <= 4000 AS is_atomic FROM sections),
pieces AS (SELECT *, CASE WHEN is_atomic THEN [text] ELSE {pack("text", 1000, 100)} END AS p FROM sized),
chunks AS (SELECT doc, sec_ord, i::INT AS piece_ord, section, trim(p[i + 1]) AS text, is_atomic
    FROM pieces, unnest(range(len(p))) AS u(i) WHERE is_atomic OR length(trim(p[i + 1])) >= 30)"""
CHUNK_TABLE = f"""{CHUNKS}, firsts AS (SELECT * FROM chunks
    QUALIFY row_number() OVER (PARTITION BY {fold("text")} ORDER BY doc, sec_ord, piece_ord) = 1),
chunk_table AS (SELECT row_number() OVER (ORDER BY doc, sec_ord, piece_ord) - 1 AS chunk_id, text, section,
    doc::VARCHAR AS original_doc_id, length(text)::INT AS length, is_atomic FROM firsts)"""

WORDS = "list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))"

VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_sum(list_transform(range(1, len(q.e) + 1),
    lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))), 12) AS distance FROM v q, v c WHERE q.vec_id % 50 = 0)"""
CORPUS = """corpus AS (SELECT vec_id AS chunk_id, e, coalesce(d.text, '') AS text, ['OYAL', 'KANUN', 'KARAR', 'GEREKÇE', 'GENEL'][label % 5 + 1] AS section,
    label::VARCHAR AS original_doc_id FROM v LEFT JOIN documents d ON d.doc_id = vec_id)"""


def searched(k: int, weigh: bool, name: str = "found", candidates: int = 30) -> str:
    weight = "CASE section WHEN 'KARAR' THEN 2.0 WHEN 'KANUN' THEN 1.3 WHEN 'GEREKÇE' THEN 1.0 WHEN 'OYAL' THEN 0.8 ELSE 1.0 END"
    weight = f"({weight})::DOUBLE" if weigh else "1.0::DOUBLE"
    return f"""{name}_near AS (SELECT n.query_id, n.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, n.chunk_id) AS r,
    round(greatest(0, least(1, 1 - distance / 2)), 4) AS similarity_score, text, section, original_doc_id
    FROM near n JOIN corpus USING (chunk_id) QUALIFY r <= {max(candidates, k)}),
{name} AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, r))::INT AS rank, chunk_id, text, section,
    original_doc_id, similarity_score, section_weight, final_score FROM (SELECT *, {weight} AS section_weight,
    round(similarity_score * {weight}, 4) AS final_score FROM {name}_near) QUALIFY rank <= {k})"""


HITS = "SELECT query_id, rank, chunk_id, md5(text) AS text, section, original_doc_id, similarity_score, section_weight, final_score FROM found"
UNITS = """u AS (SELECT *, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-8)) AS w FROM {t})"""
COHERENCE = f"""{UNITS.format(t="v")}, pairs AS (SELECT a.label, list_inner_product(a.w, b.w) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id),
coherence AS (SELECT label, count(*) AS n, (SELECT round(avg(s), 6) FROM pairs p WHERE p.label = v.label) AS coherence FROM v GROUP BY label)"""
KEYWORDS = "CASE WHEN query_id % 100 = 0 THEN ['the', 'und'] ELSE []::VARCHAR[] END"
RELEVANT = f"""similarity_score >= 0.35 AND (len({KEYWORDS}) = 0 OR list_bool_or(list_transform({KEYWORDS}, lambda k: contains(lower(text), k))))"""
PRECISION = f"""asked AS (SELECT DISTINCT query_id FROM near),
{{name}} AS (SELECT query_id, count(f.chunk_id) AS num_results, coalesce(count(*) FILTER (WHERE relevant) / nullif(count(f.chunk_id), 0), 0) AS accuracy
    FROM asked LEFT JOIN (SELECT *, {RELEVANT} AS relevant FROM {{hits}}) f USING (query_id) GROUP BY query_id)"""

ORACLE_SQL: dict[str, str] = {
    "ingest_alias_head": "SELECT doc_id AS doc_ord, doc_id::VARCHAR AS id, source, '' AS \"esasNo\", length(text)::INT AS n FROM documents ORDER BY doc_id LIMIT 100",
    "ingest_first_files": """SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_ord, doc_id::VARCHAR AS id, source, length(text)::INT AS n
        FROM documents ORDER BY doc_id LIMIT 500""",
    "clean_text": f"SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT doc_id, {clean('text')} AS t FROM documents)",
    "clean_filter_dedup": f"WITH {CLEANED} SELECT doc_id, source, length(text)::INT AS n FROM kept",
    "clean_report": f"""WITH {CLEANED} SELECT mean_before, median_before, chars_before, mean_after, median_after, chars_after,
        round(1 - chars_after / greatest(chars_before, 1), 6) AS reduction FROM
        (SELECT round(avg(length(text)), 6) AS mean_before, round(median(length(text)), 6) AS median_before, sum(length(text))::BIGINT AS chars_before FROM documents),
        (SELECT round(avg(length(text)), 6) AS mean_after, round(median(length(text)), 6) AS median_after, sum(length(text))::BIGINT AS chars_after FROM kept)""",
    "clean_profile": f"WITH {CLEANED} SELECT lang, {STATS.format(t='text')} FROM kept GROUP BY lang",
    "pattern_apply": f"SELECT doc_id, md5({clean('text', (*('(?i)' + r for _, r, _ in SEEDS), r'(?i)the\s+\d+', r'(?i)token\s+=\s+'))}) AS digest FROM documents",
    "profile_length": f"SELECT {STATS.format(t='text')} FROM documents",
    "profile_hist": """WITH l AS (SELECT length(text)::DOUBLE AS n FROM documents), b AS (SELECT min(n) AS lo, max(n) AS hi FROM l)
        SELECT least(10, floor((n - lo) * 10 / (hi - lo)) + 1)::INT AS bin, count(*) AS n FROM l, b GROUP BY 1""",
    "profile_source": """SELECT coalesce(source, '<null>') AS source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct
        FROM documents GROUP BY 1""",
    "profile_nulls": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {'0' if c == 'text' else f'count(*) FILTER (WHERE {c} IS NULL)'}::BIGINT AS n_null, "
        f"count(*) FILTER (WHERE trim({'coalesce(text, chr(32))' if c == 'text' else f'{c}::VARCHAR'}) = '') AS n_blank FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
    "profile_dups": "SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_repeats FROM documents",
    "profile_encoding": "SELECT count(*) FILTER (WHERE contains(text, chr(65533))) AS n_broken FROM documents",
    "text_snippet": "SELECT doc_id, replace(left(text, 120), chr(10), ' ') AS snippet FROM documents",
    "token_set": f"""SELECT doc_id, len({WORDS.format(e="text")})::INT AS n_words,
        array_to_string(list_sort(list_distinct(list_slice({split_words("lower(text)")}, 1, 50))), ' ') AS tokens FROM documents""",
    "word_count": f"SELECT doc_id, len({split_words('text')})::INT AS n FROM documents",
    "sentence_split": f"SELECT doc_id, i::INT AS pos, md5(s[i + 1]) AS digest FROM (SELECT doc_id, {sentences('text')} AS s FROM documents), unnest(range(len(s))) AS u(i)",
    "template_normalize": f"""SELECT doc_id, length(p)::INT AS n, md5(p) AS digest
        FROM (SELECT doc_id, {normalize("'12/03/2019 gün 2018/1234 sayılı m.141 ve Madde 5 ile 77 ' || text")} AS p FROM documents)""",
    "mine_boilerplate": f"""WITH each AS (SELECT doc_id, i AS pos, s[i + 1] AS sent, {normalize("s[i + 1]")} AS pattern
            FROM (SELECT doc_id, {sentences("text")} AS s FROM documents), unnest(range(len(s))) AS u(i)),
        fit AS (SELECT * FROM each WHERE len({split_words("sent")}) >= 4 AND len({split_words("pattern")}) >= 4)
        SELECT pattern, arg_min(sent, (doc_id, pos)) AS example, count(DISTINCT doc_id) AS doc_count,
            round(count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM documents), 4) AS doc_coverage, 'repetitive' AS category
        FROM fit GROUP BY pattern HAVING count(DISTINCT doc_id) >= 3 ORDER BY doc_count DESC, min((doc_id, pos)), pattern LIMIT 30""",
    "review_counts": "SELECT lang AS category, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY lang",
    "header_candidates": f"""WITH {PARTS} SELECT header, count(*) AS n FROM (SELECT unnest(CASE k WHEN 0 THEN ['OYAL', 'KANUN', 'KARAR', 'GEREKÇE']
        WHEN 1 THEN ['OLAYLAR', 'DEĞERLENDİRME', 'HÜKÜM'] WHEN 2 THEN ['DAVA VE KARAR'] WHEN 6 THEN ['KARAR']
        WHEN 8 THEN [({VARIANTS}).v] ELSE []::VARCHAR[] END) AS header FROM parts)
        GROUP BY header ORDER BY n DESC, header LIMIT 30""",
    "cue_coverage": f"""WITH {DECISIONS} SELECT cue, count(*) AS n_docs FROM decisions, unnest([{", ".join(f"'{c}'" for c in CUES)}]) AS u(cue)
        WHERE contains(lower(text), cue) GROUP BY cue""",
    "section_coverage": f"WITH {EXPECTED} SELECT section, count(DISTINCT doc) AS n_docs FROM sections GROUP BY section",
    "general_docs": f"WITH {EXPECTED} SELECT doc AS doc_id FROM sections GROUP BY doc HAVING bool_and(section = 'GENEL')",
    "stratified_sample": """SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
        WHERE p <= 6 ORDER BY vec_id LIMIT 60""",
    "sections": f"WITH {EXPECTED} SELECT doc, sec_ord, section, text FROM sections",
    "section_dist": f"WITH {CHUNKS} SELECT section, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM chunks), 6) AS pct FROM chunks GROUP BY section",
    "chunk_pack": f"""WITH c AS (SELECT doc_id, {clean("text")} AS t FROM documents), p AS (SELECT doc_id, {pack("t", 300, 30)} AS p FROM c)
        SELECT doc_id, i::INT AS piece_ord, length(p[i + 1])::INT AS n, md5(p[i + 1]) AS digest FROM p, unnest(range(len(p))) AS u(i)""",
    "chunk_policy": f"WITH {CHUNKS} SELECT * FROM chunks",
    "chunk_dedup_ids": f"WITH {CHUNK_TABLE} SELECT * FROM chunk_table",
    "chunk_metrics": f"""WITH {CHUNK_TABLE} SELECT count(*) AS n_chunks, count(*) FILTER (WHERE is_atomic) AS n_atomic, count(*) FILTER (WHERE NOT is_atomic) AS n_split,
        round(count(*) / (SELECT count(*) FROM decisions), 6) AS per_doc, min(length)::BIGINT AS min_len, max(length)::BIGINT AS max_len,
        round(avg(length), 6) AS mean_len, round(stddev_samp(length), 6) AS std_len FROM chunk_table""",
    "chunk_invariants": """WITH c AS (SELECT CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END AS chunk_id,
            CASE WHEN doc_id % 70 = 0 THEN ' ' ELSE text END AS text, ['OYAL', 'KANUN', 'KARAR', 'GEREKÇE', 'GENEL', 'BAŞKA'][doc_id % 6 + 1] AS section,
            length(text) + (CASE WHEN doc_id % 90 = 0 THEN 1 ELSE 0 END) AS length, doc_id % 4 = 0 AS is_atomic FROM documents)
        SELECT chunk_id, 'empty text' AS rule FROM c WHERE trim(text) = '' OR regexp_full_match(text, '\\s*')
        UNION ALL SELECT chunk_id, 'invalid section' FROM c WHERE section = 'BAŞKA'
        UNION ALL SELECT chunk_id, 'length differs' FROM c WHERE length <> length(text)
        UNION ALL SELECT chunk_id, 'atomic in another section' FROM c WHERE is_atomic AND section NOT IN ('KANUN', 'KARAR')
        UNION ALL SELECT chunk_id, 'atomic too long' FROM c WHERE is_atomic AND length > 4000
        UNION ALL SELECT chunk_id, 'split too long' FROM c WHERE NOT is_atomic AND length > 1000
        UNION ALL SELECT chunk_id, 'duplicate chunk_id' FROM (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id) AS r FROM c) WHERE r > 1""",
    "general_rate": f"""WITH {CHUNKS} SELECT count(*) AS n_docs, count(*) FILTER (WHERE g) AS n_general, round(100.0 * count(*) FILTER (WHERE g) / count(*), 6) AS pct
        FROM (SELECT doc, bool_and(section = 'GENEL') AS g FROM chunks GROUP BY doc)""",
    "word_coverage": f"""WITH {CHUNKS}, own AS (SELECT doc, list_distinct(flatten(list({WORDS.format(e="text")}))) AS w FROM chunks GROUP BY doc),
        o AS (SELECT doc_id AS doc, {WORDS.format(e="text")} AS t FROM decisions)
        SELECT doc, len(t) AS n_words, len(list_intersect(t, coalesce(w, []))) AS n_covered, round(len(list_intersect(t, coalesce(w, []))) / len(t), 6) AS coverage
        FROM o LEFT JOIN own USING (doc) WHERE len(t) > 0""",
    "chunk_overlap": f"""WITH {CHUNKS}, p AS (SELECT doc, section, text, lead(text) OVER (PARTITION BY doc, sec_ord ORDER BY piece_ord) AS nxt FROM chunks WHERE NOT is_atomic)
        SELECT doc, section, count(*) AS n_pairs, count(*) FILTER (WHERE len(list_filter(range(greatest(0, length(left(nxt, 200)) - 14)),
            lambda i: contains(right(text, 200), substr(left(nxt, 200), (i + 1)::INT, 15)))) > 0) AS n_overlap FROM p WHERE nxt IS NOT NULL GROUP BY doc, section""",
    "knn_l2": f"""WITH {VECTORS} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id))::INT AS rank, chunk_id,
        round(distance, 6) AS distance FROM near QUALIFY rank <= 10""",
    "knn_all": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
        round(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))), 12) AS distance FROM v q, v c)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id))::INT AS rank, chunk_id, round(distance, 6) AS distance FROM near QUALIFY rank <= 3""",
    "index_search": f"""WITH {VECTORS} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id))::INT AS rank, chunk_id,
        round(distance, 6) AS distance FROM near QUALIFY rank <= 10""",
    "search_plain": f"WITH {VECTORS}, {CORPUS}, {searched(5, False)} {HITS}",
    "search_rerank": f"WITH {VECTORS}, {CORPUS}, {searched(7, True)} {HITS}",
    "intra_coherence": f"WITH {VECTORS}, {COHERENCE} SELECT * FROM coherence",
    "coherence_summary": f"""WITH {VECTORS}, {COHERENCE} SELECT count(*) AS n_groups, round(avg(coherence), 6) AS mean_coherence, round(median(coherence), 6) AS median_coherence,
        round(quantile_cont(coherence, 0.1), 6) AS p10_coherence, round(avg((coherence < 0.2)::INT), 6) AS incoherent_share FROM coherence WHERE coherence IS NOT NULL""",
    "within_section": f"""WITH {VECTORS}, {CORPUS}, {UNITS.format(t="corpus")} SELECT a.section, (SELECT count(*) FROM corpus c WHERE c.section = a.section) AS n,
        round(avg(list_inner_product(a.w, b.w)), 6) AS within FROM u a JOIN u b ON a.section = b.section AND a.chunk_id < b.chunk_id GROUP BY a.section""",
    "separability": f"""WITH {VECTORS}, {CORPUS}, {UNITS.format(t="corpus")}, p AS (SELECT a.section = b.section AS same, list_inner_product(a.w, b.w) AS s FROM u a JOIN u b ON a.chunk_id < b.chunk_id)
        SELECT round(avg(s) FILTER (WHERE same), 6) AS mean_within, round(avg(s) FILTER (WHERE NOT same), 6) AS mean_cross,
            round(avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same), 6) AS margin FROM p""",
    "redundancy": f"""WITH {VECTORS}, {CORPUS}, {UNITS.format(t="corpus")}, best AS (SELECT a.chunk_id, a.original_doc_id AS d, b.original_doc_id AS o, list_inner_product(a.w, b.w) AS s
            FROM u a JOIN u b ON a.chunk_id <> b.chunk_id QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(s, 9) DESC, b.chunk_id) = 1)
        SELECT count(*) AS n_probes, count(*) FILTER (WHERE round(s, 9) >= 0.5 AND d <> o) AS n_redundant,
            round(count(*) FILTER (WHERE round(s, 9) >= 0.5 AND d <> o) / count(*), 6) AS rate FROM best""",
    "index_stats": """SELECT count(*) AS total_chunks, max(len(embedding))::INT AS dimension, 'sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2' AS model,
        true AS normalized, '2025-01-01' AS date FROM embeddings""",
    "bench_parse": f"""SELECT item_id, {strip("text")} AS query, CASE WHEN item_id % 7 = 2 THEN '' ELSE array_to_string(list_filter(
            list_transform(string_split('Alpha, ,BETA | c,' || text, ','), lambda k: lower({strip("k")})), lambda k: k <> ''), ';') END AS keywords
        FROM benchmark WHERE item_id % 7 >= 2""",
    "bench_relevance": f"WITH {VECTORS}, {CORPUS}, {searched(5, True)} SELECT query_id, rank, chunk_id, {RELEVANT} AS relevant FROM found",
    "bench_precision": f"WITH {VECTORS}, {CORPUS}, {searched(5, True)}, {PRECISION.format(name='p', hits='found')} SELECT * FROM p",
    "bench_report": f"""WITH {VECTORS}, {CORPUS}, {searched(5, True)}, {searched(5, False, "plain")}, {PRECISION.format(name="p", hits="found")},
        {PRECISION.format(name="q", hits="plain").split(",", 1)[1]}
        SELECT total_queries, round(a, 3) AS accuracy, round(b, 3) AS accuracy_no_rerank, round(a - b, 3) AS rerank_delta, round(1 - a, 3) AS false_positive_rate,
            round(s, 3) AS avg_similarity FROM (SELECT count(*) AS total_queries, avg(accuracy) AS a FROM p), (SELECT avg(accuracy) AS b FROM q),
            (SELECT avg(similarity_score) AS s FROM found)""",
}
LETTERS = lambda e: "[" + ", ".join(f"(length({e}) - length(replace({e}, '{c}', '')))::DOUBLE" for c in "aeinorst") + "]"
ORACLE_SQL |= {
    "profile_sample": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 50",
    "sample_strata": """SELECT vec_id, label FROM (SELECT vec_id, label, md5('42:' || vec_id::VARCHAR) AS o,
        row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) AS p FROM embeddings) WHERE p <= 6 ORDER BY o, vec_id LIMIT 60""",
    "csv_round_trip": "SELECT doc_id::VARCHAR AS id, source, md5(text) AS digest FROM documents",
    "csv_decisions": "SELECT doc_id::VARCHAR AS id, source, length(text)::INT AS n FROM documents",
    "npy_round_trip": """SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row, vec_id, len(embedding)::INT AS width,
        list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT))::BIGINT AS total FROM embeddings WHERE embedding IS NOT NULL""",
    "pattern_round_trip": f"SELECT pattern, doc_count, {len(SEEDS)}::INT AS n_seeds, 0::INT AS n_missing FROM ({ORACLE_SQL['mine_boilerplate']})",
    "stage_outputs": f"WITH {VECTORS}, {CORPUS} SELECT chunk_id, section, len(e)::INT AS width, 2::INT AS times_made FROM corpus",
    "dataset_metrics": """SELECT count(*) AS n_rows, sum(strlen(text))::BIGINT AS n_bytes, round(sum(strlen(text)) / 1e6, 3)::DOUBLE AS megabytes FROM documents""",
    "passage_prefix": "SELECT doc_id, md5('passage: ' || text) AS digest FROM documents",
    "model_widths": """SELECT model, width, (SELECT count(*) FROM benchmark WHERE text IS NOT NULL) AS n_texts FROM (VALUES ('intfloat/multilingual-e5-large', 1024::INT),
        ('e5-base-v2', 768::INT), ('E5-Small', 384::INT), ('all-mpnet-base-v2', 768::INT), ('sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2', 384::INT),
        ('other', 384::INT)) t(model, width)""",
    "query_vectors": f"""WITH q AS (SELECT item_id AS query_id, {LETTERS("lower('query: ' || text)")} AS e FROM benchmark), d AS (SELECT doc_id AS chunk_id, {LETTERS("lower(text)")} AS e FROM documents)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id))::INT AS rank, chunk_id, distance FROM (SELECT query_id, chunk_id,
            list_sum(list_transform(range(1, 9), lambda i: (q.e[i] - d.e[i]) * (q.e[i] - d.e[i]))) AS distance FROM q, d) QUALIFY rank <= 3""",
    "chunk_coherence": f"""WITH s AS (SELECT doc_id AS chunk_id, {sentences("text")} AS s FROM documents WHERE doc_id % 4 <> 0),
        each AS (SELECT chunk_id, i, {LETTERS("lower(s[i + 1])")} AS e FROM s, unnest(range(len(s))) AS u(i) WHERE len(s) >= 2),
        units AS (SELECT chunk_id, i, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-8)) AS w FROM each)
        SELECT a.chunk_id, (SELECT len(s) FROM s WHERE s.chunk_id = a.chunk_id) AS n, round(avg(list_inner_product(a.w, b.w)), 6) AS coherence
        FROM units a JOIN units b ON a.chunk_id = b.chunk_id AND a.i < b.i GROUP BY a.chunk_id""",
    "stream_clean": f"WITH cleaned AS (SELECT {clean('text')} AS text FROM documents) SELECT DISTINCT md5({fold('text')}) AS digest FROM cleaned WHERE length(text) >= 100",
    "stream_index": f"WITH {CLEANED} SELECT doc_id AS chunk_id, list_transform({LETTERS('lower(text)')}, lambda x: x::INT) AS embedding FROM kept",
    "preconditions": """SELECT 'documents' AS input, true AS found, count(*) AS n_rows FROM documents UNION ALL SELECT 'embeddings', true, count(*) FROM embeddings
        UNION ALL SELECT 'benchmark', true, count(*) FROM benchmark UNION ALL SELECT 'no_such_table', false, 0""",
    "settings_from_env": f"""WITH cleaned AS (SELECT doc_id, lang, {clean("text")} AS text FROM documents), once AS (SELECT * FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1), settings AS (SELECT * FROM (VALUES ('9', 'True', '0.5', '1000', '1200', '1024', 'query: '),
        ('5', 'False', '0.35', '1000', '100', '384', '')) t(top_k, use_section_rerank, benchmark_rel_threshold, chunk_size, min_text_chars, embedding_dim, query_prefix))
        SELECT lang, count(*) AS n_kept, top_k, use_section_rerank, benchmark_rel_threshold, chunk_size, min_text_chars, embedding_dim, query_prefix
        FROM once, settings WHERE length(text) >= min_text_chars::INT GROUP BY ALL""",
    "service_answers": """SELECT * FROM (VALUES (0::INT, 'GET', '/health', 200::INT, 200::INT, 0::INT), (1, 'GET', '/stats', 200, 503, 0), (2, 'POST', '/search', 200, 503, 3),
        (3, 'POST', '/search', 400, 503, 0), (4, 'POST', '/search', 400, 503, 0), (5, 'POST', '/search', 400, 503, 0), (6, 'GET', '/search', 404, 404, 0),
        (7, 'POST', '/other', 404, 404, 0)) t(n, method, path, status, status_without, n_results)""",
    "model_embedder": f"""SELECT doc_id, list_transform({LETTERS("lower('passage: ' || text)")}, lambda x: x::INT) AS embedding FROM documents""",
    "bench_nested": f"""WITH {VECTORS}, {CORPUS}, {searched(5, True)}, {PRECISION.format(name='p', hits='found')}
        SELECT f.query_id, p.num_results, round(p.accuracy, 3) AS accuracy, f.rank, f.chunk_id, md5(replace(left(f.text, 200), chr(10), ' ')) AS digest,
            f.similarity_score AS similarity, {RELEVANT.replace("query_id", "f.query_id").replace("lower(text)", "lower(f.text)")} AS relevant FROM found f JOIN p USING (query_id)""",
    "knn_diversify": f"""WITH {VECTORS}, {CORPUS}, {searched(60, False)},
        listed AS (SELECT query_id, list({{'rank': rank, 'chunk_id': chunk_id, 'doc': original_doc_id, 'similarity_score': similarity_score, 'section': section,
            't': list_distinct(list_slice({split_words("lower(text)")}, 1, 50))}} ORDER BY rank) AS hits FROM found GROUP BY query_id),
        kept AS (SELECT query_id, list_reduce(list_transform(hits, lambda h: [h]), lambda a, x: CASE WHEN len(a) >= 5
            OR len(list_filter(a, lambda y: y.doc = x[1].doc OR CASE WHEN len(y.t) = 0 OR len(x[1].t) = 0 THEN false
                ELSE len(list_intersect(y.t, x[1].t)) / (len(y.t) + len(x[1].t) - len(list_intersect(y.t, x[1].t))) >= 0.6 END)) > 0
            THEN a ELSE list_concat(a, x) END) AS k FROM listed)
        SELECT query_id, (i + 1)::INT AS place, k[i + 1].chunk_id AS chunk_id, k[i + 1].doc AS original_doc_id, k[i + 1].similarity_score AS similarity_score,
            k[i + 1].section AS section FROM kept, unnest(range(len(k))) AS u(i)""",
}
ORACLE_SQL["coverage_summary"] = f"""SELECT count(*) AS n_docs, round(avg(coverage), 6) AS mean_coverage, min(coverage) AS worst_coverage
    FROM ({ORACLE_SQL["word_coverage"]})"""
