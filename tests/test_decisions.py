import pytest
from docloom.config import EngineConfig, model_width
from docloom.operators.chunking import chunk_decisions, chunk_stats, chunk_table, pack, share_of
from docloom.operators.sections import extract_sections
from docloom.operators.validate import check_invariants, chunk_overlap, general_rate, word_coverage
from docloom.plans.batch import InvalidChunks, check
from pyspark.sql import functions as F

LONG = "Toplanan bütün deliller birlikte değerlendirilmiş. " * 40
CASES = [
    ("OYAL: davacı dava açtı. KANUN: madde 5 uyarınca. KARAR: istem kabul edildi. GEREKÇE: deliller yeterli.", ["OYAL", "KANUN", "KARAR", "GEREKÇE"]),
    ("OLAYLAR: olay oldu. DEĞERLENDİRME: konu incelendi. HÜKÜM: istem reddedildi.", ["OYAL", "GEREKÇE", "KARAR"]),
    ("Başlık taşımayan düz bir metin.", ["GENEL"]),
    ("OYAL: taraf hakkında karar verildi ve dosya kapandı.", ["OYAL"]),
    ("Davacı alacak istedi. Gereği görüşülüp düşünüldü; istem yerinde bulundu.", ["OYAL", "GEREKÇE"]),
    ("Davacı alacak istedi. Dosya okundu. İstemin reddine karar verilmiştir.", ["OYAL", "KARAR"]),
    ("GEREKÇE: " + LONG, ["GEREKÇE"]),
    ("KANUN: " + LONG, ["KANUN"]),
    ("Dava konusu taşınmaz satıldı", ["OYAL"]),
    ("DAVACI taraf geldi", ["GENEL"]),
    ("OYAL:bitişik yazım", ["OYAL"]),
    ("onanmasına", ["KARAR"]),
    ("İstemin reddine karar verildi. " + "Sonrasında başka bir işlem yapılmadı ve dosya kaldırıldı. " * 10, ["GENEL"]),
    ("DAVA VE KARAR: metin burada. SONUÇ son söz", ["OYAL", "KARAR"]),
    ("", []),
    (None, []),
    ("  \n", []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").cache()


def test_sections(docs):
    got = {r.doc_id: [s.section for s in r.sections] for r in extract_sections(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_section_texts(docs):
    got = {r.doc_id: {s.section: s.text for s in r.sections} for r in extract_sections(docs).collect()}
    assert got[4] == {"OYAL": "Davacı alacak istedi.", "GEREKÇE": "; istem yerinde bulundu."}
    assert got[5]["KARAR"] == "İstemin reddine karar verilmiştir."
    assert got[13] == {"OYAL": "DAVA VE", "KARAR": "KARAR: metin burada. SONUÇ son söz"}


def loop_pack(sents, size, overlap):
    out, cur = [], ""
    for s in sents:
        if len(cur) + len(s) + 1 <= size:
            cur = (cur + " " + s).strip()
            continue
        if cur:
            out.append(cur)
        cur = ((cur[len(cur) - overlap :] if overlap < len(cur) else cur) * bool(overlap) + " " + s).strip()
        while len(cur) > size:
            out.append(cur[:size])
            cur = cur[size - overlap :]
    return out + [cur] * bool(cur)


@pytest.mark.parametrize("size, overlap", [(40, 0), (40, 10), (40, 39), (1000, 100)])
def test_pack(spark, size, overlap):
    texts = ["Kısa. " * 30, "a" * 333, "Bir iki üç. " + "b" * 95 + ". Son.", "tek cümle", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(pack(F.col("t"), size, overlap).alias("p")).collect()
    import re

    for r, t in zip(got, texts, strict=True):
        sents = [s for s in (x.strip() for x in re.split(r"(?<=[.!?…])\s+", t.strip())) if s]
        assert r.p == ([t.strip()] if len(t.strip()) <= size and t.strip() else loop_pack(sents, size, overlap))


def test_policy(docs):
    config = EngineConfig()
    chunks = chunk_decisions(docs, config).collect()
    of = lambda i: [c for c in chunks if c.doc == i]
    assert len(of(7)) == 1 and of(7)[0].is_atomic and len(of(6)) > 1 and not any(c.is_atomic for c in of(6))
    small = chunk_decisions(docs, EngineConfig(max_atomic_chars=500)).filter("doc = 7").collect()
    assert len(small) > 1 and not any(c.is_atomic for c in small)
    assert all(c.is_atomic or len(c.text) >= 30 for c in chunks)
    (row,) = chunk_overlap(chunk_decisions(docs, config), config).filter("doc = 6").collect()
    assert row.n_pairs == len(of(6)) - 1 == row.n_overlap


def test_chunk_copies_differ_by_the_dot_of_a_capital_i(spark):
    rows = [(1, "MADDİ OLAY: taraflar arasında alacak vardır."), (2, "MADDI OLAY: taraflar arasında alacak vardır.")]
    (row,) = chunk_table(spark.createDataFrame(rows, "doc_id long, text string"), EngineConfig()).collect()
    assert (row.chunk_id, row.original_doc_id) == (0, "1")


def test_chunk_stats_count_such_copies_once(spark):
    rows = [(i, f"MADD{c} OLAY: taraflar arasında alacak vardır.") for i, c in enumerate("İIİ")]
    table = chunk_table(spark.createDataFrame(rows, "doc_id long, text string"), EngineConfig())
    (row,) = chunk_stats(table, 3).collect()
    assert (row.n_chunks, row.n_split, row.per_doc) == (1, 1, 0.333333)


def test_shares_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def value(i):
        made.add(1)
        return "ab"[i % 2]

    rows = spark.range(10, numPartitions=1).select(value("id").alias("v"))
    assert sorted(share_of(rows, "v").collect()) == [("a", 5, 50.0), ("b", 5, 50.0)] and made.value == 10
    assert share_of(rows.limit(0), "v").collect() == []


def test_chunk_table_and_checks(spark, docs):
    config = EngineConfig()
    twice = docs.unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), F.translate("text", "metin", "METiN").alias("text")))
    table = chunk_table(twice.filter("doc_id % 100 = 2"), config)
    assert [(r.chunk_id, r.original_doc_id) for r in table.collect()] == [(0, "2")]  # case-only copies fall to the first
    table = chunk_table(docs, config)
    rows = table.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows))) and check_invariants(table, config).count() == 0
    assert [int(r.original_doc_id) for r in rows] == sorted(int(r.original_doc_id) for r in rows)
    check(table, config)
    with pytest.raises(InvalidChunks):
        check(table.withColumn("length", F.col("length") + 1), config)
    assert general_rate(table).first().n_general > 0
    assert word_coverage(docs, EngineConfig(min_chunk_chars=1)).filter("coverage < 0.75 AND doc <> 4").count() == 0  # document 4 loses its transition phrase


def test_config():
    with pytest.raises(ValueError):
        EngineConfig(chunk_size=100, chunk_overlap=100)
    c = EngineConfig.from_env({"TOP_K": "9", "DEDUP_CHUNKS": "0", "ST_MODEL_NAME": "intfloat/multilingual-e5-large"})
    assert (c.top_k, c.dedup_chunks, c.embedding_dim, c.query_prefix) == (9, False, 1024, "query: ")
    assert model_width("unknown") == 384 and c.section_weight("KARAR") == 2.0 and c.section_weight("?") == 1.0


def test_pieces_in_the_row_are_the_chunks(spark):
    from docloom.operators.chunking import chunk_decisions, with_pieces

    long = " ".join(f"Sentence {i} of a text that is long enough to be cut." for i in range(60))
    texts = ["OYAL: " + long + " KARAR: " + long[:300] + " GEREKÇE: x.", "KARAR: " + long * 3, "", None, " . ", long, "zz " + long[:90] + " reddine karar verilmiştir."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    config = EngineConfig(chunk_size=200, chunk_overlap=20)
    want: dict = {i: [] for i in range(len(texts))}
    for r in chunk_decisions(docs, config).orderBy("doc", "sec_ord", "piece_ord").collect():
        want[r.doc].append(r.text)
    assert {r.doc: r.pieces or [] for r in with_pieces(docs, config).collect()} == want


def test_single_and_null_ids_are_covered_in_place(spark, tmp_path):
    from docloom.operators.validate import word_coverage

    spark.createDataFrame([(i, f"KARAR: some words of text number {i} here.") for i in range(20)] + [(None, "no id")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {r.doc: (r.n_words, r.n_covered) for r in word_coverage(spark.read.parquet(str(tmp_path / "d")), EngineConfig()).collect()}
    assert found == {i: (8, 8) for i in range(20)} | {None: (2, 0)}
