import time

from docloom.functions import text as tx
from docloom.operators import patterns as pt
from pyspark.sql import functions as F


def values(spark, rows, column):
    return [r.v for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column(F.col("t")).alias("v")).collect()]


def test_clean_text(spark):
    cases = {
        None: "",
        "": "",
        "MAHKEMESİ : Ankara\nmetin **kalın** devam": "metin kalın devam",
        "  esas no: 5\nasıl metin": "asıl metin",
        "Taraflar arasındaki dava tek satır": "",
        '"İçtihat Metni" karar': "karar",
        "a. . b... c": "a. b. c",
        "x \x1cy\n\n z": "x y z",
        "taraflarca kabul": "taraflarca kabul",
    }
    assert values(spark, cases, tx.clean_text) == list(cases.values())
    assert values(spark, ["a bir b", "BİR c"], lambda c: tx.clean_text(c, ["(?iU)bir"])) == ["a b", "c"]


def test_sentences_and_words(spark):
    assert values(spark, ["A. B!  C? d… e", " . ", None, "no end"], tx.sentences) == [["A.", "B!", "C?", "d…", "e"], ["."], [], ["no end"]]
    assert values(spark, ["Şey şey x_1 x-1", ""], lambda c: F.array_sort(tx.words(c))) == [["1", "x", "x_1", "şey"], []]
    assert values(spark, ["a  b\nc", "", None], tx.word_count) == [3, 0, 0]


def test_templates(spark):
    cases = {
        " 12/03/2019 günü 2018/1234 sayılı m.141 ve MADDE 5, 77 ": "<DATE> günü <NO> sayılı <MADDE> ve <MADDE>, <NUM>",
        "Straße 1-2-2020": "strasse <DATE>",
        "abc12 x": "abc12 x",
    }
    assert values(spark, cases, tx.normalize_template) == list(cases.values())
    assert [pt.normalize(c) for c in cases] == list(cases.values())


def test_strip_takes_all_white_space_and_looks_at_the_ends_only(spark):
    assert values(spark, [f"{tx.SPACES}a b{tx.SPACES}", tx.SPACES, "", None], tx.strip) == ["a b", "", "", None]
    long = "a" + " " * 300_000 + "b"  # as a pattern of a run before the end this took time with the square of the run
    began = time.monotonic()
    assert values(spark, [long], lambda c: F.length(tx.strip(c))) == [len(long)]
    assert time.monotonic() - began < 20


def test_fold_takes_dotted_capital_i_for_i(spark):
    cases = {"MADDİ OLAY": "maddi olay", "MADDI OLAY": "maddi olay", "İIıi": "iiıi", "ẞ Σας": "ss σασ"}
    assert values(spark, cases, tx.fold) == list(cases.values())
    assert values(spark, ["BİR İKİ"], tx.normalize_template) == [pt.normalize("BİR İKİ")] == ["bir iki"]


def test_template_regex_round_trip(spark):
    sentence = "Dosya 12/03/2019 günü (2018/1234) m.141 gereği 5 gün sonra..."
    regex = pt.template_regex(pt.normalize(sentence))
    assert pt.template_regex("  ") is None
    got = values(spark, [f"önce {sentence.upper()} sonra", "başka"], lambda c: F.trim(tx.collapse(F.regexp_replace(c, F.lit(regex), F.lit(" ")))))
    assert got == ["önce sonra", "başka"]


def test_pattern_selection():
    found = pt.pattern_file(
        [{"pattern": "mined <NUM>"}],
        [{"chunk_id": 1, "is_boilerplate": True, "first_sentence": ["Onay verildi."]}, {"chunk_id": 2, "is_boilerplate": False, "first_sentence": ["x"]}],
        {"min_docs": 3},
        {"reviewed": [{"chunk_id": 3, "is_boilerplate": True, "first_sentence": ["Eski onay."]}]},
    )
    found["seed_patterns"] += [{"regex": "(broken"}, {"regex": "x*"}, {"regex": ""}]
    plain, mined = pt.select_patterns(found), pt.select_patterns(found, mined=True)
    assert len(plain) == len(pt.SEEDS) + 2 and len(mined) == len(plain) + 1
    assert len(found["reviewed"]) == 3  # earlier reviews are kept
    assert pt.select_patterns({}) == []


def test_cleaning_takes_the_artefact_in_any_case_and_every_run_of_spaces(spark):
    texts = ["a \t b\u00a0c  d", 'x "İçtihat  Metni" y', "x ıÇTİHAT\tmetnı y", "çtihat metni", "a . .\n. b", "ç t", None]
    assert values(spark, texts, tx.clean_text) == ["a b c d", "x y", "x y", "çtihat metni", "a . b", "ç t", ""]
