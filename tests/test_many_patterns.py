import random

from docloom.functions.text import clean_text, search_fold
from docloom.operators import cleaning
from docloom.operators.patterns import FLAGS, SEEDS, normalize, required_word, template_regex
from pyspark.sql import functions as F

ODD = ["İki", "ıki", "İKİ", "straße", "STRASSE", "STRAẞE", "ΟΔΟΣ", "οδος", "οδοσ", "Kelvin", "kelvin", "ſache", "SACHE", "a.b*c", "(x)", "x-y", "dava|cı", "ᾳ", "ᾼ"]


def sentence(rng):
    words = [rng.choice(ODD + [f"w{rng.randrange(40)}", f"Word{rng.randrange(60)}", str(rng.randrange(99)), "12.03.2019", "2018/77", "madde 5"]) for _ in range(rng.randrange(4, 8))]
    return " ".join(words)


def test_required_words():
    assert required_word(template_regex("the <NUM> longest one.")) == "longest"
    assert required_word(template_regex("a.b*c <DATE>x <MADDE>")) == "a.b*c"
    assert required_word(template_regex("<NUM> <DATE>")) is None
    assert required_word("longest word") is None  # it regards case
    assert required_word(FLAGS + "longer|word") is None and required_word(FLAGS + r"wor(ds)?\s+ab") is None
    assert all(required_word(FLAGS + regex) is None or "(" not in regex for _, regex, _ in SEEDS)


def test_500_patterns_equal_the_chain(spark):
    rng = random.Random(9)
    known = [sentence(rng) for _ in range(484)]
    patterns = [FLAGS + regex for _, regex, _ in SEEDS] + [template_regex(normalize(s)) for s in known]
    assert len(patterns) == 500 and sum(required_word(p) is None for p in patterns) < 40
    swap = lambda s: rng.choice([s, s.upper(), s.lower(), s.replace(" ", "  "), s.replace("9", "4")])
    rows = [(i, " ".join(swap(rng.choice(known)) if rng.random() < 0.6 else sentence(rng) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    # a template that only stands together once another one is gone
    rows += [(900, known[0].split()[0] + " " + known[1] + " " + " ".join(known[0].split()[1:])), (901, None), (902, ""), (903, " ".join(known))]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.text for r in cleaning.clean(docs, patterns).collect()}
    # the chain: every pattern in turn
    places = F.sequence(F.lit(0), F.lit(len(patterns) - 1))
    want = {r.id: r.text for r in docs.select("id", clean_text(F.col("text"), patterns, places).alias("text")).collect()}
    assert got == want
    few = patterns[16:26]
    short = {r.id: r.text for r in cleaning.clean(docs, few, most=0).collect()}
    assert short == {r.id: r.text for r in cleaning.clean(docs, few).collect()}


def test_what_a_regex_takes_for_equal_is_folded_alike(spark):
    chars = [chr(c) for c in range(0x20, 0x2100) if chr(c).upper() != chr(c) or chr(c).lower() != chr(c)]
    groups: dict = {}
    for c in chars:
        groups.setdefault(c.upper().lower(), []).append(c)
    pairs = [(a, b) for g in groups.values() for a in g for b in g if a < b]
    frame = spark.createDataFrame(pairs, "a string, b string").filter(F.rlike("a", F.concat(F.lit("(?iU)^"), F.col("b"), F.lit("$"))))
    assert frame.count() > 500 and frame.filter(search_fold(F.col("a")) != search_fold(F.col("b"))).collect() == []
