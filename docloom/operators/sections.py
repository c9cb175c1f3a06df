"""Sections of a decision: headers, cues and position, and the ruling at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FACTS, GENERAL, LAW, REASONS, RULING
from ..functions.lineage import unused
from ..functions.text import bind, strip, text_of
from ..schemas import SECTION_LIST

#: Header variants of each section.
HEADERS = {
    FACTS: (
        "OLAYLAR", "OLAY", "OYAL", "MADDİ OLAY", "MADDI OLAY", "VAKIALAR",
        "DAVA", "DAVA TÜRÜ", "İDDİA", "İSTEM", "DAVA VE KARAR",
    ),
    LAW: (
        "KANUN", "İLGİLİ KANUN", "ILGILI KANUN", "YASAL DAYANAK",
        "İLGİLİ MEVZUAT", "ILGILI MEVZUAT", "KANUN MADDESİ", "MEVZUAT",
    ),
    RULING: (
        "KARAR", "HÜKÜM", "HÜKÜMLER", "HUKUM", "SONUÇ", "SONUC",
        "HÜKÜM VE SONUÇ", "SONUÇ VE KARAR",
    ),
    REASONS: (
        "GEREKÇE", "GEREKCE", "GEREKÇESİ", "DEĞERLENDİRME", "DEGERLENDIRME",
        "İNCELEME", "GEREĞİ GÖRÜŞÜLÜP DÜŞÜNÜLDÜ", "GEREĞİ DÜŞÜNÜLDÜ",
        "GEREĞİ GÖRÜŞÜLDÜ",
    ),
}
#: The phrase between facts and reasons, and the words of a decree.
TRANSITION = (
    r"(?iU)gere[ğg]i\s+(?:g[öo]r[üu][şs][üu]l[üu]p\s+)?(?:d[üu][şs][üu]n[üu]ld[üu]|g[öo]r[üu][şs][üu]ld[üu])"
)
#: A match's first letter in every case is looked for before anything else.
DECREE = (
    r"(?=[obkrtiehOBKRTIEH\u0130\u0131\u212a])(?iU)(onanmasına|bozulmasına|bozularak|kabul[üu]ne|reddine|tesciline|tahliyesine|iptaline|oybirli[ğg]iyle"
    r"|oy\s*ço[ğg]unlu[ğg]uyla|esastan\s+red|hükm[üu]n\s+(?:onan|bozul))"
)
HEAD_CHARS = 48
TERSE_CHARS, TERSE_TAIL = 400, 160

VARIANTS = sorted(((v, s) for s, names in HEADERS.items() for v in names), key=lambda x: -len(x[0]))
#: The variants are letters and spaces, so they stand in a pattern as they are.
#: Their first letters are looked for before anything else.
MARKER = rf"(?U)(?=[{''.join(sorted({v[0] for v, _ in VARIANTS}))}])(?=\b(?:{'|'.join(v for v, _ in VARIANTS)})\s*[:\-]?\s)"


def _section(name: Column | str, text: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("section"), text.alias("text"))


def header_of(fragment: Column) -> Column:
    """Section whose longest header variant begins the fragment and is no part of a longer word; else null."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in VARIANTS])

    def best(head: Column) -> Column:
        after = lambda x: F.substring(head, F.length(x["v"]) + 1, F.lit(1))
        return F.get(F.filter(table, lambda x: F.startswith(head, x["v"]) & ~after(x).rlike(r"^\p{L}")), 0)["s"]

    return bind(F.upper(F.left(fragment, F.lit(HEAD_CHARS))), best)


def header_sections(text: Column) -> Column:
    """Sections by upper-case headers, in order of first appearance; an empty array where no header is found.

    Fragments of one section are joined; a fragment without header counts as facts at the
    beginning and as general after it.
    """
    fragments = F.filter(F.transform(F.split(text, MARKER), strip), lambda x: x != "")
    named = F.transform(fragments, lambda f: F.struct(header_of(f).alias("name"), f.alias("text")))

    def add(found: Column, f: Column) -> Column:
        return bind(F.coalesce(f["name"], F.when(F.size(found) == 0, FACTS).otherwise(GENERAL)), lambda n: place(found, f, n))

    def place(found: Column, f: Column, name: Column) -> Column:
        joined = F.transform(
            found, lambda s: F.when(s["section"] == name, _section(name, F.concat(s["text"], F.lit(" "), f["text"]))).otherwise(s)
        )
        known = F.exists(found, lambda s: s["section"] == name)
        return F.when(known, joined).otherwise(F.concat(found, F.array(_section(name, f["text"]))))

    start = F.array().cast(SECTION_LIST)
    matched = lambda names: F.exists(names, lambda f: f["name"].isNotNull())
    return bind(named, lambda names: F.when(matched(names), F.aggregate(names, start, add)).otherwise(start))


def ruling_start(text: Column) -> Column:
    """Where the sentence of the ruling begins: 0-based offset, 0 without a period before it, null without a decree.

    The decree is the first in the second half of the text, else the last one.
    """
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("end"))

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, DECREE, -1), F.length)
        each = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        starts = F.aggregate(
            each,
            begin,
            lambda acc, x: F.struct(
                F.concat(acc["starts"], F.array(acc["end"] + x["gap"])).alias("starts"),
                (acc["end"] + x["gap"] + x["hit"]).alias("end"),
            ),
            lambda acc: acc["starts"],
        )
        # a text without a decree is gone through once
        return F.when(F.size(hits) > 0, starts).otherwise(F.array().cast("array<int>"))

    starts = bind(F.transform(F.regexp_extract_all(text, F.lit(DECREE), F.lit(0)), F.length), placed)
    half = F.floor(F.length(text) / 2)
    first = lambda found: F.coalesce(F.get(F.filter(found, lambda x: x >= half), 0), F.get(found, F.size(found) - 1))

    def after_period(place: Column) -> Column:
        back = lambda r: F.when(place.isNull(), None).when(r == 0, 0).otherwise(place - r + 1)
        return bind(F.instr(F.reverse(F.left(text, place)), "."), back)

    return bind(bind(starts, first), after_period)


def cue_sections(text: Column, ruling: Column) -> Column:
    """Sections of a text without headers, by the transition phrase or the ruling's place (``ruling_start``)."""
    whole = F.array(_section(GENERAL, strip(text)))

    def around(at: Column) -> Column:
        facts, rest = strip(F.left(text, at["place"] - 1)), F.substring(text, at["place"] + F.length(at["phrase"]), F.length(text))
        parted = F.filter(F.array(_section(FACTS, facts), _section(REASONS, strip(rest))), lambda s: s["text"] != "")
        return bind(parted, lambda p: F.when(F.size(p) > 0, p).otherwise(whole))

    def by_ruling(start: Column) -> Column:
        front, tail = strip(F.left(text, start)), strip(F.substring(text, start + 1, F.length(text)))
        return F.when(start > 0, F.array(_section(FACTS, front), _section(RULING, tail))).otherwise(whole)

    found = F.struct(
        F.regexp_instr(text, F.lit(TRANSITION)).alias("place"), F.regexp_substr(text, F.lit(TRANSITION)).alias("phrase")
    )
    return bind(found, lambda at: F.when(at["place"] > 0, around(at)).otherwise(bind(ruling, by_ruling)))


def extract_sections(docs: DataFrame, text_col: str = "text", out: str = "sections") -> DataFrame:
    """The input with ``out``: ordered array of (section, text).

    Headers if there are any, else cues and position; then the ruling is carved
    out of the last section unless one is a ruling or the last is law. Blank
    texts have no sections.
    """
    text_at, header_at, found_at, last_at, start_at = (unused(docs, n) for n in ("text_", "header_", "found_", "last_", "start_"))
    raw, found, last, start = (F.col(n) for n in (text_at, found_at, last_at, start_at))
    # each step is a column of its own, as later ones name it often
    rows = docs.withColumn(text_at, text_of(F.col(f"`{text_col}`"))).withColumn(header_at, header_sections(raw))
    rows = rows.withColumn(
        found_at,
        F.when(strip(raw) == "", F.array().cast(SECTION_LIST))
        .when(F.size(header_at) > 0, F.col(header_at))
        .otherwise(cue_sections(raw, ruling_start(raw))),
    )
    rows = rows.withColumn(last_at, F.get(found, F.size(found) - 1))
    closed = last.isNull() | F.exists(found, lambda s: s["section"] == RULING) | (last["section"] == LAW)
    rows = rows.withColumn(start_at, F.when(~closed, ruling_start(last["text"])))
    whole = last["text"]
    front = F.slice(found, F.lit(1), F.size(found) - 1)
    head, ruling = strip(F.left(whole, start)), strip(F.substring(whole, start + 1, F.length(whole)))
    kept = F.when(head == "", front).otherwise(F.concat(front, F.array(_section(last["section"], head))))
    terse = (F.length(whole) < TERSE_CHARS) & F.right(whole, F.lit(TERSE_TAIL)).rlike(DECREE)
    carved = (
        F.when(closed, found)
        .when((start > 0) & (ruling != ""), F.concat(kept, F.array(_section(RULING, ruling))))
        .when(~F.coalesce(start > 0, F.lit(False)) & terse, F.concat(front, F.array(_section(RULING, whole))))
        .otherwise(found)
    )
    return rows.withColumn(out, carved).drop(text_at, header_at, found_at, last_at, start_at)


def explode_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, sec_ord, section, text: one row per section."""
    found = extract_sections(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")))
    # the outer form: the optimizer would repeat the whole expression in a filter below the inner one
    each = found.select("doc", F.posexplode_outer("sections").alias("sec_ord", "s")).filter("s IS NOT NULL")
    return each.select("doc", "sec_ord", "s.section", "s.text")
