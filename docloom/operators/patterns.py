"""Boilerplate patterns: seeds, templates compiled to regexes, and which of them apply."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, search_fold

#: Category, regex and example of the seed patterns.
SEEDS = (
    ("procedural", r"taraflar arasında(ki)?\s+.*?dava", "Taraflar arasındaki davanın..."),
    ("procedural", r"dosya(sı)?\s+incelen(di|erek)\s+gereği\s+düşünüldü", "...dosya incelendi, gereği düşünüldü..."),
    ("procedural", r"temyiz\s+edilmesi\s+üzerine", "...temyiz edilmesi üzerine..."),
    ("procedural", r"mahkemesince\s+verilen\s+.*?karar", "...mahkemesince verilen ... karar..."),
    ("procedural", r"süresi\s+içinde\s+temyiz\s+ed", "...süresi içinde temyiz eden..."),
    ("procedural", r"hükmün\s+.*?(bozulması|onanması)\s+.*?talep", "...hükmün bozulması talep edilmiştir..."),
    ("transition", r"yapılan\s+yargılama\s+sonunda", "Yapılan yargılama sonunda..."),
    ("transition", r"tüm\s+dosya\s+kapsamı\s+(birlikte\s+)?değerlendiril", "...tüm dosya kapsamı değerlendirildiğinde..."),
    ("procedural", r"gerekçeli\s+karar(ın)?\s+.*?tebliğ", "...gerekçeli kararın tebliği..."),
    ("procedural", r"usul\s+ve\s+yasaya\s+uygun", "...usul ve yasaya uygun..."),
    (
        "procedural",
        r"yerel\s+mahkemece\s+verilen\s+hüküm\s+temyiz\s+edilmekle",
        "Yerel mahkemece verilen hüküm temyiz edilmekle, dosya...",
    ),
    (
        "procedural",
        r"vekil(i|ince)?\s+(tarafından\s+)?temyiz\s+ed(ilmiştir|ilmekle|en)",
        "...vekili tarafından temyiz edilmiştir.",
    ),
    ("procedural", r"karar(ı|ını)?[,\s]+davac[ıi]\s+vekili\s+temyiz\s+etmiştir", "Kararı, davacı vekili temyiz etmiştir."),
    ("procedural", r"yargıtay\s+cumhuriyet\s+başsavcılığına\s+tevdi", "...Yargıtay Cumhuriyet Başsavcılığına TEVDİİNE..."),
    ("procedural", r"temyiz\s+itirazları\s+yerinde\s+ol(duğundan|masından)", "...temyiz itirazları yerinde olduğundan..."),
    ("procedural", r"mahkemece\s+davanın\s+kabulüne\s+karar\s+veril", "Mahkemece davanın kabulüne karar verilmiş..."),
)
FLAGS = "(?iU)"
#: Placeholders as they stand inside a longer pattern: without word borders.
VALUES = {name: pattern.replace(r"\b", "") for name, pattern in PLACEHOLDERS}
IN_ORDER = re.compile("(" + "|".join(map(re.escape, VALUES)) + ")")
SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|#&~\-])")


def template_regex(template: str) -> str | None:
    """Regex of a normalised sentence: words by any white space, placeholders by their values; None if blank."""
    parts = [
        "".join(VALUES.get(piece) or SPECIAL.sub(r"\\\1", piece) for piece in IN_ORDER.split(word)) for word in template.split()
    ]
    return FLAGS + r"\s+".join(parts) if parts else None


def normalize(sentence: str) -> str:
    """Driver-side twin of ``functions.text.normalize_template`` for single sentences."""
    text = sentence.strip().replace("İ", "i").casefold()
    for name, pattern in PLACEHOLDERS:
        text = re.sub(pattern, name, text)
    return " ".join(text.split())


def usable(pattern: str) -> bool:
    """Whether a regex compiles and cannot match the empty string (which would lengthen texts)."""
    try:
        return re.compile(pattern.replace(FLAGS, "(?i)")).search("") is None
    except re.error:
        return False


#: A run of characters that stand for themselves in a regex of ``template_regex``.
LITERAL = re.compile(r"(?:[^\\.\[\]{}()*+?^$|#&~\-\0]|\\[\\.\[\]{}()*+?^$|#&~\-])+")


def required_word(pattern: str) -> str | None:
    """The longest piece without white space that every match of a template's regex holds; None if the regex is no template's, or has none."""
    if not pattern.startswith(FLAGS):
        return None
    text = pattern.removeprefix(FLAGS)
    for value in VALUES.values():
        text = text.replace(value, "\0")
    pieces = [p for part in text.split(r"\s+") for p in part.split("\0") if p]
    if not all(LITERAL.fullmatch(p) for p in pieces):
        return None
    return max((re.sub(r"\\(.)", r"\1", p) for p in pieces), key=len, default=None)


def matching_patterns(spark: SparkSession, text: Column, patterns: list[str]) -> Column:
    """Places, in order, of the patterns that can match a text: those whose required word it holds, and those without one.

    All words are looked for at once, by an automaton that each task builds; the time
    for a text so hardly depends on the number of patterns.
    """
    words = [required_word(p) for p in patterns]
    always = [i for i, w in enumerate(words) if not w]
    named = [(i, w) for i, w in enumerate(words) if w]
    # words are folded where texts are; a row a pattern
    folded = spark.createDataFrame(named, "i int, w string").select("i", search_fold(F.col("w")).alias("w")).collect() if named else []
    holders: dict[str, list[int]] = {}
    for r in folded:
        holders.setdefault(r.w, []).append(r.i)

    @F.pandas_udf("array<int>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word, places in holders.items():
            automaton.add_word(word, places)
        automaton.make_automaton()
        for part in parts:
            yield part.map(lambda t: sorted({*always, *(i for _, places in automaton.iter(t or "") for i in places)}) if holders else always)

    return found(search_fold(text))


def select_patterns(found: Mapping, mined: bool = False) -> list[str]:
    """Regexes to apply from a pattern file's content, in order: seeds, confirmed reviews, and mined ones if asked for.

    Invalid patterns are left out.
    """
    seeds = [FLAGS + s["regex"] for s in found.get("seed_patterns") or [] if s.get("regex")]
    reviews = [
        template_regex(normalize(" ".join(r["first_sentence"])))
        for r in found.get("reviewed") or []
        if r.get("is_boilerplate") and r.get("first_sentence")
    ]
    learned = [template_regex(m["pattern"]) for m in found.get("mined_patterns") or [] if m.get("pattern")] if mined else []
    return [p for p in [*seeds, *reviews, *learned] if p and usable(p)]


def pattern_file(mined: Iterable[Mapping], reviewed: Iterable[Mapping], params: Mapping, before: Mapping | None = None) -> dict:
    """Content of a pattern file. Reviews of an earlier file are kept, newer ones of the same chunk replace them."""
    kept = {r["chunk_id"]: dict(r) for r in (before or {}).get("reviewed") or []}
    kept |= {r["chunk_id"]: dict(r) for r in reviewed}
    return {
        "seed_patterns": [dict(zip(("category", "regex", "example"), s, strict=True)) for s in SEEDS],
        "mined_patterns": [dict(m) for m in mined],
        "reviewed": list(kept.values()),
        "params": dict(params),
    }
