"""Text functions from Column to Column: cleaning, sentences, words, templates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and the four separator controls define it, by its characters: a class of these is tested faster than ``\\s``.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space that is not one plain space; what is surely none is told by one range.
UNEVEN = rf"(?![!-~])(?:{WS.replace('x20', 'x1f')}{WS}*| {WS}+)"

#: A line that begins with one of these labels is a header line.
HEADER_LABELS = (
    "MAHKEMESİ",
    "MAHKEMESI",
    "DAVA TÜRÜ",
    "DAVA TURU",
    "TARİHİ",
    "TARIHI",
    "ESAS NO",
    "KARAR NO",
    "NUMARASI",
    "İTHAL",
    "TAtarafLAR",
    "TARAFLAR",
    "İNCELENEN KARARIN",
    "INCELENEN KARARIN",
)
HEADER_LINE = rf"(?imdU)^{WS}*(?:{'|'.join(HEADER_LABELS)})\b.*$"
#: Markup and source labels that are stripped everywhere.
ARTEFACTS = (r"\*+", rf'(?iU)"?{WS}*İçtihat{WS}+Metni{WS}*"?')
#: Letters without which no text holds the last of these: it is tried where they stand.
ARTEFACT_LETTERS = "[çÇ][tT]"
SENTENCE_BREAK = rf"(?U)(?<=[.!?…]){WS}+"

#: What a template's placeholders stand for, in order of replacement.
PLACEHOLDERS = (
    ("<DATE>", r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}"),
    ("<NO>", r"\b\d{4}\s*/\s*\d+\b"),
    ("<MADDE>", r"\bm(?:adde|\.)\s*\d+\b"),
    ("<NUM>", r"\b\d+\b"),
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def seeded_order(col: Column, seed: int) -> Column:
    """A random order of ids that only the seed decides."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("null"))).cast("binary"))


def text_of(col: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(col, F.lit(""))


def collapse(col: Column) -> Column:
    """Runs of white space become one space; those that are one already are passed over."""
    return F.regexp_replace(col, UNEVEN, " ")


def strip(col: Column) -> Column:
    """Without white space at both ends, which alone are looked at."""
    return F.btrim(col, F.lit(SPACES))


def strip_patterns(col: Column, patterns: Iterable[str]) -> Column:
    """Each pattern in turn replaced by a space."""
    return reduce(lambda c, p: F.regexp_replace(c, F.lit(p), F.lit(" ")), patterns, col)


def strip_chosen(col: Column, patterns: Iterable[str], places: Column) -> Column:
    """Those patterns whose places are given, in turn, replaced by a space."""
    every = F.array(*[F.lit(p) for p in patterns])
    return F.aggregate(places, col, lambda text, i: F.regexp_replace(text, F.get(every, i), F.lit(" ")))


def search_fold(col: Column) -> Column:
    """Case folded so that texts which a regex without regard to case takes for equal are equal; it maps each character by itself."""
    # the replacement between them keeps the optimizer from taking the upper case away
    text = F.lower(F.replace(F.upper(text_of(col)), F.lit("ẞ"), F.lit("SS")))
    for old, new in (("ς", "σ"), ("ß", "ss"), ("\u0307", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_text(col: Column, patterns: Iterable[str] = (), places: Column | None = None) -> Column:
    """Header lines, artefacts, learned patterns, orphan periods and surplus white space removed.

    Header lines go while line breaks exist; learned patterns need single spaces.
    With ``places`` only those of the patterns are tried.
    """
    patterns, text = list(patterns), strip_patterns(text_of(col), [HEADER_LINE, *ARTEFACTS[:-1]])
    # what is taken away before leaves a space, so letters that stand together do so in the raw text
    labelled = F.rlike(col, F.lit(ARTEFACT_LETTERS))
    text = collapse(F.when(labelled, strip_patterns(text, ARTEFACTS[-1:])).otherwise(text))
    text = strip_patterns(text, patterns) if places is None else strip_chosen(text, patterns, places)
    text = F.regexp_replace(text, rf"(?U)\.(?:{WS}*\.)+", ".")
    # only patterns leave new runs of spaces
    return F.trim(collapse(text) if patterns else text)


def sentences(col: Column) -> Column:
    """Non-blank sentences: cuts are white space after a sentence mark."""
    return F.filter(F.transform(F.split(text_of(col), SENTENCE_BREAK), strip), lambda s: s != "")


def fold(col: Column) -> Column:
    """Lower case for comparison; sharp and final s as in full case folding, the dotted capital I as a plain i."""
    lower = F.lower(F.replace(col, F.lit("İ"), F.lit("i")))
    return F.replace(F.replace(lower, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normalize_template(col: Column) -> Column:
    """Dates, case numbers, article numbers and numbers become placeholders."""

    def replaced(text: Column) -> Column:
        for name, pattern in PLACEHOLDERS:
            text = F.regexp_replace(text, f"(?iU){pattern}" if name == "<MADDE>" else f"(?U){pattern}", name)
        return text

    # every placeholder stands for something with a digit
    text = bind(fold(strip(col)), lambda t: F.when(F.rlike(t, F.lit(r"(?U)\d")), replaced(t)).otherwise(t))
    return F.trim(collapse(text))


def words(col: Column) -> Column:
    """Distinct word-character runs of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(col)), F.lit(r"(?U)(\w+)"), F.lit(1)))


def split_words(col: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text_of(col), rf"(?U){WS}+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(split_words(col))


def first_tokens(col: Column, n: int = 50) -> Column:
    """Distinct words among the first ``n`` of the lower-cased text."""
    return F.array_distinct(F.slice(split_words(F.lower(text_of(col))), 1, n))


def snippet(col: Column, n: int) -> Column:
    """The first ``n`` characters on one line."""
    return F.translate(F.substring(text_of(col), 1, n), "\n", " ")


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the union of two arrays; 0 where either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def any_keyword(text: Column, keywords: Column) -> Column:
    """Whether the lower-cased text contains one of the keywords."""
    return F.exists(keywords, lambda k: F.contains(F.lower(text), k))


def with_prefix(col: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text_of(col)) if prefix else text_of(col)
