"""Operator 1: secret scans with corpus-wide ownership frequency.

DataFrame functions only. Every whole text is scanned once with a cheap test;
texts that pass are cut by each pattern into gaps and matches, whose lengths
give the spans by a running sum. The value of each candidate is hashed and the
hashes are counted over the corpus by distinct repositories and owners. A value
that several owners publish, or one owner in many repositories, is a widely copied
example; any other, unless it looks like a placeholder, is a live-looking
credential. The documents name no repositories: a document stands for one, its
source for the owner.

Base spans (assign, access, hex) always stay. The method adds spans: values of
two wider patterns (provider prefixes, long mixed-class strings), which are too
loose to report by themselves, become spans where ownership marks them as
owner-specific and no base span covers them.

A value that is copied into every document is one key: its repositories and
owners are counted by partial aggregates, and the counts are written before the
spans are joined with them, so that adaptive execution can split its partition.

Defined results: null text counts as empty; a text without secrets has zero
counts, an empty ``spans`` and the SHA-256 of the empty string; rows that repeat
an id are scanned each by itself and are one repository; null repositories and
null owners count as one of their own each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_rows, cut, discard, pick

#: Pattern and group of the value, in order of kind. The first three are the base.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("prefixed", r"(?:gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|eyJ)[A-Za-z0-9_.-]{16,}", 0),
    ("mixed", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0),
)
BASE_KINDS = 3
#: A value of an assignment has so many characters at least.
LEAST_VALUE = 6
#: A value with this many owners, or in this many repositories, is a widely copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 25
#: Spans that are broadcast at once when texts are masked.
BROADCAST_SPANS = 1_000_000
#: Values that hold one of these, in lower case, are placeholders whoever owns them.
PLACEHOLDERS = r"example|changeme|placeholder|your_|xxxx|0000000|1234567|abcdefg"

#: One scan that every text with a candidate of any kind passes.
ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9_.+/-]{19}"


def _cuts(text: Column, pattern: str, group: int) -> Column:
    """Per match: length of the gap before it, its own length, length and hash of its value, and its looks."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))
    looks = lambda v: F.struct(
        F.length(v).alias("n"),
        F.sha2(v.cast("binary"), 256).alias("hash"),
        F.lower(v).rlike(PLACEHOLDERS).alias("dummy"),
        (v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9].*[0-9].*[0-9]")).alias("mixed"),
    )
    return F.transform(
        F.filter(zipped, lambda m: m["size"].isNotNull()),
        lambda m: F.struct(m["gap"].alias("gap"), m["size"].alias("size"), looks(m["value"]).alias("value")),
    )


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, id, owner, text) -> the rows without text, and their candidate spans; both tables.

    Spans: row, id, owner, kind, start, end, hash, dummy.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.array(
        *[F.struct(F.lit(i).alias("kind"), _cuts(text, pattern, group).alias("cuts")) for i, (_, pattern, group) in enumerate(PATTERNS)]
    )
    scanned = rows.select("row", "id", "owner", F.when(text.rlike(ANY), F.filter(found, lambda k: F.size(k["cuts"]) > 0)).alias("found"))
    scanned = cut(scanned, "secrets")
    matches = scanned.select("row", "id", "owner", F.explode("found").alias("of")).select(
        "row", "id", "owner", F.col("of.kind").alias("kind"), F.posexplode("of.cuts").alias("place", "cut")
    )
    running = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        matches.withColumn("end", F.sum(F.col("cut.gap") + F.col("cut.size")).over(running))
        .withColumn("start", F.col("end") - F.col("cut.size"))
        .filter((F.col("kind") != 0) | (F.col("cut.value.n") >= LEAST_VALUE))
        .filter((F.col("kind") != len(PATTERNS) - 1) | F.col("cut.value.mixed"))
        .select("row", "id", "owner", "kind", "start", "end", F.col("cut.value.hash").alias("hash"), F.col("cut.value.dummy").alias("dummy"))
    )
    return scanned.select("row", "id"), cut(spans, "spans")


def ownership(spans: DataFrame, repo: str = "id", owner: str = "owner") -> DataFrame:
    """hash -> n_repos, n_owners over the corpus; each (hash, repository, owner) is reduced before it is shuffled on."""
    owners = spans.groupBy("hash", repo, owner).agg(F.count(F.lit(1)).alias("n")).groupBy("hash", owner).agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(spans: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """The spans that stay (row, kind, start, end, live): base spans, and those of wider kinds that are live-looking."""
    counted = cut(ownership(spans), "owners")
    live = (F.col("n_owners") < copied_owners) & (F.col("n_repos") < copied_repos) & ~F.col("dummy")
    known = spans.join(counted, "hash").select("row", "kind", "start", "end", live.alias("live"))
    return known.filter((F.col("kind") < BASE_KINDS) | F.col("live"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(name) for name, _, _ in PATTERNS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    copied_owners: int = COPIED_OWNERS,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, and how many look live or copied.

    Columns: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.
    A span is live-looking if its value has fewer than ``copied_owners`` owners,
    stands in fewer than ``copied_repos`` repositories and is no placeholder.
    """
    picked = pick(docs, id=id_col, text=text_col, owner=owner_col)
    rows, spans = candidates(picked.withColumn("row", F.monotonically_increasing_id()))
    per_row = judged(spans, copied_owners, copied_repos).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all")
    )
    kept = F.filter("all", lambda s: s["kind"] < BASE_KINDS)
    covered = lambda s: F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    )
    per_row = (
        per_row.withColumn("base", kept)
        .withColumn("wide", F.filter("all", lambda s: (s["kind"] >= BASE_KINDS) & ~covered(s)))
        # of two wider spans that overlap, the one that starts first (prefixed before mixed) is reported
        .withColumn(
            "added",
            F.filter(
                "wide",
                lambda s: ~F.exists(
                    F.col("wide"),
                    lambda o: (o["start"] < s["end"])
                    & (s["start"] < o["end"])
                    & (F.struct(o["start"], o["kind"]) < F.struct(s["start"], s["kind"])),
                ),
            ),
        )
        .withColumn("spans", F.array_sort(F.concat("base", "added")))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    out = rows.join(per_row.select("row", "base", "spans"), "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("all")
    )
    n = lambda where: F.size(F.filter("base", where)).cast("long")
    return out.select(
        id_col,
        n(lambda s: s["kind"] == 0).alias("n_assign"),
        n(lambda s: s["kind"] == 1).alias("n_access"),
        n(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source"
) -> DataFrame:
    """The input rows with their secrets masked in ``text_col``; null texts stay null.

    Every base span and every owner-specific span of the wider kinds is replaced,
    by ``[SECRET]`` if its value looks live and ``[EXAMPLE]`` if it is a copied
    example or placeholder. Overlapping spans are replaced together, under the
    mark of the first. Texts are written once with a key and masked where they are
    read; only spans are shuffled. Columns of any name pass through.
    """
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = cut(docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in name.items()]), "keyed")
    asked = pick(keyed, row="row", id=name.get(id_col, ""), text=name[text_col], owner=name.get(owner_col, ""))
    rows, spans = candidates(asked)
    at_start = F.struct(F.col("start"), (-F.col("end")).alias("back"), F.col("live"))
    found = cut(judged(spans).groupBy("row").agg(F.array_sort(F.collect_set(at_start)).alias("found")), "found")
    discard(rows)
    discard(spans)
    text = F.col(name[text_col])
    at = lambda n: n.cast("int")
    masked = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("pos")),
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["pos"],
                F.concat(
                    acc["out"],
                    text.substr(at(acc["pos"] + 1), at(s["start"] - acc["pos"])),
                    F.when(s["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]")),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
            F.greatest(acc["pos"], -s["back"]).alias("pos"),
        ),
        lambda acc: F.concat(acc["out"], text.substr(at(acc["pos"] + 1), F.length(text))),
    )
    joined = by_rows(keyed, found, "left", BROADCAST_SPANS, F.size("found"))
    done = joined.withColumn(name[text_col], F.when(text.isNull() | F.col("found").isNull(), text).otherwise(masked))
    return done.select(*[F.col(n).alias(c) for c, n in name.items()])
