"""Operator 8: main text of web pages by a site style tree.

Pages are read twice. The first pass merges the whole DOMs of each host into a
style tree: a node is a path of elements with their classes, and for every node
the pages that show each content (a block's text) and each presentation (the
inline elements of a block) are counted. A node's importance combines the
entropies of both, as in the site style tree: content that every page repeats has
entropy one and importance zero, content of single pages has importance one;
varied presentation adds a little. A branch's importance is that of the contents
below it, by their characters. The second pass drops the branches of low
importance from each page and joins the blocks that remain.

Importance is relative to a frame: the marked article (``article``, ``main``)
where a page has one, the whole page otherwise. Only nodes inside the frame are
judged, and only where the frame itself is of high importance: on a host of near
copies everything repeats, and nothing can be told from that.

Marks are a prior beside the tree. Where a page marks an article, nothing outside
it is main text; an article that is a reader's comment, by its own name or one
around it, is none. Elements that are asides by their kind, and those a class, id or
role names as one, go whatever their contents; inside an article such a name
counts if its last word tells (``user-comment``) or only words of boxes are beside it
(``ad-slot``), so ``share-price`` is no share button. Headings in an article's own
header stay. Where every article of a page stands within a named wrapper, they
are main text if they hold as many characters as the unmarked blocks, else those
blocks are. Where marks would leave nothing of a page, names are void.

The first pass sends hashes only; repeats within a page are merged before the
shuffle and the counts are partial sums, so a host with a third of all pages is
no hot key. Pages of one host with the same main content count as one page, so
copies do not make an article look like a menu. The table of low nodes is
broadcast while it is small and joined by shuffle beyond ``BROADCAST_ROWS``.

Defined results: null and empty html give an empty text; a null url counts as
one host; broken markup is closed as browsers do it, an unfinished tag or
comment ends the page; repeated page ids give a row each. The tree knows
``MOST_DEPTH`` levels: what lies deeper is judged with its ancestor there, and its
text is kept or goes with it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, pick, small

#: Weight of content against presentation.
CONTENT_SHARE = 0.9
#: A branch goes below this share of its frame's importance: on pages without a marked article, and inside articles.
PAGE_SHARE, ARTICLE_SHARE = 0.92, 0.5
#: A frame of less importance tells nothing: its host shows copies.
LEAST_FRAME = 0.5
#: A node is judged on so many different pages at least.
LEAST_PAGES = 3
BROADCAST_ROWS = 1_000_000
#: Levels of a style tree; a path has no more nodes.
MOST_DEPTH = 128
#: Key of the node above all elements, the frame of pages without a marked article.
WHOLE_PAGE = 0

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address "
    "article section main header footer nav aside form fieldset figure figcaption details summary hr dialog menu center".split()
)
#: An opening element closes an open one of these above the nearest scope element.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
    "select": ("select", ()),
    "button": ("button", ()),
    "article": ("label button select option", ()),
    "main": ("label button select option", ()),
}
#: Elements and class or id words that are never main text.
ASIDE_TAGS = frozenset("head nav footer header aside form button select datalist dialog menu label option".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended comment comments reply "
    "replies disqus widget toolbar copyright disclaimer pagination pager skip".split()
)
#: Of these, an article of that name is a reader's.
READER_WORDS = frozenset("comment comments reply replies disqus".split())
#: Inside an article these tell nothing as the last word of a name: an article has a header and a menu of dishes of its own.
LOOSE_WORDS = frozenset("header masthead menu search toolbar banner alert overlay copyright disclaimer skip".split())
#: Words of boxes, which leave a name what it is.
BOX_WORDS = frozenset(
    "area bar block body bottom box button buttons container content feed form icons inner item left link links list panel right "
    "section slot thread top unit widget wrap wrapper".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their names never mark an aside, nor do names that start so on any element.
WHOLE_TAGS = ARTICLE_TAGS | {"html", "body"}
MODIFIERS = frozenset("has no with without".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]++|<)", re.S
)
#: A tag with an unpaired quote ends at the next ``>``.
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def aside_name(names: str, inside: bool, telling: frozenset[str] = ASIDE_WORDS) -> bool:
    """Whether a class, id or role names an aside; ``has-sidebar`` and the like only tell of one elsewhere.

    Inside an article the last word of the token has to be of that kind, or all but words of boxes; elsewhere the first or last.
    """
    for name in names.split():
        words = [w.lower() for w in NAME_WORD.findall(name)]
        if not words or words[0] in MODIFIERS:
            continue
        if inside:
            found = words[-1] in telling - LOOSE_WORDS or not telling.isdisjoint(words) and (telling | BOX_WORDS).issuperset(words)
        else:
            found = words[0] in telling or words[-1] in telling
        if found:
            return True
    return False


@dataclass
class Block:
    """A run of text between block borders."""

    path: tuple[int, ...]
    #: Depth of the frame: nodes of the path from here on are judged.
    frame: int
    #: Marked as an aside by a kind of element, by a name around the article, by a name elsewhere.
    kind: bool
    around: bool
    named: bool
    article: bool
    text: str
    style: str


@dataclass
class Node:
    tag: str
    key: int
    kind: bool = False
    around: bool = False
    named: bool = False
    article: bool = False
    frame: int = 1
    path: tuple[int, ...] = field(default=())
    #: Within an article's own header; within something that readers wrote.
    title: bool = False
    reader: bool = False


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks in order, with the style-tree path of each."""
    page = page or ""
    root = Node("", WHOLE_PAGE, path=(WHOLE_PAGE,))
    stack, found = [root], []
    # elements on the stack by tag: what is not open is not looked for
    opened: Counter[str] = Counter()
    text: list[str] = []
    style: list[str] = []

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                top = stack[-1]
                found.append(Block(top.path, top.frame, top.kind, top.around, top.named, top.article, whole, " ".join(style)))
            text.clear()
        style.clear()

    def cut_at(i: int) -> None:
        opened.subtract(node.tag for node in stack[i:])
        del stack[i:]

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                cut_at(i)
                return
            if stack[i].tag in scope:
                return

    at = 0
    while m := TOKEN.match(page, at):
        if m[4] == "<":
            m = LOOSE.match(page, at) or m
        at = m.end()
        if m.re is TOKEN and m[4] is not None:
            text.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if page[at - 1] != ">":
            break
        if m[1]:
            if tag in BLOCK or tag in ASIDE_TAGS:
                close((tag,), ())
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None and tag not in ("svg", "math", "noscript"):
                break
            at = end.end() if end else at
            continue
        if tag not in BLOCK and tag not in ASIDE_TAGS:
            if tag not in VOID:
                style.append(tag)
            continue
        flush()
        if tag in BLOCK:
            close(("p",), ("div", "td", "th", "li", "article", "section", "main", "body", "blockquote"))
        if tag in CLOSES:
            names, scope = CLOSES[tag]
            close(tuple(names.split()), scope)
        if tag in BLOCK:
            close(("head",), ())
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        names = " ".join(v.strip("\"'") for _, v in NAMES.findall(m[3])) if m[3] else ""
        parent = stack[-1]
        if tag == "body":
            parent = root
            cut_at(1)
        inside = parent.article
        reader = parent.reader or tag not in ("html", "body", "main") and aside_name(names, True, READER_WORDS)
        marks = reader or tag not in WHOLE_TAGS and aside_name(names, inside)
        title = inside and (parent.title or tag == "header" and not parent.kind)
        # a heading of an article's header is main text, whatever else stands in the header
        kind = not (tag in HEADINGS and parent.title) and (parent.kind or tag in ASIDE_TAGS)
        node = Node(tag, digest(f"{parent.key}/{tag}.{names.lower()}"), kind, title=title and (tag == "header" or tag not in ASIDE_TAGS), reader=reader)
        opens = tag in ARTICLE_TAGS and not inside and not reader
        node.article = inside or opens
        # names met so far lie around an article that opens here
        node.around = parent.around or opens and parent.named
        node.named = not opens and (parent.named or marks)
        node.path = (*parent.path, node.key) if len(parent.path) < MOST_DEPTH else parent.path
        node.frame = len(node.path) if opens else parent.frame
        opened[tag] += 1
        stack.append(node)
    flush()
    return found


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def framed(found: list[Block]) -> list[Block]:
    """The blocks that marks leave: those of the article, or of the page if it marks none."""
    clear = [b for b in found if not (b.kind or b.named)]
    within = [b for b in clear if b.article]
    free = [b for b in within if not b.around]
    if free:
        return free
    # an article within a named wrapper is the story or a teaser: their lengths tell
    outside = [b for b in clear if not b.article]
    mass = lambda blocks: sum(len(b.text) for b in blocks)
    if within or outside:
        return within if mass(within) >= mass(outside) else outside
    return [b for b in found if not b.kind]


def main_blocks(found: list[Block], low: frozenset[int]) -> list[str]:
    """Texts of the blocks that stay."""
    return [b.text for b in framed(found) if low.isdisjoint(b.path[b.frame :])]


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, html) -> host, key, importance, pages, frame of every node of the hosts' style trees.

    ``frame`` is the node that the importance of this one is relative to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("host", "path", "frame", "kind", "feature", "chars", "page")}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = blocks_of(page.as_py())
                sign = digest("\n".join(b.text for b in framed(found)))
                seen = set()
                for b in found:
                    # a page is a third feature of the nodes it shows, so that one count gives all
                    for kind, feature in ((0, digest(b.text)), (1, digest(b.style)), (2, sign)):
                        if (b.path, kind, feature) not in seen:
                            seen.add((b.path, kind, feature))
                            row = (host, list(b.path), b.path[b.frame - 1], kind, feature, len(b.text), sign)
                            for name, value in zip(rows, row, strict=True):
                                rows[name].append(value)
            kinds = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    seen = pages.select("host", "html").mapInArrow(
        run, "host string, path array<long>, frame long, kind int, feature long, chars long, page long"
    )
    node = ["host", "path", "frame"]
    once = seen.groupBy(*node, "kind", "feature", "page").agg(F.max("chars").alias("chars"))
    features = once.groupBy(*node, "kind", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"))
    n, log_n, content, look = F.col("n"), F.log(F.col("n").cast("double")), F.col("kind") == 0, F.col("kind") == 1
    leaf = features.groupBy(*node).agg(
        F.sum(F.when(content, n * F.col("chars"))).alias("chars"),
        F.sum(F.when(content, n * F.col("chars") * log_n)).alias("content_logs"),
        F.sum(F.when(look, n)).alias("styles"),
        F.sum(F.when(look, n * log_n)).alias("style_logs"),
        F.count(F.when(F.col("kind") == 2, n)).alias("pages"),
    )
    leaf = leaf.withColumn("whole", F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double")))
    # mean entropy of the contents, each shown by n pages alike: log n / log m; entropy of the presentations over m pages
    novel = 1.0 - F.col("content_logs") / F.col("chars") / F.col("whole")
    looks = (F.log(F.col("styles").cast("double")) - F.col("style_logs") / F.col("styles")) / F.col("whole")
    leaf = leaf.withColumn(
        "importance", CONTENT_SHARE * novel + (1 - CONTENT_SHARE) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), looks))
    )
    branch = leaf.select("host", F.explode("path").alias("key"), "frame", "importance", "chars", "pages")
    return branch.groupBy("host", "key").agg(
        F.round(F.sum(F.col("importance") * F.col("chars")) / F.sum("chars"), 9).alias("importance"),
        F.max("pages").alias("pages"),
        F.max("frame").alias("frame"),
    )


def low_nodes(tree: DataFrame) -> DataFrame:
    """host, key of the nodes whose branches go."""
    frames = tree.filter(F.col("importance") >= LEAST_FRAME).select("host", F.col("key").alias("frame"), F.col("importance").alias("framed"))
    share = F.when(F.col("frame") == WHOLE_PAGE, PAGE_SHARE).otherwise(ARTICLE_SHARE)
    judged = tree.filter((F.col("pages") >= LEAST_PAGES) & (F.col("key") != F.col("frame"))).join(frames, ["host", "frame"])
    return judged.filter(F.col("importance") < share * F.col("framed")).select("host", "key")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by line feeds), n_chars."""
    rows = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    tree = cut(style_tree(rows), "tree")
    low = cut(low_nodes(tree).groupBy("host").agg(F.collect_set("key").alias("low")), "low")
    discard(tree)
    asked = rows.join(small(low, BROADCAST_ROWS, F.size("low")), "host", "left").select("id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n".join(main_blocks(blocks_of(page.as_py()), frozenset(low.as_py() or ())))
                for page, low in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"]
            )

    kinds = dict(asked.dtypes)
    out = asked.mapInArrow(run, f"{id_col} {kinds['id']}, {url_col} {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
