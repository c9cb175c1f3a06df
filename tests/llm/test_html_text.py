import math
import random
from collections import defaultdict

import pytest
from docloom.llm.html_text import blocks_of, framed, main_blocks, main_text, style_tree

SCHEMA = "page_id long, url string, html string, host string, text int, low string"


def plain(page):
    return "\n".join(main_blocks(blocks_of(page), frozenset()))


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two <b>bold</b>\n  three<br>four", "one\ntwo bold three four"),
        ("<ul><li>a<li>b</ul><p>c &amp; d &copy;&nbsp;x &#233; &lt;", "a\nb\nc & d © x é <"),
        ("<head><title>t</title></head><body><nav>menu</nav><article><h1>T</h1><p><b>x<br><p>y</article><footer>f</footer>", "T\nx\ny"),
        ("<div class='ad'>buy</div><div class='story'>keep</div><aside>s</aside><form><input>f</form>", "keep"),
        ("<script>var t='</p>';a<b</script><style>p{}</style><!-- c --><p>in 3 < 4", "in 3 < 4"),
        ("<article><p>body</p><div id='comments'><p>first!</p></div><div class='cookie-notice'>ok</div></article><p>out</p>", "body"),
        ("<p>cut off</p><p class='x", "cut off"),
        ("<main><table><tr><td>1<td>2<tr><td>3</table></main>", "1\n2\n3"),
        (
            '<div><h1>Story</h1><p>Main story text</p></div><ol class="comment-list"><li><article><p>reader comment</p></article></li></ol>',
            "Story\nMain story text",
        ),
        ("<article><p>one</p></article><div><article class='comment'><p>mine</p></article></div>", "one"),
        ("<article class='post has-comments'><p>one</p><section id=userComments><article><p>mine</p></article></section></article>", "one"),
        ("<article><header><h1>Title</h1><p>by x</p><nav><h2>m</h2></nav></header><p>one</p></article>", "Title\none"),
        ("<main><div class='sidebar-left'><p>s</p></div><p>one</p></main>", "one"),
        ("<div class='sidebar-wrap'><article><p>long main story</p></article></div><p>x</p>", "long main story"),
        ("<div class='related'><article><p>teaser</p></article></div><div><p>the long main story</p></div>", "the long main story"),
        *[
            (f"<article><p>one</p><div class='{name}'><p>two</p></div></article>", "one" if gone else "one\ntwo")
            for gone, names in (
                (True, "post-comments user-comment ad-slot google-ad cookie-bar newsletter-box adSlot related-links share"),
                (False, "share-price entry-header no-comments dinner-menu adventure section-body commentary"),
            )
            for name in names.split()
        ],
        ("<P CLASS=Lead>Upper</P><!DOCTYPE x>tail", "Upper\ntail"),
    ],
)
def test_blocks(page, text):
    assert plain(page) == text


def site(spark, n, host="h.example", note="Accept all terms"):
    rows = []
    for i in range(n):
        body = "".join(f"<p>story {i} part {k} of page {i}</p>" for k in range(4))
        rows.append((i, f"http://{host}/{i}", f"<body><div class='c9'>{note}</div><div class='m1'>{body}</div></body>", "x", 1, "y"))
    return rows


def test_style_tree_drops_what_pages_repeat(spark):
    rows = site(spark, 12) + [(100, "http://other.example/1", site(spark, 1)[0][2], "x", 1, "y")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].text == "\n".join(f"story 3 part {k} of page 3" for k in range(4))
    assert got[100].text.startswith("Accept all terms\n")  # one page is no site
    assert got[3].n_chars == len(got[3].text)


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://h.example/a", "<article><p>the same story</p></article>", "x", 1, "y") for i in range(50)]
    assert {r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"the same story"}


def test_importance_equals_brute_force(spark):
    pages = [f"<body><div class=a>{'same' if i % 2 else 'u%d' % i}</div></body>" for i in range(8)]
    frame = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = [r for r in style_tree(frame).collect()]
    # 4 pages have a text of their own, and the copies of one page count once: 5 pages, nothing repeats
    assert {r.pages for r in got} == {5} and all(abs(r.importance - 0.9) < 1e-9 for r in got)
    pages = [f"<body><p>p{i}</p><div class=a>{'same' if i % 2 else 'u%d' % i}</div></body>" for i in range(8)]
    got = style_tree(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()
    # by characters: four pages show the four of "same", the other four two each
    want = 0.9 * (1 - 16 * math.log(4) / 24 / math.log(8))
    assert any(abs(r.importance - want) < 1e-9 for r in got)


def test_awkward_rows(spark):
    rows = [(1, None, None, "x", 1, "y"), (None, "no url", "<p>x</p>", None, None, None), (2, "http://h/", "", "x", 1, "y")]
    rows += [(2, "http://h/", "<p>" + "word " * 200_000, "x", 1, "y")]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 999_999), ("None", 1)]
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_of_an_article_stay(spark):
    parts = [[f"part {k}" if k != i else f"part {k} of variant {i}" for k in range(10)] for i in range(10)]
    page = "<body><div>menu of the site</div><article><h1>Title</h1>{}</article></body>"
    html = [page.format("".join(f"<p>{p}</p>" for p in each)) for each in parts]
    rows = [(i, "http://h.example/a", h, "x", 1, "y") for i, h in enumerate(html)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "\n".join(["Title", *each]) for i, each in enumerate(parts)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<datalist><option value=a><option value=b></datalist><p>text</p>", "text"),
        ("<header><label>search<input></header><article><p>body</article><form><label>c</label></form>", "body"),
        ("<div><label>unclosed</div><p>text</p>", "text"),
        ("<label>unclosed<article><p>body</article>", "body"),
        ("<p>a<select><option>x<option>y</select><button>go</button>b</p>", "a\nb"),
        ("<button>unclosed<button>two</button><p>text", "text"),
        ("<body class='has-sidebar'><p>text</p></body>", "text"),
        ("<html class='no-menu'><body id=page-header><main class='search'><p>text</main>", "text"),
        ("<article class='post has-comments'><p>body</p></article>", "body"),
        ("<div class='with-sidebar'><p>text</p><div class='sidebar'>s</div></div>", "text"),
        ("<head><title>t</title></head><p>text", "text"),
        ("<head><meta name=a><p>text", "text"),
        ("<body class='login-header-fixed no-sidebar'><article><p>body</article>", "body"),
        ("<div class='login-header-fixed'><div><article><p>body<p>more</article></div><p>out</div>", "body\nmore"),
        ("<div class='search-results'><p>the only text</p></div>", "the only text"),
        ("<article><div class='search-engine-history'>h</div><p class='share-price'>p</p><div class='share'>s</div></article>", "h\np"),
        ("<div class='related'><article>card</article></div><article>body</article>", "body"),
    ],
)
def test_ordinary_markup_loses_nothing(page, text):
    assert plain(page) == text


def made_up_hosts(seed):
    """Pages of hosts with and without marks: menus, notices and share lines that repeat, near copies, few pages."""
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(["ab", "cde", "fghi", "jk", "lmnop"]) + str(rng.randrange(99)) for _ in range(n))
    rows = []
    for h in range(12):
        menu, notes = [draw(2) for _ in range(6)], [draw(6) for _ in range(1 + h % 3)]
        marked, n = h % 2, [2, 5, 40][h % 3]
        base = [draw(20) for _ in range(8)]
        for i in range(n):
            body = [draw(20) for _ in range(rng.randrange(2, 9))]
            if h in (4, 5):
                body = [p if k != i % 8 else draw(20) for k, p in enumerate(base)]
            inner = "".join(f"<p>{p}</p>" for p in body) + ("<div class='x7'>Tell your friends</div>" if h % 4 < 2 else "")
            inner = f"<article>{inner}</article>" if marked else f"<div class='m{h}'>{inner}</div>"
            items = "".join(f"<li>{m}</li>" for m in menu)
            page = f"<body><ul class='q'>{items}</ul><div class='z'>{rng.choice(notes)}</div>{inner}<p>bottom line</p></body>"
            rows.append((len(rows), f"http://h{h}.example/{i}", page, "x", 1, "y"))
    return rows


def brute_force(rows):
    """Texts by page from a style tree of plain dictionaries."""
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[1].split("/")[2]].append((r[0], blocks_of(r[2])))
    out = {}
    for pages in hosts.values():
        content, style, shown, chars, frame = defaultdict(set), defaultdict(set), defaultdict(set), {}, {}
        for _, blocks in pages:
            page = "\n".join(b.text for b in framed(blocks))
            for b in blocks:
                leaf = (b.path, b.path[b.frame - 1])
                content[leaf, b.text].add(page)
                style[leaf, b.style].add(page)
                shown[leaf].add(page)
        total, value, seen = defaultdict(float), defaultdict(float), defaultdict(int)
        for leaf, on in shown.items():
            whole = math.log(max(2, len(on)))
            texts = {t: len(s) for (x, t), s in content.items() if x == leaf}
            looks = [len(s) for (x, _), s in style.items() if x == leaf]
            chars = sum(n * len(t) for t, n in texts.items())
            novel = 1 - sum(n * len(t) * math.log(n) for t, n in texts.items()) / chars / whole
            varied = (math.log(sum(looks)) - sum(n * math.log(n) for n in looks) / sum(looks)) / whole
            for key in leaf[0]:
                total[key] += chars
                value[key] += chars * (0.9 * novel + 0.1 * min(1.0, max(0.0, varied)))
                seen[key] = max(seen[key], len(on))
                frame[key] = max(frame.get(key, leaf[1]), leaf[1])
        grade = {k: round(value[k] / total[k], 9) for k in total}
        share = {k: 0.92 if frame[k] == 0 else 0.5 for k in grade}
        low = {k for k in grade if seen[k] >= 3 and frame[k] != k and 0.5 <= grade[frame[k]] > grade[k] / share[k]}
        for page, blocks in pages:
            out[page] = "\n".join(b.text for b in framed(blocks) if not low & set(b.path[b.frame :]))
    return out


def test_whole_query_equals_brute_force_and_the_tree_decides(spark):
    rows = made_up_hosts(3)
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_force(rows)
    without_tree = {r[0]: plain(r[2]) for r in rows}
    changed = [i for i in got if got[i] != without_tree[i]]
    assert len(changed) >= 80 and all(got.values())
    host = {r[0]: r[1].split("/")[2] for r in rows}
    large = [i for i in got if host[i] == "h2.example"]
    assert not any("bottom line" in got[i] for i in large) and all(any(p in got[i] for p in without_tree[i].split("\n")) for i in large)
    # a line that every article of the host repeats goes from inside the marked articles too
    assert any("Tell your friends" in without_tree[i] and "Tell your friends" not in got[i] for i in changed)
    # hosts of near copies lose nothing of the articles
    assert all(got[i] == without_tree[i] for i in got if host[i] == "h5.example")


def test_deep_pages_take_linear_time():
    """Depth, stray end tags and open elements far up cost no scan of the stack each."""
    import time

    n = 100_000
    deep = "<article>" + "".join(f"<div class=a{i % 7}>" for i in range(n)) + "<p>inside</p>" + "</div>" * n + "<p>after</p></article>"
    stray = "<div>" * n + "</section></p></li>" * n + "<p>end"
    started = time.process_time()
    assert plain(deep) == "inside\nafter"
    assert plain(stray) == "end"
    assert time.process_time() - started < 12
    texts = "".join(f"<div>{i} " for i in range(20_000))
    found = blocks_of(texts)
    assert len(found) == 20_000 and max(len(b.path) for b in found) <= 128
