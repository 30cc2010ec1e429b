import html
import re

import pytest

from mixscore.llm import html_tree
from mixscore.llm.extraction import extract_main_text, share_bound
from mixscore.llm.html_tree import is_furniture

PAGES = "page_id long, url string, html string"


def one(spark, page, url="http://a.example/x"):
    return extract_main_text(spark.createDataFrame([(1, url, page)], PAGES)).first()["text"]


def article_by_hand(page):
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    text = re.sub(r"<[^>]*$", "", found[1]) if found else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", text))).split())


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()}
    want = {r["page_id"]: (r["url"], t := article_by_hand(r["html"]), len(t)) for r in pages.collect()}
    assert got == want


def test_furniture_is_left_out_and_inline_text_kept(spark):
    page = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div>
    <main><article><h1>A &amp; B</h1><p>One <b>bo</b>ld<br>line &lt;x&gt; caf&eacute;&nbsp;no&#233;l
    <p>Two<!-- hidden --> words<aside>Side</aside><form><input><button>Send</button></form>
    <ul><li>First<li>Second</ul><table><tr><td>c1<td>c2</table>
    <div class="ad">Buy</div><section id="comments"><p>First!</p></section></article></main>
    <div id=sidebar>More</div><footer>&copy; us</footer></body></html>"""
    assert one(spark, page) == "A & B One bold line <x> café noél Two words First Second c1 c2"


def test_names_of_a_layout_and_comments_that_are_articles(spark):
    page = """<body class="has-sidebar"><form id="page"><div class="wrap no-sidebar menu"><article class="post with-comments">
    <h1>Title</h1><p>Text of the article.</p></article><section id="comments"><article class="comment-12 comment">
    <p>A reader writes a very long comment, longer than the text.</p></article></section></div></form></body>"""
    assert one(spark, page) == "Title Text of the article."


def test_a_wrapper_without_names(spark):
    """Ten pages of one host: constant and turning parts go without a telling tag or class."""
    rows = []
    for i in range(30):
        body = "".join(f"<p>Story {i} says thing {j} at some length here.</p>" for j in range(2 + i % 3))
        rows.append((i, f"http://site.example/{i}", f"<body><div class=top><div>Welcome to the site</div><div>Tip {i % 4}</div></div><div class=text>{body}<p>Read us daily</p></div></body>"))
    rows += [(100 + i, "http://site.example/copy", rows[0][2]) for i in range(200)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(30):
        assert got[i] == " ".join(f"Story {i} says thing {j} at some length here." for j in range(2 + i % 3))
    assert {got[100 + i] for i in range(200)} == {got[0]}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_limited_vocabulary_is_kept_on_small_and_large_hosts(spark, tag):
    """Bylines of 20 authors and passages that pages share, on hosts of 20 and 5,000 pages."""
    rows = []
    for pages in (20, 5000):
        for i in range(pages):
            text = f"<h2>By author {i % 20}</h2><p>Shared passage {i % 20}, told at length.</p><section>Page {i} alone has this.</section>"
            rows.append((i, f"http://host{pages}.example/{i}", f"<body><{tag} class=text>{text}</{tag}><div class=tip><div>Tip {i % 2}</div></div></body>"))
    got = {(r["page_id"], r["url"]): r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for pages in (20, 5000):
        for i in range(pages):
            want = f"By author {i % 20} Shared passage {i % 20}, told at length. Page {i} alone has this."
            assert got[(i, f"http://host{pages}.example/{i}")] == want


def test_near_copies_keep_their_paragraphs(spark):
    """Pages that differ in one paragraph, 95 of 100: one-off paragraphs of the same slot stay on all."""
    rows, want = [], {}
    for i in range(100):
        shared = [f"Passage {i % 3} number {j} that many pages share." for j in range(12)] if i < 95 else []
        texts = [*shared, f"Own {i}."]
        rows.append((i, "http://site.example/x", "<body><div class=text>" + "".join(f"<p>{t}</p>" for t in texts) + "</div></body>"))
        want[i] = " ".join(texts)
    assert {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_title_and_intro_beside_the_body(spark):
    rows, want = [], {}
    for i in range(30):
        title, intro, body = f"Title {i}", f"Intro number {i} tells what follows.", f"Body {i} says a lot more, at length. " * 12
        rows.append((i, f"http://site.example/{i}", f"<body><div>Welcome</div><div class=content><h1>{title}</h1><div class=intro>{intro}</div><div class=body><p>{body}</p></div></div></body>"))
        want[i] = f"{title} {intro} {body.strip()}"
    assert {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_cut_off_null_empty_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "in the deep"
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    rows = [
        (1, "http://a.example/", "<article><p>Cut off in a ta<b"), (2, "http://b.example/", "<article><p>Half &am"),
        (3, None, "<p>no address</p>"), (4, "http://c.example", None), (5, "http://c.example", ""), (6, "odd", "just text"),
        (7, "http://d.example", deep), (8, "http://e.example", long), (9, "http://f.example", "<p title=\"open>x</p>"),
        (None, "http://g.example", "<p>no id</p>"), (10, "http://h.example", "<p>same</p>"), (10, "http://h.example", "<p>same</p>"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{PAGES}, host string, text int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(df).collect()]
    by_id = {i: t for i, t, _ in got}
    assert by_id[1] == "Cut off in a ta" and by_id[2] == "Half &am" and by_id[3] == "no address"
    assert by_id[4] == by_id[5] == "" and by_id[6] == "just text" and by_id[7] == "in the deep"
    assert by_id[8] == " ".join(["word word"] * 20000) and by_id[9] == "x" and by_id[None] == "no id"
    assert [t for i, t, _ in got if i == 10] == ["same", "same"]
    assert all(len(t) == n for _, t, n in got)
    assert extract_main_text(df.limit(0)).collect() == []


def test_text_after_a_closed_deep_nest_stays_in_the_article(spark):
    deep = "<div>" * 120 + "deep" + "</div>" * 120
    page = f"<body><div><article><p>before</p>{deep}<p>after the deep nest</p></article></div><div>outside</div></body>"
    assert one(spark, page) == "before deep after the deep nest"


def tree(text):
    """'a(b c(d))' as a tree."""
    root, stack = html_tree.Node("#"), []
    stack.append(root)
    for token in re.findall(r"\w+|[()]", text):
        if token == "(":
            stack.append(stack[-1].kids[-1])
        elif token == ")":
            stack.pop()
        else:
            stack[-1].kids.append(html_tree.Node(token))
    return root.kids[0]


@pytest.mark.parametrize(
    "a, b, size",
    [("a(b c)", "a(b c)", 3), ("a(b c)", "x(b c)", 0), ("a(b c d)", "a(c)", 2), ("a(b(x y) c)", "a(b(y) b(x y))", 4), ("a(b c)", "a(c b)", 2)],
)
def test_simple_tree_matching(a, b, size):
    assert html_tree.matching(tree(a), tree(b)) == size


def test_merging_inserts_in_order():
    merged = tree("a(b d)")
    other = tree("a(b c d(e) f)")
    html_tree.absorb(merged, other)
    assert html_tree.read(merged.text()).text() == tree("a(b c d(e) f)").text()
    assert [n.found().label for n in other.preorder()] == ["a", "b", "c", "d", "e", "f"]
    root = html_tree.Node("r", [tree("p"), tree("p(x)"), tree("q"), tree("p")])
    assert html_tree.fold(root).text() == html_tree.Node("r", [tree("p(x)"), tree("q"), tree("p")]).text()


PROBE = (
    '<html><body><nav>Home News</nav><div class="cookie-banner">We use cookies</div><article><h1>Soup {i}</h1>'
    '<h2>Ingredients</h2><ul><li>{i} onions</li></ul><h2 id="side-effects">Side effects</h2><h2 id="related-work">Related work</h2>'
    '<h2 class="navy">Navy beans</h2><section id="social-history"><p>History of soup {i}</p></section>'
    '<div class="box">Stir well.</div><p class="alert">Hot number {i}</p><p>Energy <math><mi>E</mi><mo>=</mo><mn>{i}</mn></math></p>'
    '<div class="share">Tell friends</div><div id="comments"><p>Comment of reader {i}</p></div></article>'
    '<div class="related-posts">More soups</div><footer>Imprint</footer></body></html>'
)


@pytest.mark.parametrize("n", [1, 9, 10, 400])
def test_the_article_is_whole_on_hosts_of_any_size(spark, n):
    rows = [(i, f"http://soup{n}.example/{i}", PROBE.replace("{i}", str(i))) for i in range(n)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        i = r["page_id"]
        assert r["text"] == (
            f"Soup {i} Ingredients {i} onions Side effects Related work Navy beans History of soup {i} Stir well. "
            f"Hot number {i} Energy E={i}"
        )


def test_names_count_by_where_they_stand():
    assert is_furniture("div related-posts") and is_furniture("div site-footer") and is_furniture("div #main-nav")
    assert not is_furniture("section #social-history") and not is_furniture("h2 side") and not is_furniture("p navy")
    assert is_furniture("div comments", inside=True) and is_furniture("div #comments", inside=True)
    assert not is_furniture("p alert", inside=True) and not is_furniture("section #related-work", inside=True)


def test_bounds_on_shares_tighten_with_pages():
    low = [share_bound(n, n) for n in (1, 2, 5, 9, 10, 100, 5000)]
    assert low == sorted(low) and low[0] < 0.5 and low[-1] > 0.99
    assert share_bound(90, 100) > 0.8 and share_bound(3, 10, upper=True) > 0.5 > share_bound(30, 100, upper=True)
