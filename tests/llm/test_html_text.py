import html
import re

import pandas as pd
import pytest

from surveylens.llm import html_text

SF = "/root/testdata/sf0.01"


def brute(page):
    """The article of the driver's template."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    texts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in x else "", x)).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert {r.page_id for r in out} == set(pages)
    for r in out:
        assert r.text == brute(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a &lt;&amp;&#233;&nbsp;b</p>", "a <&é b"),
    ("<p>one<p>two <b>bold\n text</b>!<br>x", "one\n\ntwo bold text! x"),
    ("<ul><li>i<li>j</ul><table><tr><td>c<td>d<tr><td>e</table>", "i\n\nj\n\nc\n\nd\n\ne"),
    ("<script>if (a < b) { '</p>' }</script><p>x<style>p{}</style> y</p><!-- <p>no</p> -->", "x y"),
    ("<body><header>H</header><nav>N</nav><div class='main'>text</div><div id=\"cookie-notice\">C</div>"
     "<section class='user comments'><p>R</p></section><aside>A</aside><form>F<p>G</p></form><footer>F</footer>", "text"),
    ("<main><p>kept</p><aside>no</aside></main><p>outside</p>", "kept"),
    ("<article><header><h1>T</h1></header><p>a</p><div role=navigation>n</div></article>", "T\n\na"),
    ("<p>1 < 2 and <3</p>", "1 < 2 and <3"), ("<div title='a > b' class=x>t</div>", "t"),
    ("<article><p>a</div></p><p>b</section>c</article><p>d", "a\n\nb\n\nc"), ("<p>un<i>closed", "unclosed"),
    ("<![CDATA[x]]><!doctype html><?php y ?><p>z", "z"),
])
def test_pages(page, text):
    assert html_text.main_text(page, frozenset()) == text


def site(n, host="h.example"):
    """Pages without an article mark whose frame repeats on every page."""
    rows = []
    for i in range(n):
        body = "".join(f"<p>story {i} part {j} tells of {i * 31 + j} things that happened {i * 7 + j} days ago</p>" for j in range(3))
        rows.append((i, f"http://{host}/{i}", f"<body><div class='top'><p>Welcome to the site of all sites</p></div>"
                        f"<div class='body'>{body}</div><div class='bottom'><p>All of this was made by hand here</p></div></body>"))
    return rows


def test_repeated_branches_of_a_host_go(spark):
    rows = site(30)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    for r in html_text.extract(df).collect():
        assert r.text.count("story") == 3 and "Welcome" not in r.text and "made by hand" not in r.text
    few = spark.createDataFrame(rows[:3], "page_id long, url string, html string")
    assert all("Welcome" in r.text for r in html_text.extract(few).collect())  # too few pages to judge


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, path long"
    rows = [(1, None, None, 1), (2, "not a url", "<p>a", 1), (None, "http://x/", "", 1), (2, "not a url", "<p>a", 1),
            (4, "http://x/", "<p>" + "word " * 50_000, 1)]
    out = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, 0), (2, 1), (2, 1), (4, 249_999)]
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_importance_of_one_and_of_every_page():
    def stats(**rows):
        return pd.DataFrame([{"path": p, "parent": q, "pages": n, "shown": s, "occurrences": o, "repeated": r}
                             for p, (q, n, s, o, r) in rows.items()])
    from math import log
    same = 100 * log(100)
    value = html_text.importances(stats(
        root=("", 100, same, 0, 0), menu=("root", 100, same, 300, 300 * log(100)), story=("root", 100, same, 300, 0.0)))
    assert value["menu"] == 0 and value["story"] == 1 and 0 < value["root"] < 1


def marked_site(n, frame="<p>All of this was made by hand here</p>", first=0):
    rows = []
    for i in range(first, first + n):
        body = "".join(f"<p>story {i} part {j} tells of {i * 31 + j} things that happened {i * 7 + j} days ago</p>" for j in range(3))
        rows.append((i, f"http://m.example/{i}", f"<body><article><div class='tale'>{body}</div><div class='end'>{frame}</div></article></body>"))
    return rows


def extracted(spark, rows):
    return [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]


def test_repeated_block_inside_a_mark_goes(spark):
    for text in extracted(spark, marked_site(30)):
        assert text.count("story") == 3 and "made by hand" not in text
    assert all("made by hand" in t for t in extracted(spark, marked_site(4)))  # the mark outweighs few pages


def test_important_text_beside_a_mark_stays(spark):
    rows = [(i, u, h.replace("</body>", "<article>Read our guide to all sites</article></body>")) for i, u, h in site(30)]
    for text in extracted(spark, rows):
        assert text.count("story") == 3 and "Welcome" not in text and "made by hand" not in text


def test_few_pages_are_judged(spark):
    # a frame on all of 6 pages goes as on 30
    assert all("Welcome" not in t and t.count("story") == 3 for t in extracted(spark, site(6)))


def test_all_shingles_count(spark):
    from math import log
    long = " ".join(f"w{k}" for k in range(400))  # on both pages; 100 words more are the page's own
    rows = [(i, f"http://a/{i}", f"<div>{long} " + " ".join(f"p{i}x{k}" for k in range(100)) + "</div>") for i in range(2)]
    df = spark.createDataFrame([("a", h) for _, _, h in rows], "host string, html string")
    (div,) = [r for r in html_text.style_stats(html_text.style_features(df, 3)).collect() if r.occurrences]
    assert (div.host, div.pages, div.occurrences) == ("a", 2, 2 * 497) and abs(div.repeated - 397 * 2 * log(2)) < 1e-6


STORY = "<h1>Title</h1><p>" + "A story is told here at some length. " * 5 + "</p>"


@pytest.mark.parametrize("page", [
    f"<div class='content has-sidebar'>{STORY}</div>", f"<div id='page' class='with-header'>{STORY}</div>",
    f"<div class='hentry comments-open'>{STORY}</div>", f"<article><div class='social-science'>{STORY}</div></article>",
    f"<div class='share-price'>{STORY}</div><div class='share-buttons'><p>Tell all</p></div>",
    f"<body class='has-widget'><div class='widget-area'><p>w</p></div>{STORY}<div class='ad-slot-3'><p>Buy</p></div></body>",
    f"{STORY}<div class='user comments'><p>{'I do not agree at all. ' * 40}</p></div>",
    f"<div class='header-image-shop'><p>x</p></div>{STORY}<section id='site-footer'><p>y</p></section>",
])
def test_names_that_are_no_verdict(page):
    text = html_text.main_text(page, frozenset())
    assert text == "Title\n\n" + ("A story is told here at some length. " * 5).strip()


@pytest.mark.parametrize("page,blocks", [
    ("<blockquote>" * 60_000 + "x", 1), ("<div>" * 60_000 + "x", 1), ("<a " * 200_000, 1), ("</p>" * 200_000 + "x", 1),
    ("<div class='ad-hoc'>" * 30_000 + "x", 1), ("<li>a" * 60_000, 60_000), ("<p>" + "<b " * 100_000 + "> y", 1),
])
def test_long_and_deep_pages(page, blocks):
    import time
    began = time.perf_counter()
    assert len([b for b in html_text.main_text(page, frozenset()).split("\n\n") if b]) == blocks
    assert time.perf_counter() - began < 20
