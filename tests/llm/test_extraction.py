"""Main text of pages: markup, differencing against neighbours, copies, edge cases."""

import random
import re

import pytest

from weftgraph.llm import extraction, queries
from weftgraph.llm.pages import ARTICLE, CHROME, lcs, page_lines

SF = "/root/testdata/sf0.001"


def texts(spark, rows, **more):
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, drop int")
    return {r["page_id"]: r["text"] for r in extraction.main_texts(pages, **more).collect()}


def test_given_pages_keep_their_article(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.QUERIES["op13_html_extraction"](spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        body = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def site(body, n):
    return (f"<html><body><div class=x1><p>Acme Times</p><p>All the news every day for everyone in the whole wide town</p></div><div class=x2>{body}</div>"
            f"<div class=x3><p>Call us now</p><p>page {n}</p></div></body></html>")


def test_unnamed_site_lines_go(spark):
    rows = [(f"http://h.example/a/{i}", site(f"<h2>Story {i}</h2><p>Only page {i} says this.</p><p>Another line of {i}.</p>", i)) for i in range(7)]
    for i, text in texts(spark, rows).items():
        assert text == f"Story {i} Only page {i} says this. Another line of {i}. page {i}"


def test_shared_paragraph_inside_own_text_stays(spark):
    quote = "<p>" + " ".join(f"word{i}" for i in range(20)) + "</p>"
    rows = [(f"http://h.example/{i}", site(f"<p>First of {i}</p>{quote}<p>A long last line of page number {i} with words of its own, more of them than the quote has, as one {i}.</p>", i)) for i in range(4)]
    assert all("word0 word1" in text and "Acme" not in text for text in texts(spark, rows).values())


def test_copies_keep_their_text(spark):
    body = "<p>" + " ".join(f"word{i}" for i in range(40)) + "</p>"
    same = [(f"http://h.example/{i}", f"<body><div>{body}</div><div>menu</div></body>") for i in range(9)]  # one page to all of them
    near = [(f"http://n.example/{i}", f"<body><div><!-- {i} -->{body}</div><div><p>menu</p>{'<i></i>' * i}</div></body>") for i in range(9)]
    declared = [(f"http://d.example/{i}", f"<body><p>menu</p><article>{body}<p>tail {i}</p></article></body>") for i in range(9)]
    found = texts(spark, same + near + declared)
    assert all("word0" in text for text in found.values())
    assert all(found[18 + i].endswith(f"word39 tail {i}") and "menu" not in found[18 + i] for i in range(9))


def test_markup(spark):
    page = ("<!DOCTYPE html><title>T</title><style>p{}</style><script>var a='</p><p>no';</script><nav>menu</nav><header><h1>Site</h1></header><div id='cookie-notice'>"
            "We use</div><article><header><h1>Head</h1><p>by me</p></header><p>One<b>two</b> &amp &eacute;&#x41;\n\t three<p>Fo&shy;ur<br>five<aside>side</aside><form>f<input></form>"
            "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><article>reply</article><section class='post comments'>c</section></article><footer>foot</footer><!-- p <p>no</p>")
    found = texts(spark, [("u", page), (None, None), ("http://[bad", "<p>x"), ("http://h/", ""), ("http://h/1", "plain < text & more"), ("http://h/2", "<p>cut <a href="),
                          ("http://h/3", "<div style='display: none'>x</div><p hidden>y</p>z"), ("http://h/4", "<script>never ends <p>x")])
    assert found == {0: "Head Onetwo & éA three Fo­ur five a b c d", 1: "", 2: "x", 3: "", 4: "plain < text & more", 5: "cut", 6: "z", 7: ""}


def test_empty_and_long_and_repeated(spark):
    long = "<article>" + "".join(f"<p>line {i} &lt;</p>" for i in range(60_000)) + "</article>"
    rows = [("http://h/1", long)] * 2 + [("http://h/2", "<p>x</p>" * 3000), ("http://h/3", "<p>x</p>" * 3001 + "<p>own</p>")]
    found = texts(spark, rows)
    assert found[0] == found[1] == " ".join(f"line {i} <" for i in range(60_000))
    assert found[3] == "x own"  # one line more than its neighbour has
    assert extraction.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_neighbours_do_not_depend_on_groups(spark, monkeypatch):
    rows = [(f"http://h{i % 3}.example/a/{i:03}", site(f"<p>text {i}</p><p>more {i}</p>" + f"<p>part {i % 5}</p>", i)) for i in range(60)]
    want = texts(spark, rows)
    monkeypatch.setattr(extraction, "GROUP", 3)
    assert texts(spark, rows) == want


def plain_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(200))
def test_lcs(seed):
    from weftgraph.llm.pages import _aligned

    r = random.Random(seed)
    a, b = ([r.randrange(r.choice([2, 5, 30])) for _ in range(r.randrange(25))] for _ in range(2))
    x, y = lcs(a, b)
    assert [a[i] for i in x] == [b[j] for j in y] and x == sorted(set(x)) and y == sorted(set(y)) and len(x) == plain_length(a, b)
    halved = _aligned(a, b, 4)
    assert len(halved) == plain_length(a, b) and all(a[i] == b[j] for i, j in halved)


def test_named_article_is_marked():
    kinds = [line.kind & (ARTICLE | CHROME) for line in page_lines("<main><p>a</p><aside>b</aside></main><p>c")]
    assert kinds == [ARTICLE, ARTICLE | CHROME, 0]
