import html
import re
import time

import pytest
from pyspark.sql import functions as F

from valuefit.llm.html_text import extract_text, main_text

LONG = "This is a sentence of the article, with commas, that goes on for some time so that it counts."
AROUND = """<!DOCTYPE html><html><head><title>T, t</title><style>p{}</style><script>if (a < b) x("</p><p>");</script></head>
<body class="has-header"><header><h1>The site</h1></header><nav><ul><li><a href=/a>Menu, one</a><li><a href=/b>Menu two</a></ul></nav>
<div id="cookieNotice">We use cookies, many of them, for all kinds of reasons, and we always tell you that we do.</div>
<!-- <p>commented, out</p> --><div class="top-banner ad">Buy this, now.</div>
%s
<aside><p>Aside, from all that, there is more to read, in other places, than this.</p></aside>
<section id="comments"><article><p>A reader comment, long enough, to have points, of its own, and so on and on.</p></article></section>
<form action=/s><label>Name, please</label><input name=q><select><option>One<option>Two</select><button>Send</button></form>
<div hidden>not, shown</div><div style="display: none">nor, this</div><noscript>No script, sorry</noscript><svg><text>s</text></svg>
<footer>&copy; us, 2020</footer><script>end()</script></body></html>"""


def bodies():
    p = f"<p>{LONG}</p>"
    yield f"<article><h2>Title</h2>{p}{p}<ul><li>one<li>two</ul></article>", ["Title", LONG, LONG, "one", "two"]
    yield f"<main><h2>Title</h2>{p}{p}</main>", ["Title", LONG, LONG]
    yield f'<div class="page"><div class="post-content">{p}<p>short.<p>{LONG}</div></div>', [LONG, "short.", LONG]
    yield f"<div><div>{p}</div><div>{p}{p}</div></div>", [LONG] * 3
    yield f"<article><section>{p}{p}</section><section>{p}</section></article>", [LONG] * 3
    yield f"<table><tr><td><ul><li><a href=a>x</a></ul><td>{p}{p}<blockquote>quoted</blockquote></table>", [LONG, LONG, "quoted"]
    yield f"<article>{p}<table><tr><th>a<th>b<tr><td>1<td>2</table>tail</article>", [LONG, "a", "b", "1", "2", "tail"]
    yield f'<article>{p}<ul><li><a href=1>r one</a><li><a href=2>r two</a><li><a href=3>r three</a></ul><div class="share-bar">Share</div>{p}</article>', [LONG, LONG]
    yield "<article>Tiny.</article>", ["Tiny."]
    yield f"<article><p><b>un<br>closed &amp; <i title='a > b'>sp&eacute;cial</i>&nbsp;&#x41;&lt;\n\t tag&gt;<p>{LONG}<span class=ad>Buy <span>me</span> now</span>.</article>", ["un closed & spécial A< tag>", LONG + "."]
    yield f"<div class='ad'>open<article>{p}</article></div>", [LONG]
    yield f"{LONG}<br>{LONG}", [f"{LONG} {LONG}"]
    yield f'<div class="layout-with-sidebar"><div class="sidebarLayout"><main class="comment-free">{p}</main><div class="sidebar">{p}</div></div></div>', [LONG]
    yield f'<nav><main>{p}{p}</main></nav><div class="x">{p}</div>', [LONG]


@pytest.mark.parametrize("body,want", list(bodies()))
def test_articles_among_everything_else(body, want):
    assert main_text(AROUND % body)[0].split("\n") == want


@pytest.mark.parametrize("page", ["", "   ", "<", "<a", "<p", "<!--", "<!", "</", "<script>", "<p a='", "<style>x", "<nav>a, b", "&", "<div class=ad>x</div>", None, "</p></div>", "\x00"])
def test_pages_of_nothing(page):
    text, container, score, n = main_text(page)
    assert text in ("", "<", "</", "&", "\x00") and (container is None) == (text == "") == (n == 0)


def test_no_markup_is_one_run():
    assert main_text(" a, b\n c < d & e &lt; f ")[0] == "a, b c < d & e < f"


@pytest.mark.parametrize("unit", ["<div>", "<p>", "<b>", "<li>", "<ul><li>", "<a href='", '<a b="x>', "<span class=ad>", "</div>", "<svg>", "<table><tr><td>", "<ul><li>a, b. ", "<span class=ad><a href=x>", "<div>a, <p>b", "<p>a, b.</p>", "<!--", "<![", "&amp", "<a <a ", "<div>x</p>", "a, ", "<x y='\">"])
def test_time_is_linear_in_the_page(unit):
    main_text(unit * 100)
    start = time.process_time()
    main_text(unit * 60_000)
    assert time.process_time() - start < 12


def test_rows_of_pages(spark, tmp_path):
    page = AROUND % f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "own"), (1, "u", page, "own"), (2, None, None, None), (None, "v", "", "own"), (3, "w", "<p>" + "long, words " * 200_000, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("score", F.lit("own")).withColumn("list", F.array(F.lit(1)))
    out = extract_text(pages)
    assert out.columns == [*pages.columns, "_text", "n_chars", "container", "_score", "n_blocks"]
    got = sorted((str(r["page_id"]), r["_text"], r["n_chars"], r["container"], r["n_blocks"], r["text"], r["score"]) for r in out.collect())
    article = ("1", LONG, len(LONG), "article", 1, "own", "own")
    assert got[:3] == [article, article, ("2", "", 0, None, 0, None, "own")]
    assert got[3][1] == ("long, words " * 200_000).strip() and got[4] == ("None", "", 0, None, 0, "own", "own")
    assert extract_text(pages.limit(0)).count() == 0


def test_given_pages_against_their_article_element(spark):
    """All pages of the small table keep their text in one ``article`` of headings, paragraphs and breaks."""
    import __spark_entry__

    sf_dir = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = __spark_entry__.queries()["op11_html_text"](spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        want = "\n".join(x for x in blocks if x)
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))
