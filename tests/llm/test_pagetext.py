"""Main texts of pages: markup of many kinds, hosts that agree, and the supplied pages against a plain reading of theirs."""

import re
import time
from html import unescape
from pathlib import Path

import pytest

from landsift.llm import pagetext, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"


def words(n, name="word"):
    return " ".join(f"{name}{i}" for i in range(n)) + "."


A, B, C = words(30, "a"), words(25, "b"), words(20, "c")
SURROUND = f"<div id='cookie-notice'>{words(60)}</div><header><h1>Site</h1></header><nav><a href='/'>{words(40)}</a></nav>{{}}<aside>{words(50)}</aside><form><p>{words(30)}</p></form><footer>{words(9)}</footer>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><h1>T</h1><p>{A}</p><p>{B}</p></article>", f"T\n\n{A}\n\n{B}"),
        (f"<main><h1>T</h1><p>{A}<p>{B}<ul><li>x<li>y</ul></main>", f"T\n\n{A}\n\n{B}\n\nx\n\ny"),
        (f"<div class='wrap with-sidebar'><div class='post-body'><h2>T</h2><p>{A}</p><blockquote>{B}</blockquote></div><div class='sidebar'><p>{words(200)}</p></div></div>", f"T\n\n{A}\n\n{B}"),
        (f"<div id=content><p>{A}</p><div class='ad-box'>{words(90)}</div><p>{B}</p></div><div id=comments><p>{words(300)}</p></div>", f"{A}\n\n{B}"),
        (f"<article><header><h1>T</h1><a href=x>share</a></header><section><p>{A}</p></section><section><p>{B}</p></section><section class=comments><article><p>{words(400)}</p></article></section></article>", f"T\n\n{A}\n\n{B}"),
        (f"<table><tr><td class=menu>{words(30)}<td><p>{A}<p>{B}</table>", f"{A}\n\n{B}"),
        (f"<article><p>{A}&nbsp;&amp; &lt;b&gt; &#233;&eacute;</p><script>var t = '</p>{words(90)}';</script><style>p {{}}</style><!-- {words(80)} --><p>x<br>y <b>bold</b>er\n\t z</p></article>", f"{A} & <b> éé\n\nx y bolder z"),
        (f"<article hidden>{words(200)}</article><article><p>{A}</p></article>", A),
        (f"<article><p><b>{A}<br><p>{B}</p></article>", f"{A}\n\n{B}"),
    ],
)
def test_markup_of_many_kinds(html, text):
    assert pagetext.Page(f"<!DOCTYPE html><html><head><title>x</title></head><body>{SURROUND.format(html)}</body></html>").main([]) == text


def test_the_form_around_a_page_is_no_form():
    assert pagetext.Page(f"<body><form><nav>{words(9)}</nav><main><article><p>{A}</p></article></main><input></form></body>").main([]) == A


@pytest.mark.parametrize(("html", "text"), [("", ""), ("   ", ""), ("plain &lt; text", "plain < text"), ("a < b", "a < b"), ("<p>cut <b>off <a href='x", "cut off"), ("<!-- open <p>x</p>", ""), ("<nav>menu</nav>", ""), ("</p></div>x", "x")])
def test_odd_pages(html, text):
    assert pagetext.Page(html).main([]) == text


@pytest.mark.parametrize("part", ["<div>", "<a '", "<p><b>x", "<td><table>", "<!--", "<script>", "<li><ul>", "</b>", "<"])
def test_long_odd_pages_take_linear_time(part):
    start = time.time()
    pagetext.Page(part * 30_000).main([])
    assert time.time() - start < 20


def page(i, host, html):
    return (i, f"https://{host}/p/{i}", html)


def test_a_host_decides_where_its_text_is(spark):
    """One page has more text beside its article than in it; its host's other pages say where to look."""
    layout = "<div class='c{}'><p>{}</p></div><div class='x'><p>{}</p></div>"
    rows = [page(i, "One.example", layout.format(i, words(40, f"p{i}_"), "short")) for i in range(9)]
    rows += [page(50, "one.example", layout.format(50, A, words(200))), page(51, "two.example", layout.format(51, A, words(200)))]
    rows += [page(60 + i, "one.example", f"<article><p>{B}</p></article>") for i in range(2)]  # another template of the host
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[50] == A and got[51] == words(200) and got[60] == got[61] == B and got[3] == words(40, "p3_")


def test_paths_joined_give_what_paths_broadcast_give(spark):
    rows = [page(i, f"h{i % 7 if i % 3 else 0}.example", f"<div class='c'><p>{words(20 + i % 5)}</p></div><div class='x'><p>{words(i % 60)}</p></div>") for i in range(300)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(pagetext.extract(pages).collect()) == sorted(pagetext.extract(pages, most_broadcast=0).collect())


def test_nulls_repeats_clashes_and_no_page(spark):
    rows = [(1, None, f"<article><p>{A}</p></article>"), (2, "no url", None), (None, "http://x/", f"<main>{B}</main>"), (1, None, f"<article><p>{A}</p></article>"), (3, "http://x/", "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    expected = sorted([(1, None, A, len(A)), (1, None, A, len(A)), (2, "no url", "", 0), (None, "http://x/", B, len(B)), (3, "http://x/", "", 0)], key=str)
    assert sorted(map(tuple, pagetext.extract(pages).collect()), key=str) == expected
    clash = pages.selectExpr("*", "1 host", "2 paths", "3 text", "4 size", "5 votes")
    assert sorted(map(tuple, pagetext.extract(clash).collect()), key=str) == expected
    assert pagetext.extract(pages.limit(0)).collect() == []


def test_a_page_of_megabytes(spark):
    paragraphs = [words(2000, f"k{i}_") for i in range(120)]
    html = f"<nav>{words(99)}</nav><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article>"
    assert pagetext.extract(spark.createDataFrame([page(1, "h", html)], SCHEMA)).first().text == "\n\n".join(paragraphs)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_supplied_pages_against_a_plain_reading(spark):
    def plain(html):
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article)]
        return "\n\n".join(b for b in (" ".join(unescape(b).split()) for b in blocks) if b)

    got = queries.queries()["op12_page_text"](spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
