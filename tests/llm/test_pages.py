"""Page text and the WARC index."""

import html
import re

import pytest

from isotherm.llm import html_text, warc
from isotherm.session import new_folder

SCHEMA = "page_id long, url string, html string"
ODD = [(1, None, None), (2, "", ""), (3, "http://a.b/x", "<p>"), (3, "http://a.b/x", "<p>"), (4, "no address \n at all é", "plain text, no tags"),
       (None, "https://A.b:8080/q?x=1", "no id"), (5, "http://[bad", "<div>" * 2000 + "deep words here" + "</div>" * 100),
       (6, "http://a.b/x", "<p>" + "long " * 50_000), (7, "u", "a < b &amp; c &lt;d&gt; <"), (8, "u", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS text", "2 AS key", "3 AS first", "4 AS line", "5 AS part")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"<(/?)(p|br|h1)\b[^>]*>", " ", body))
        assert got[r.page_id] == " ".join(html.unescape(body).split())


PAGE = """<html><body><header><h2>Site name</h2></header><div id="cookie-banner">We use cookies here</div><div class="content">
<h1>A title of some words</h1><div>First paragraph of a text that is long enough to be main &amp; good.<p>Second with <b>bo</b>ld&nbsp;text, a
<a href="x">link in a sentence</a> and more words to come<ul><li>an item<li>another item</ul><div class="related-posts">see also these things</div>
<p>Third paragraph of the text with some words in it</div><aside>side things</aside><div id="comments"><p>A reader says hello, this is nice</p></div>
<form>mail <input name="q"><select><option>one</select></form><script>var x = "<p>not text</p>";</script><footer>c 2020</footer></div></body></html>"""


@pytest.mark.parametrize("learned", [False, True])
def test_other_layouts(spark, learned):
    w = html_text.Weights()
    if learned:
        w = html_text.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert html_text.extract(PAGE, w) == (
        "A title of some words First paragraph of a text that is long enough to be main & good. Second with bold text, a link in a sentence and more "
        "words to come an item another item Third paragraph of the text with some words in it")


TEXT = "These are the words of an article that is long enough to be found on the page"


@pytest.mark.parametrize("page, want", [
    (f'<div class="layout no-sidebar"><article><p>{TEXT}</p></article></div>', TEXT),
    (f'<div class="with-sidebar"><p>{TEXT}</p></div>', TEXT),
    (f'<div class="sidebar"><main><p>{TEXT}</p></main></div>', TEXT),
    (f'<form id="aspnet"><article><p>{TEXT}</p></article></form>', TEXT),
    (f'<article><header class="entry-header"><h1>A heading</h1></header><p>{TEXT}</p></article>', f"A heading {TEXT}"),
    (f'<article><header class="header"><h1>A heading</h1></header><p>{TEXT}</p></article>', f"A heading {TEXT}"),
    (f'<div class="main-sidebar"><p>{TEXT}</p></div>', ""),
    (f'<aside><article><p>{TEXT}</p></article></aside>', ""),
    (f'<main><p>{TEXT}</p><div id="comments"><article><p>A reader says hello</p></article></div></main>', TEXT)])
def test_names_of_containers(page, want):
    assert html_text.extract(f"<html><body>{page}</body></html>", html_text.Weights()) == want


def test_labels_overrule_the_list(spark):
    """A class of the list that the labelled pages have inside holds text; one they have outside does not."""
    page = f'<html><body><div class="promo"><p>{TEXT}</p></div><article><div class="widget"><p>{TEXT}</p></div><p>{TEXT}</p></article></body></html>'
    w = html_text.learn(spark.createDataFrame([(i, "u", page) for i in range(10)], SCHEMA))
    bare = f'<html><body><div class="promo"><p>{TEXT}</p></div><div class="widget"><p>One more {TEXT}</p></div></body></html>'
    assert html_text.extract(bare, w) == f"One more {TEXT}" and html_text.extract(bare, html_text.Weights()) == ""
    assert html_text.extract(page, w) == f"{TEXT} {TEXT}"


def test_region_is_the_best_one():
    import itertools
    import random

    rng, w = random.Random(3), html_text.Weights()
    for _ in range(200):
        seq = [html_text.Piece(tag="x") if rng.random() < 0.6 else html_text.Piece(text="w", words=rng.randint(1, 3), apart=rng.random() < 0.3)
               for _ in range(12)]
        score = [w.of_tag(p) if p.tag else w.of_word(p) * p.words for p in seq]
        a, b = html_text.main_region(seq, w)
        best = max([0.0] + [sum(score[i:j]) for i, j in itertools.combinations(range(13), 2)])
        assert sum(score[a:b]) == pytest.approx(best)


def test_page_text_odd(spark, odd, none):
    w = html_text.learn(odd)
    got = html_text.main_text(spark, odd, w).collect()
    assert len(got) == len(ODD) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == by[8] == "" and by[4] == "plain text, no tags" and by[5] == "deep words here"
    assert by[6] == ("long " * 50_000).strip() and by[7] == "a < b & c <d> <"
    assert html_text.main_text(spark, none, html_text.learn(none)).count() == 0


def through_archive(spark, pages, parts=3):
    folder = new_folder(spark, "warc-test")
    manifest = [(r.low, r.high, r.part) for r in warc.archive_pages(spark, pages, folder, parts).collect()]
    return warc.lookup(spark, pages.select("url"), f"{folder}/archives", f"{folder}/index", manifest, parts), folder, manifest


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    data = [(i, f"http://h{i % 7}.example.org/{i % 11}", "same" if i % 3 == 0 else f"page é {i}") for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.page_id: r for r in through_archive(spark, df)[0].collect()}
    assert len(got) == 200
    for i, url, body in data:
        r = got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(body.encode()), warc.digest(body.encode()))
        assert (r.record_type, r.refers_to) == (("revisit", 0) if body == "same" and i else ("response", None))


def test_warc_lookup_of_some_addresses(spark):
    data = [(i, f"http://h.example.org/{i % 5}", f"page {i}") for i in range(50)]
    _, folder, manifest = through_archive(spark, spark.createDataFrame(data, SCHEMA))
    asked = spark.createDataFrame([("http://h.example.org/3",), ("http://h.example.org/3",), ("http://nobody.org/",)], "url string")
    got = warc.lookup(spark, asked, f"{folder}/archives", f"{folder}/index", manifest, 2)
    assert sorted(r.page_id for r in got.collect()) == list(range(3, 50, 5))


def test_warc_odd(spark, odd, none):
    got = through_archive(spark, odd)[0].collect()
    assert len(got) == len(ODD)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    assert kinds.count((3, "response", None)) == 2 and (8, "revisit", 1) in kinds and (2, "revisit", 1) in kinds
    assert {r.url for r in got} == {None if u is None else u for _, u, _ in ODD}
    assert through_archive(spark, none)[0].count() == 0


def test_reversed_keys():
    assert warc.reversed_key("https://www.A.org/x?y") == "org,a,www)/x?y" and warc.reversed_key("http://a.org:81") == "org,a:81)/"
    assert warc.reversed_key(None) == "" and warc.reversed_key("plain") == "plain"
