"""Main text of pages, and the pipeline's stages against plain versions."""

import html
import re
import time

import pytest

from lumicell.llm import html_extract
from tests.llm.util import LOWER, brute_components, documents, words


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them.</div><div class=sidebar><p>Side text, long enough to look real.</p></div>
<article><h1>The &Uuml;ber title</h1><p><b>First  paragraph,&nbsp;with text.<br><p>Second &amp; third; <a href=z>a link</a> in it.</p>
<form><label>Mail</label><input></form><aside>Read this too.</aside></article>
<section id="comments"><p>Great article, thank you very much!</p></section><footer>&copy; 2024</footer></body></html>"""


def test_page_text(spark):
    want = "The Über title\nFirst paragraph, with text.\nSecond & third; a link in it."
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE[:-40]), (4, "u", "just words"), (5, "u", "<div>" * 3000 + "deep text, here."), (6, "u", "<p>x < y &lt;b&gt; &amp;amp;")]
    out = html_extract.extract(spark.createDataFrame([(*p, "t", 5) for p in pages], "page_id bigint, url string, html string, text string, n_chars int"))
    got = [(r.page_id, r.text) for r in out.collect()]
    assert got == [(1, want), (2, ""), (3, ""), (4, want), (4, "just words"), (5, "deep text, here."), (6, "x < y <b> &amp;")]
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0

LONG = "Some words make up this text, and more of them follow here. It goes on for a while; then it ends."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article class="post category-social"><h1>T</h1><p>{LONG}</p><p>Again.</p></article>', f"T\n{LONG}\nAgain."),
        (f'<body class="single has-sidebar"><div class="content has-sidebar"><p>{LONG}</p><p>Again.</p></div><div class="sidebar"><p>Side text, here.</p></div>', f"{LONG}\nAgain."),
        (
            f'<article><header class="entry-header"><h1>Title</h1></header><div class="entry-content"><p>{LONG}</p><ul><li>one<li>two</ul><p>Again, a text.</p></div>'
            '<footer class="entry-footer"><a href=x>tag</a></footer></article><section id="comments" class="comments-area"><p>Nice article, thank you very much!</p></section>',
            f"Title\n{LONG}\none\ntwo\nAgain, a text.",
        ),
        (
            f"<div id=page><div class=menu><a href=a>A</a><a href=b>B</a></div><div id=x><h2>Head</h2><p>{LONG}</p><table><tr><td>1<td>2</table><p>More, again.</p></div>"
            '<div class="post-comments"><p>Nice text, thank you so much for it!</p></div><div id=foot>c 2024</div></div>',
            f"Head\n{LONG}\n1\n2\nMore, again.",
        ),
        (f'<form id=aspnet><div class="main"><p>{LONG}</p><p>Again.</p></div></form>', f"{LONG}\nAgain."),
        ('<p data-x="' + "a" * 3000 + '>LEAK">text here.</p>', "text here."),
        (f"<head><title>x</title><body><p>{LONG}</p>", LONG),
        ("<nav><a href=x>A</a></nav>", ""),
        (f"<p>{LONG}</p><svg><p>{LONG}", f"{LONG}\n{LONG}"),
    ],
)
def test_scores_decide_on_pages_of_other_templates(page, want):
    assert html_extract.main_text(page) == want


def test_threshold_and_marks_change_the_result():
    page = f"<div class=menu><a href=a>A</a></div><div id=x><p>{LONG}</p><p>{LONG}</p></div><div class=ad>Buy this now.</div><div>Short.</div>"
    found = html_extract.blocks(page)
    kept = lambda t: [b.text for b in html_extract.content(found, t)]
    assert kept(html_extract.THRESHOLD) == [LONG, LONG]
    assert kept(0) == ["A", LONG, LONG, "Buy this now.", "Short."] and kept(0.01) not in (kept(0), kept(html_extract.THRESHOLD))


def test_pages_match_a_plain_reading_of_their_article(spark):
    """All pages of a table, whose articles hold only h1, p, b and br."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert got[r.page_id] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_hostile_pages_take_linear_time():
    for page in ("<p a='" * 40_000, "<div>" * 40_000 + "x", "<b>" * 40_000 + "</i>" * 40_000, "<a><p>" * 20_000, "<" * 100_000, "<!--" * 30_000):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 5


# pipeline


def odd_documents(spark):
    """Missing and repeated ids, whole rows that repeat, empty and long texts, a column whose name clashes."""
    item = " ".join(words(30, 500, 3000))
    own = lambda k, n=30: " ".join(f"word{w}" for w in words(n, k, 9000))
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (None, own(1), "en"), (5, own(1).upper(), "en"), (None, f"{own(2)} {item}", "en")]
    rows += [(6, f"{own(3)} {item} tail", None), (6, own(4), "en")] + [(7, own(5, 7), "en")] * 2 + [(8, own(6), "en"), (9, own(6) + " last", "en"), (10, f"{own(7)} " * 3000, "en")]
    return documents(spark, rows), item


def test_stages_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, item = odd_documents(spark)
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = out.collect()
    texts = lambda name: [(r.doc_id, r.text) for r in kept[name]]
    assert {i for i, _ in texts("language_id")} == {None, 5, 6, 7, 8, 9, 10} and len(texts("language_id")) == 10
    # the copy without doc_id goes, one of the two equal rows stays, and both texts of id 6
    assert sorted((i for i, _ in texts("exact_dedup")), key=repr) == sorted([None, 5, 6, 6, 7, 8, 9, 10], key=repr)
    assert sorted((i for i, _ in texts("ngram_jaccard_join")), key=repr) == sorted([None, 5, 6, 6, 7, 8, 10], key=repr)
    # rows that hold the item go, with or without doc_id; the clean text of the same id stays
    assert sorted(i for i, _ in texts("decontamination")) == [5, 6, 7, 8, 10] and all(item not in t for _, t in texts("decontamination"))
    assert {r.doc_id for r in kept["packing"]} == {5, 6, 7, 8, 10}


def test_stages_on_an_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 0")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0


def test_pipeline_matches_plain_versions(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.collect()}
        if name == "language_id":
            assert kept == {i for i, t, _ in rows if re.search(r"[^\W\d_]", t or "")}
        if name == "exact_dedup":
            last = {}
            for i, t, _ in rows:
                last[(t or "").translate(LOWER)] = max(i, last.get((t or "").translate(LOWER), -1))
            assert kept == set(last.values())
        if name == "ngram_jaccard_join":
            assert kept == {i for i, (_, c) in brute_components(rows).items() if c == i}
        if name == "decontamination":
            plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
            items = [plain(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            whole = {i for i, t, _ in rows if any(x in plain(t) for x in items)}
            assert kept == {i for i, _, _ in rows} - whole
        rows = [r for r in rows if r[0] in kept]
        docs = docs.where(docs.doc_id.isin(list(kept)))
    pieces = pipeline.run(spark, d).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == {i for i, _, _ in rows}
