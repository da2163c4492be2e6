from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions.markup import Rule, extract_records, html_to_text
from corpusloom.operators.extract import contents_rows, extract_articles, item_links, links_ending, next_page
from corpusloom.session import staged_path
from corpusloom.sources.ris import read_ris, ris_articles
from corpusloom.operators.store import rejected_items, valid_items

ARTICLE_PAGE = """<html><body><a id="articlePdf" class="x" href="/track/pdf/1.pdf">PDF</a>
<main class="c-content-layout__main other"><p class="ArticleDOI"><a href="#">https://doi.org/10.1186/s40494-018-1</a></p>
<div class="ArticleCategory">Research</div><h1 class="ArticleTitle">On <em>metal</em> &amp; glass</h1>
<div class="AuthorNames"><ul><li><span class="AuthorName">Ada&nbsp;B.</span></li><li><span class="AuthorName">Cyd D.</span></li></ul></div>
<div class="ArticleHistory"><p class="HistoryOnlineDate">Published: 3 June 2018</p></div>
<section class="Abstract"><div><p class="Para">First <b>part</b>.</p><p class="Para">Second.</p></div></section>
<section class="KeywordGroup"><div><span>zinc</span><span>patina</span></div></section>
<script>var hidden = "</p>";</script></main></body></html>"""

LIST_PAGE = """<ol class="c-list-group"><li class="c-list-group__item"><a href="/a1">x</a><a href="/a2">y</a></li>
<li class="c-list-group__item"><a href="/b1">x</a></li></ol>
<a class="c-search-navbar__pagination-link--next" href="/articles?page=2">Next</a>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_article_page(spark):
    row = extract_articles(pages(spark, ARTICLE_PAGE), 1530002937).collect()[0]
    assert row["id"] == "s40494-018-1"
    assert row["title"] == "On metal & glass"
    assert row["authors"] == ["Ada B.", "Cyd D."]
    assert row["abstract"] == "First part."
    assert row["release_date"] == "Published: 3 June 2018"
    assert row["article_type"] == "Research"
    assert row["file_url"] == "/track/pdf/1.pdf"
    assert row["keywords"] == ["zinc", "patina"]
    assert row["last_update"] == 1530002937
    assert "Second." in row["fulltext"] and "hidden" not in row["fulltext"]


def test_page_without_id_is_rejected_and_not_an_error(spark):
    bare = '<main class="c-content-layout__main"><h1 class="ArticleTitle">T</h1></main>'
    rows = extract_articles(pages(spark, bare, "<p>nothing here", None), 1)
    assert [r["reason"] for r in rejected_items(rows).collect()] == ["id missing"]
    assert valid_items(rows).count() == 0


def test_links(spark):
    rows = item_links(pages(spark, LIST_PAGE), "https://example.org").collect()
    assert [(r["path"], r["url_next"]) for r in rows] == [("/a2", "https://example.org/a2"), (None, None)]
    got = next_page(pages(spark, LIST_PAGE, "<p>last</p>"), "https://example.org").orderBy("page_id").collect()
    assert [r["url_next"] for r in got] == ["https://example.org/articles?page=2", None]


def test_contents_table_and_pdf_links(spark):
    toc = """<table class="tocArticle"><tr><td><div class="tocTitle"><a href="/v">One</a></div>
    <div class="tocAuthors">A, B</div><div class="tocGalleys"><a class="file" href="/one.pdf">PDF</a></div></td></tr></table>
    <table class="tocArticle"><tr><td><div class="tocTitle"><a href="/w">Two</a></div></td></tr></table>"""
    rows = contents_rows(pages(spark, toc)).collect()
    assert [(r["title"], r["author"], r["link"]) for r in rows] == [(["One"], ["A, B"], "/one.pdf"), (["Two"], [], None)]
    assert links_ending(pages(spark, toc)).collect()[0]["file_urls"] == ["/one.pdf"]


def test_nested_scopes_and_unclosed_tags(spark):
    html = "<ul><li>a<a href=1></a><ul><li>b<a href=2></a></li></ul></li><li>c<br>d"
    record = extract_records(F.col("html"), [Rule("text", "li"), Rule("href", "a", "@href")], "li")
    got = pages(spark, html).select(record.alias("r")).collect()[0]["r"]
    assert [r["href"] for r in got] == [["1", "2"], ["2"], []]
    assert got[0]["text"] == ["ab", "b"] and got[2]["text"] == ["cd"]


def test_html_to_text(spark):
    html = "<style>p{}</style><!-- x --><p>a &lt; b<br>c</p><script>if (a<b) {}</script>"
    assert pages(spark, html).select(html_to_text(F.col("html")).alias("t")).collect()[0]["t"] == "a < bc"


def test_ris(spark):
    text = """TY  - JOUR
AN  - AATA 1+2
TI  - Original
TT  - Translated
AU  - One, A.
AU  - Two, B.
AB  - First line
 second line
PY  - 1999
KW  - zinc
KW  - patina
ER  - 

TY  - BOOK
AN  - X 3
TI  - Only title
ER  - 
TY  - BOOK
TI  - No accession
ER  - 
TY  - BOOK
AN  - 4
ER  - 
"""
    path = staged_path(spark, "ris")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rows = ris_articles(read_ris(spark, path), 7)
    got = {r["article_type"] + str(r["id"]): r for r in rows.collect()}
    first = got["JOURAATA12"]
    assert (first["title"], first["authors"], first["keywords"]) == ("Translated", ["One, A.", "Two, B."], ["zinc", "patina"])
    assert (first["abstract"], first["release_date"], first["last_update"]) == ("First line second line", "1999", 7)
    only = got["BOOKX3"]
    assert (only["title"], only["authors"], only["abstract"]) == ("Only title", None, None)
    assert sorted(r["reason"] for r in rejected_items(rows).collect()) == ["id missing", "title missing"]
    assert valid_items(rows).count() == 2


def selected(spark, html, selector, take="text"):
    record = extract_records(F.col("html"), [Rule("x", selector, take)])
    return pages(spark, html).select(record[0]["x"].alias("x")).first()["x"]


def test_end_tags_may_be_left_out(spark):
    assert selected(spark, "<ul><li>a<li>b</ul>", "li") == ["a", "b"]
    assert selected(spark, "<p>one<p>two<div>three</div>", "p") == ["one", "two"]
    assert selected(spark, "<p><b>one<br><p>two", "p") == ["one", "two"]
    assert selected(spark, "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "li") == ["abc", "b", "c", "d"]
    assert selected(spark, "<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table></table>", "td") == ["a", "b", "cd", "d"]
    assert selected(spark, "<table><thead><tr><th>a<tbody><tr><td>b</table>", "tbody") == ["b"]
    assert selected(spark, "<dl><dt>a<dd>b<dt>c</dl>", "dt") == ["a", "c"]
    assert selected(spark, "<select><optgroup><option>a<option>b<optgroup><option>c</select>", "option") == ["a", "b", "c"]


def test_children_and_lists_of_selectors(spark):
    html = "<div><p>a</p><section><p>b</p></section></div><h1>c</h1>"
    assert selected(spark, html, "div > p") == ["a"]
    assert selected(spark, html, "div p") == ["a", "b"]
    assert selected(spark, html, "section>p, h1") == ["b", "c"]
    assert selected(spark, "<div><div><p>a</p></div></div>", "div > div > p") == ["a"]
    assert selected(spark, "<a href='x>y,z'>a</a>", "a[href='x>y,z']") == ["a"]


def test_pages_of_a_batch_are_returned_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(markup, "PAGES", 2)
    rows = [(i, None if i == 3 else "" if i == 4 else f"<p>a{i}<b>x</b><p>b{i}") for i in range(7)]
    found = spark.createDataFrame(rows, "i int, html string").coalesce(1).select("i", extract_records(F.col("html"), [Rule("p", "p"), Rule("b", "b", "own")]).alias("r"))
    for r in found.collect():
        if r["i"] == 3:
            assert r["r"] is None
        else:
            assert [x.asDict() for x in r["r"]] == [{"p": [], "b": []} if r["i"] == 4 else {"p": [f"a{r['i']}x", f"b{r['i']}"], "b": ["x"]}]
