"""Pages to article rows and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.markup import Rule, extract_records, first
from corpusloom.functions.text import absolute_url, strip_doi_prefix

# Markup of the journal pages this is used for.
DOI_PREFIX = "https://doi.org/10.1186/"
ARTICLE_SCOPE = "main.c-content-layout__main"
ARTICLE_RULES = (
    Rule("id", "p.ArticleDOI a", "own"),
    Rule("title", "h1.ArticleTitle"),
    Rule("authors", "div.AuthorNames li span.AuthorName", "own"),
    Rule("abstract", "section.Abstract .Para"),
    Rule("release_date", "div.ArticleHistory p.HistoryOnlineDate", "own"),
    Rule("article_type", "div.ArticleCategory", "own"),
    Rule("fulltext", "main"),
    Rule("file_url", 'a[id="articlePdf"]', "@href", anywhere=True),
    Rule("keywords", "section.KeywordGroup div *", "own"),
)
LIST_ITEM_SCOPE = "ol.c-list-group li.c-list-group__item"
NEXT_PAGE = "a.c-search-navbar__pagination-link--next"
CONTENTS_SCOPE = "table.tocArticle"
CONTENTS_RULES = (
    Rule("title", "div.tocTitle a", "own"),
    Rule("author", "div.tocAuthors", "own"),
    Rule("link", "div.tocGalleys a.file", "@href"),
)
PDF_LINKS = 'a[href$=".pdf"]'

LISTS = ("authors", "keywords")


def _one_record(pages: DataFrame, rules, scope: str | None) -> DataFrame:
    """A row per record of every page, other page columns kept."""
    keep = [c for c in pages.columns if c != "html"]
    records = extract_records(F.col("html"), list(rules), scope)
    return pages.select(*keep, F.explode(records).alias("r"))


def extract_articles(
    pages: DataFrame,
    run_ts: int,
    rules=ARTICLE_RULES,
    scope: str | None = ARTICLE_SCOPE,
    doi_prefix: str = DOI_PREFIX,
) -> DataFrame:
    """Article rows from pages by a table of rules; all rows carry the stamp of the run.

    Fields without a rule are NULL. A missing id or title stays NULL here and is
    rejected by ``valid_items``.
    """
    given = {rule.field for rule in rules}
    rows = _one_record(pages, rules, scope)

    def field(name: str):
        if name not in given:
            return F.lit(None).cast("array<string>" if name in LISTS else "string")
        value = F.col(f"r.{name}")
        return value if name in LISTS else first(value)

    return rows.select(
        strip_doi_prefix(field("id"), doi_prefix).alias("id"),
        *[field(n).alias(n) for n in (
            "title", "authors", "abstract", "release_date", "article_type",
            "fulltext", "file_url", "keywords",
        )],
        F.lit(run_ts).cast("bigint").alias("last_update"),
    )


def item_links(
    pages: DataFrame, base: str, scope: str = LIST_ITEM_SCOPE, link: str = "li a", nth: int = 2
) -> DataFrame:
    """The nth link of every list item as an absolute URL; NULL where the item has fewer."""
    rows = _one_record(pages, [Rule("hrefs", link, "@href")], scope)
    keep = [c for c in pages.columns if c != "html"]
    path = F.try_element_at(F.col("r.hrefs"), F.lit(nth))
    return rows.select(*keep, path.alias("path"), absolute_url(F.lit(base), path).alias("url_next"))


def next_page(pages: DataFrame, base: str, selector: str = NEXT_PAGE) -> DataFrame:
    """First next-page link of every page, NULL when there is none."""
    rows = _one_record(pages, [Rule("hrefs", selector, "@href")], None)
    keep = [c for c in pages.columns if c != "html"]
    return rows.select(*keep, absolute_url(F.lit(base), first(F.col("r.hrefs"))).alias("url_next"))


def contents_rows(pages: DataFrame, rules=CONTENTS_RULES, scope: str = CONTENTS_SCOPE) -> DataFrame:
    """One row per article of a contents table: titles, authors, first link."""
    rows = _one_record(pages, rules, scope)
    keep = [c for c in pages.columns if c != "html"]
    return rows.select(*keep, "r.title", "r.author", first(F.col("r.link")).alias("link"))


def links_ending(pages: DataFrame, selector: str = PDF_LINKS) -> DataFrame:
    """All links of a page that fit the selector, in page order."""
    rows = _one_record(pages, [Rule("file_urls", selector, "@href")], None)
    keep = [c for c in pages.columns if c != "html"]
    return rows.select(*keep, "r.file_urls")
