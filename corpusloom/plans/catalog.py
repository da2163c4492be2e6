"""Every operator as a query over the given tables, by name.

Each function takes (spark, sf_dir) and returns a DataFrame over whole tables. Lists are
shown as text and integers as bigint, so the results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import markup, numbers, text
from corpusloom.functions.stemming import stem
from corpusloom.operators import (
    carryover, documents, expand, extract, frequency, increment, lookup, modelling, search, sharded_topics, store, suggest, topics,
)
from corpusloom.plans import bindings as given
from corpusloom.schema import ARTICLE, INDEX_DOCUMENT
from corpusloom.session import stage, staged_path
from corpusloom.sources import index_store, marks, postings_store, readers, ris, writers
from corpusloom.streaming import first_seen, sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ARTICLE_TEXTS = ("id", "title", "authors", "abstract", "release_date", "article_type",
                 "fulltext", "file_url", "keywords", "last_update")


def mean_weight(terms: DataFrame) -> float:
    """A threshold some topic rows pass and some do not."""
    return terms.agg(F.avg("weight")).first()[0]


def plain(df: DataFrame) -> DataFrame:
    """Lists as ``|``-joined text, integers as bigint."""

    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            column = F.when(column.isNotNull(), F.concat_ws("|", column))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def query(make: Query) -> Query:
    QUERIES[make.__name__] = lambda spark, sf_dir: plain(make(spark, sf_dir))
    return make


# --- sources and sinks -------------------------------------------------------------------


@query
def s1_article_table(spark, sf):
    path = staged_path(spark, "article-table")
    writers.append_new(given.articles(spark, sf), path, create=True)
    return readers.read_articles(spark, path).select(
        *ARTICLE_TEXTS, F.col(increment.DAY_COLUMN).cast("string").alias("update_day")
    )


@query
def s2_topic_terms_csv(spark, sf):
    path = staged_path(spark, "topic-terms-csv")
    writers.write_topic_terms(given.topic_terms(spark, sf), path)
    return readers.read_topic_terms(spark, path)


@query
def s3_doc_topics_csv(spark, sf):
    path = staged_path(spark, "doc-topics-csv")
    writers.write_doc_topics(given.doc_topics(spark, sf, given.topic_terms(spark, sf)), path)
    return readers.read_doc_topics(spark, path)


@query
def s4_ris_articles(spark, sf):
    """Documents written as a RIS bibliography and read back as articles."""

    def tag(name, value):
        return F.concat(F.lit(f"{name}  - "), value, F.lit("\n"))

    entry = F.concat(
        tag("TY", F.col("lang")),
        tag("AN", F.concat("source", F.lit(" + "), F.col("doc_id").cast("string"))),
        tag("TI", F.substring_index("text", "\n", 1)),
        F.when(F.col("lang") != "en", tag("TT", F.concat(F.lit("Translated "), F.col("doc_id").cast("string")))).otherwise(F.lit("")),
        tag("AU", F.col("source")), tag("AU", F.col("lang")),
        tag("AB", F.col("text")),
        tag("PY", (1990 + F.col("doc_id") % 30).cast("string")),
        tag("KW", F.col("lang")), tag("KW", F.col("source")),
        F.lit("ER  - \n"),
    )
    path = staged_path(spark, "ris")
    given.texts(spark, sf, "documents").select(entry.alias("value")).write.text(path)
    return ris.ris_articles(ris.read_ris(spark, path), given.RUN_TS).select(
        "id", "title", "authors", "abstract", "release_date", "article_type", "keywords", "last_update"
    )


@query
def s5_pages(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet")


@query
def s6_export_corpus(spark, sf):
    path = staged_path(spark, "corpus")
    writers.export_corpus(given.articles(spark, sf), path)
    return spark.read.parquet(path)


@query
def s7_append_new(spark, sf):
    """Stored articles, then everything with later copies appended: stored and first rows stay."""
    path = staged_path(spark, "article-store")
    rows = given.articles(spark, sf)
    writers.append_new(given.later_copies(given.stored_articles(rows)), path, create=True)
    writers.append_new(rows.unionByName(given.later_copies(rows)), path)
    return readers.read_articles(spark, path).select("id", "title", "abstract", "last_update")


@query
def s8_index_batches(spark, sf):
    path = staged_path(spark, "index-batches")
    writers.write_index_batches(given.articles(spark, sf), path)
    return documents.flatten(readers.read_index_documents(spark, path), "__")


@query
def s8_exact_batches(spark, sf):
    """Upload files that are filled: the batch number and the documents of each."""
    path = staged_path(spark, "exact-batches")
    writers.write_index_batches(given.articles(spark, sf), path, exact=True)
    back = spark.read.schema(T.StructType([*INDEX_DOCUMENT.fields, T.StructField("batch", T.LongType())])).json(path)
    return documents.batch_counts(back)


@query
def s9_topic_bags_json(spark, sf):
    path = staged_path(spark, "topic-bags")
    bags = topics.topic_bags(given.doc_topics(spark, sf, given.topic_terms(spark, sf)))
    writers.write_topic_bags(bags, path)
    return documents.flatten(readers.read_topic_bags(spark, path), "__")


@query
def s10_docs_json(spark, sf):
    path = staged_path(spark, "docs")
    writers.write_docs(given.articles(spark, sf), path)
    return readers.read_index_documents(spark, path).select("id", "type", "fields.*")


def _index(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The articles with their topics, and the topic terms. The topics are staged, the texts are not."""
    terms = given.topic_terms(spark, sf)
    bags = stage(topics.topic_bags(given.doc_topics(spark, sf, terms)), "topic-bags")
    return documents.enrich(given.articles(spark, sf), bags, "left"), terms


def _term_hits(spark, sf) -> DataFrame:
    index, terms = _index(spark, sf)
    return search.search(index, expand.request_clauses(given.term_requests(terms), terms))


@query
def s11_hits_csv(spark, sf):
    path = staged_path(spark, "hits-csv")
    writers.write_hits(_term_hits(spark, sf), path)
    fields = "title string, abstract string, article_type string, topics string, id string, `order` bigint, request_id bigint"
    back = spark.read.schema(fields).option("header", True).option("escape", '"').csv(path)
    return back.withColumn("topics", F.coalesce("topics", F.lit("")))


@query
def s12_query_log(spark, sf):
    path = staged_path(spark, "query-log")
    terms = given.topic_terms(spark, sf)
    writers.write_queries(expand.expand(given.term_requests(terms), terms), path)
    return spark.read.text(path).withColumnRenamed("value", "query")


@query
def s13_response_hits(spark, sf):
    """Hits packed as one search response per request, then read from that JSON."""
    hits = _term_hits(spark, sf)
    hit = F.struct("order", "id", F.struct(
        "title", "abstract", "article_type",
        F.from_json(F.nullif("topics", F.lit("")), "array<string>").alias("topics"),
    ).alias("fields"))
    packed = hits.groupBy("request_id").agg(F.sort_array(F.collect_list(hit)).alias("hit"))
    unordered = F.transform("hit", lambda h: h.dropFields("order")).alias("hit")
    responses = packed.select("request_id", F.to_json(F.struct(F.struct(unordered).alias("hits"))).alias("json"))
    return readers.response_hits(responses)


@query
def s14_marks(spark, sf):
    """The last committed mark per consumer, from a log of events."""
    log = given.table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"),
        F.unix_timestamp("ts").alias("ts"),
        F.col("event_id").alias("committed_at"),
    )
    return marks.marks(log)


@query
def s15_feed(spark, sf):
    path = staged_path(spark, "feed")
    writers.export_feed(given.articles(spark, sf), path)
    return spark.read.schema(given.articles(spark, sf).schema).json(path)


@query
def s16_index_load(spark, sf):
    """Documents with topics, then edited English ones without: replaced, topics kept."""
    path = staged_path(spark, "index")
    terms = given.topic_terms(spark, sf)
    index_store.load_index(given.enriched_articles(spark, sf, terms), path, "upload", 0)
    edited = given.later_copies(given.stored_articles(given.articles(spark, sf)))
    index_store.load_index(edited, path, "update", 0)
    return index_store.read_index(spark, path, keep_topics=True).select("id", "title", "abstract", "last_update", "topics")


# --- extraction --------------------------------------------------------------------------

PAGE_RULES = (
    markup.Rule("id", "article h1"),
    markup.Rule("title", "h1"),
    markup.Rule("authors", "nav li a", "own"),
    markup.Rule("abstract", "div.ad"),
    markup.Rule("release_date", "title", "own"),
    markup.Rule("article_type", "html", "@lang"),
    markup.Rule("fulltext", "article"),
    markup.Rule("file_url", "nav a", "@href", anywhere=True),
    markup.Rule("keywords", "nav li *", "own"),
)


@query
def x2_x9_article_fields(spark, sf):
    pages = given.texts(spark, sf, "pages")
    return extract.extract_articles(pages, given.RUN_TS, PAGE_RULES, "html").drop("id")


@query
def x1_identifiers(spark, sf):
    """Links with a fixed prefix removed."""
    return given.texts(spark, sf, "pages").select(
        "page_id", text.strip_doi_prefix(F.col("url"), "https://").alias("id")
    )


@query
def x5_release_years(spark, sf):
    """First four digits in a row of every text."""
    return given.texts(spark, sf, "documents").select("doc_id", text.release_year(F.col("text")).alias("year"))


@query
def x10_page_text(spark, sf):
    return given.texts(spark, sf, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query
def x12_clean_identifiers(spark, sf):
    return given.texts(spark, sf, "conversations").select(
        "conv_id", "turn", text.clean_identifier(F.concat_ws(" + ", "role", "text")).alias("id")
    )


@query
def x13_x15_item_links(spark, sf):
    pages = given.texts(spark, sf, "pages").select("page_id", "html")
    return extract.item_links(pages, "https://example.org", "nav ul", "li a", 2)


@query
def x14_next_page(spark, sf):
    pages = given.texts(spark, sf, "pages").select("page_id", "html")
    return extract.next_page(pages, "https://example.org", "nav li a")


@query
def x16_contents_rows(spark, sf):
    pages = given.texts(spark, sf, "pages").select("page_id", "html")
    rules = (
        markup.Rule("title", "li a", "own"),
        markup.Rule("author", "nav > ul > li > a, nav > a", "@href"),
        markup.Rule("link", "li a", "@href"),
    )
    return extract.contents_rows(pages, rules, "nav")


@query
def x17_links_ending(spark, sf):
    pages = given.texts(spark, sf, "pages").select("page_id", "html")
    return extract.links_ending(pages, 'a[href$="."]')


# --- filters, projections, scalar functions ----------------------------------------------


def _items(spark, sf) -> DataFrame:
    """Items that may lack an id (document not labelled) or a title (first sentence too long for one)."""
    labels = given.table(spark, sf, "labels").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    first = F.regexp_extract("text", r"^[^.\n]*", 0)
    return given.texts(spark, sf, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "id", F.when(F.char_length(first).between(1, 60), first).alias("title"),
    )


@query
def f1_valid_items(spark, sf):
    return store.valid_items(_items(spark, sf))


@query
def f1_rejected_items(spark, sf):
    return store.rejected_items(_items(spark, sf))


def _window(rows: DataFrame) -> tuple[int, int]:
    """Mark in the middle of the stamps, on a stamp; now at the last stamp."""
    low, high = rows.agg(F.min("last_update"), F.max("last_update")).first()
    return low + (high - low) // 120 * 60, high


@query
def f2_increment(spark, sf):
    """Read from the stored table, whose day partitions the window prunes."""
    path = staged_path(spark, "article-store")
    rows = given.articles(spark, sf)
    writers.append_new(rows, path, create=True)
    return increment.increment(readers.read_articles(spark, path), *_window(rows)).select("id", "title", "last_update")


@query
def f3_strong_topics(spark, sf):
    return topics.strong_topics(given.doc_topics(spark, sf, given.topic_terms(spark, sf)))


@query
def f4_above_threshold(spark, sf):
    terms = given.topic_terms(spark, sf)
    return topics.eligible_topics(terms, mean_weight(terms), fallback=False)


@query
def a3_above_threshold_or_best(spark, sf):
    terms = given.topic_terms(spark, sf)
    return topics.eligible_topics(terms, mean_weight(terms), fallback=True)


@query
def f6_optional_fields(spark, sf):
    """Which optional fields the JSON of an index document holds."""
    docs = documents.index_documents(given.articles(spark, sf))
    json = documents.document_json(docs).select(F.get_json_object("json", "$.id").alias("id"), "json")
    return json.select("id", *[
        F.col("json").contains(f'"{name}":').alias(f"has_{name}") for name in ("file_url", "keywords", "fulltext")
    ])


@query
def p10_document_json(spark, sf):
    return documents.document_json(documents.index_documents(given.articles(spark, sf)))


@query
def p1_p2_typed_items(spark, sf):
    items = given.texts(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.array("source").alias("authors"),
        F.col("n_chars").alias("release_date"), F.col("doc_id").cast("string").alias("last_update"),
    )
    return store.typed_items(items)


@query
def p4_p5_flat_documents(spark, sf):
    terms = given.topic_terms(spark, sf)
    docs = documents.index_documents(given.enriched_articles(spark, sf, terms), with_topics=True)
    return documents.flatten(docs, "__")


@query
def p6_unflattened_documents(spark, sf):
    flat = documents.flatten(documents.index_documents(given.articles(spark, sf)))
    return documents.unflatten(flat).select("id", "type", "fields.*")


@query
def p8_hit_shape(spark, sf):
    """Every document as a hit."""
    index, _ = _index(spark, sf)
    hits = index.select(F.lit("all").alias("query"), F.lit(1).alias("order"), "id", F.lit(0.0).alias("score"))
    return search.hit_rows(hits, index).select("id", "topics")


@query
def p11_run_stamp(spark, sf):
    """Which events the run that starts now has behind it."""
    now = marks.run_stamp()
    return given.table(spark, sf, "events").select("event_id", (F.unix_timestamp("ts") <= F.lit(now)).alias("past"))


@query
def p9_numbers(spark, sf):
    value = (F.col("l_quantity") - F.col("l_extendedprice")).cast("decimal(18,2)")
    rows = given.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(
        F.array(F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)"), value)
    ).alias("value"))
    v = F.col("value")
    return rows.select(
        "l_orderkey", "l_linenumber",
        numbers.as_integer(v).alias("whole"), numbers.as_double(v).alias("fraction"),
    )


@query
def t1_words(spark, sf):
    return lookup.request_words(given.turn_requests(spark, sf))


@query
def t2_stems(spark, sf):
    """Stem of every distinct word of the documents."""
    words = given.texts(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return words.withColumn("stem", stem("word"))


@query
def t3_word_forms(spark, sf):
    return lookup.word_forms(lookup.request_words(given.turn_requests(spark, sf)))


@query
def t4_topic_ids(spark, sf):
    return given.texts(spark, sf, "documents").select(
        "doc_id", text.topic_id(F.regexp_extract("source", r"(\d+)", 1)).alias("topic"), text.topic_id(F.col("doc_id")).alias("padded")
    )


@query
def t8_word_queries(spark, sf):
    return expand.expand(given.turn_requests(spark, sf), given.topic_terms(spark, sf), mode="words").select("request_id", "n_words", "query")


@query
def t8_unboosted_queries(spark, sf):
    return expand.expand(given.turn_requests(spark, sf), given.topic_terms(spark, sf), mode="topics").select("request_id", "n_words", "query")


@query
def t10_request_texts(spark, sf):
    requests = given.turn_requests(spark, sf)
    return requests.select("request_id", text.request_text(text.words(F.col("request"))).alias("request"))


# --- joins -------------------------------------------------------------------------------


@query
def j1_enriched_articles(spark, sf):
    return given.enriched_articles(spark, sf, given.topic_terms(spark, sf))


@query
def j1_enriched_left(spark, sf):
    return given.enriched_articles(spark, sf, given.topic_terms(spark, sf), "left").select("id", "topics")


@query
def j2_term_lookup(spark, sf):
    return lookup.match_topics(given.turn_requests(spark, sf), given.topic_terms(spark, sf)).select(
        "request_id", "pos", "form", "word", "term", "topic", "weight"
    )


@query
def j3_top_term_join(spark, sf):
    terms = given.topic_terms(spark, sf)
    return terms.join(topics.top_term_of_topic(terms), "topic").select("term", "topic", "top_term")


@query
def j4_insert_if_absent(spark, sf):
    rows = given.articles(spark, sf)
    return store.insert_if_absent(given.later_copies(rows).unionByName(rows), given.stored_articles(rows))


@query
def j5_upsert(spark, sf):
    terms = given.topic_terms(spark, sf)
    index = given.enriched_articles(spark, sf, terms)
    rows = given.articles(spark, sf).withColumn("topics", F.lit(None).cast("array<string>"))
    edited = given.later_copies(given.stored_articles(rows))
    return store.upsert(index, edited.unionByName(given.stored_articles(rows)), keep_columns=["topics"])


@query
def j7_postings(spark, sf):
    """Documents per word for all words of the benchmark passages."""
    vocabulary = given.passage_requests(spark, sf).select(F.explode(text.tokens(F.col("request"))).alias("word"))
    return search.postings(given.articles(spark, sf), vocabulary)


# --- aggregations, windows, set operations -----------------------------------------------


@query
def a1_topic_bags(spark, sf):
    return topics.topic_bags(given.doc_topics(spark, sf, given.topic_terms(spark, sf)))


@query
def a2_best_topic_of_term(spark, sf):
    return topics.best_topic_of_term(given.topic_terms(spark, sf))


@query
def a4_top_term_of_topic(spark, sf):
    return topics.top_term_of_topic(given.topic_terms(spark, sf))


@query
def a5_keep_first(spark, sf):
    rows = given.articles(spark, sf)
    return store.keep_first(given.later_copies(rows).unionByName(rows))


@query
def a6_distinct_terms(spark, sf):
    return topics.distinct_terms(given.topic_terms(spark, sf))


@query
def w2_a7_batch_counts(spark, sf):
    """Line items in upload batches."""
    lines = given.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")
    )
    return documents.batch_counts(documents.batch_numbers(lines))


@query
def w2_batch_numbers(spark, sf):
    orders = given.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    return documents.batch_numbers(orders)


@query
def w3_latest(spark, sf):
    """The newest event of each user."""
    events = given.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    return store.latest(events, "user_id", "ts").withColumn("ts", F.unix_timestamp("ts"))


@query
def o1_union(spark, sf):
    rows = given.articles(spark, sf)
    return rows.unionByName(given.later_copies(rows)).select("id", "abstract", "last_update")


@query
def o2_topic_multiset(spark, sf):
    """How often each topic is matched by the raw and stemmed words of a request."""
    return lookup.match_topics(given.turn_requests(spark, sf), given.topic_terms(spark, sf)).groupBy("request_id", "topic").agg(F.count("*").alias("n"))


# --- topic modelling ---------------------------------------------------------------------


@query
def m1_word_lists(spark, sf):
    bags = modelling.word_lists(increment.corpus_text(given.articles(spark, sf)))
    return bags.select("docname", F.size("words").alias("n_words"), "words")


@query
def m1_vocabulary(spark, sf):
    bags = modelling.word_lists(increment.corpus_text(given.articles(spark, sf)))
    return modelling.vocabulary(bags)


def _model(spark, sf):
    """The online fit with the settings of ``fit_topics``, whose words-by-topics matrix no machine holds."""
    bags = stage(modelling.word_lists(increment.corpus_text(given.articles(spark, sf))), "bags")
    return sharded_topics.fit_sharded_topics(bags, version="1", learning=sharded_topics.LEARNING)


@query
def m2_m3_model_topic_terms(spark, sf):
    return sharded_topics.sharded_topic_terms(_model(spark, sf)).withColumn("weight", F.round("weight", 6))


@query
def m2_m3_topic_sizes(spark, sf):
    """What holds for any fit: ten ranked terms per topic, none of them said twice."""
    terms = sharded_topics.sharded_topic_terms(_model(spark, sf))
    return terms.groupBy("topic", "model_version").agg(
        F.count("*").alias("n_terms"), F.count_distinct("term").alias("n_distinct"),
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
    )


@query
def m4_model_doc_topics(spark, sf):
    return sharded_topics.sharded_doc_topics(_model(spark, sf)).withColumn("proportion", F.round("proportion", 6))


@query
def m4_doc_topic_sums(spark, sf):
    """What holds for any fit: every document with a vocabulary word has 25 shares that sum to one."""
    shares = sharded_topics.sharded_doc_topics(_model(spark, sf))
    return shares.groupBy("docname").agg(F.count("*").alias("n_topics"), F.round(F.sum("proportion"), 6).alias("total"))


def _sharded_model(spark, sf):
    bags = stage(modelling.word_lists(increment.corpus_text(given.articles(spark, sf))), "bags")
    return sharded_topics.fit_sharded_topics(bags, version="1")


@query
def m2_sharded_word_mass(spark, sf):
    """What holds for any fit: a word adds to all topics together what it is said in the corpus (the priors of a word sum to one)."""
    model = _sharded_model(spark, sf)
    mass = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w) - 1
    return model.weights.join(model.words, "index").select("word", F.round(mass, 3).alias("n"))


@query
def m3_sharded_topic_terms(spark, sf):
    return sharded_topics.sharded_topic_terms(_sharded_model(spark, sf)).withColumn("weight", F.round("weight", 6))


@query
def m4_sharded_doc_shares(spark, sf):
    """Per document its 25 shares, which sum to one, and the words that the fit read."""
    shares = sharded_topics.document_shares(_sharded_model(spark, sf))
    total = F.aggregate("shares", F.lit(0.0), lambda total, x: total + x)
    return shares.select("docname", F.size("shares").alias("n_topics"), F.round(total, 6).alias("total"), "n_words")


@query
def m5_extend_corpus(spark, sf):
    """A corpus of two runs: the stored articles, then the edited ones of the increment."""
    path = staged_path(spark, "corpus")
    rows = given.articles(spark, sf)
    writers.append_corpus(given.stored_articles(rows), path, 1)
    edited = rows.withColumn("fulltext", F.concat("fulltext", F.lit(" (edited)")))
    writers.append_corpus(increment.increment(edited, *_window(rows)), path, 2)
    return readers.read_corpus(spark, path, 2)


@query
def m6_counted_topic_terms(spark, sf):
    return given.topic_terms(spark, sf)


def _stored_topic_terms(spark, sf):
    """The counted topic terms of the documents in English, as a former fit."""
    english = given.texts(spark, sf, "documents").where("lang = 'en'")
    return stage(topics.group_topic_terms(english.select(text.topic_id(F.regexp_extract("source", r"(\d+)", 1)).alias("topic"), "text"), "topic"), "stored-terms")


@query
def m5_topic_overlaps(spark, sf):
    """The weight that topics of the stored documents share with those of all documents."""
    found = carryover.topic_overlaps(_stored_topic_terms(spark, sf), given.topic_terms(spark, sf))
    return found.withColumn("overlap", F.round("overlap", 6))


@query
def m5_carried_topics(spark, sf):
    """What the topics of the stored documents live on as among those of all documents."""
    found = carryover.carried_topics(_stored_topic_terms(spark, sf), given.topic_terms(spark, sf))
    return found.withColumn("overlap", F.round("overlap", 6))


# --- search and suggestion ---------------------------------------------------------------


@query
def g1_suggest(spark, sf):
    terms = given.topic_terms(spark, sf)
    return suggest.suggest(given.turn_requests(spark, sf), terms, mean_weight(terms))


@query
def g1_suggest_fallback(spark, sf):
    return suggest.suggest(given.turn_requests(spark, sf), given.topic_terms(spark, sf), fallback=True)


@query
def a9_suggestion_lists(spark, sf):
    terms = given.topic_terms(spark, sf)
    lists = suggest.suggestion_lists(given.turn_requests(spark, sf), terms, mean_weight(terms))
    return lists.select("request_id", F.col("found.suggestion").alias("suggestions"))


@query
def g2_expand_turns(spark, sf):
    return expand.expand(given.turn_requests(spark, sf), given.topic_terms(spark, sf)).select("request_id", "n_words", "query")


@query
def g2_expand_terms(spark, sf):
    terms = given.topic_terms(spark, sf)
    return expand.expand(given.term_requests(terms), terms)


@query
def a8_request_clauses(spark, sf):
    return expand.request_clauses(given.turn_requests(spark, sf), given.topic_terms(spark, sf)).select("request_id", "words", "topics")


@query
def q1_j6_topic_matches(spark, sf):
    index, terms = _index(spark, sf)
    prepared = search.PreparedSearch(index, expand.request_clauses(given.term_requests(terms), terms))
    return prepared.per_request(prepared.by_topics())


@query
def q2_q3_word_matches(spark, sf):
    index, terms = _index(spark, sf)
    prepared = search.PreparedSearch(index, expand.request_clauses(given.title_requests(spark, sf), terms))
    best = search.rank(prepared.top_by_words(search.RESULT_SIZE)).drop("order")
    return prepared.per_request(best)


@query
def q4_q5_match_all(spark, sf):
    index, terms = _index(spark, sf)
    return search.match_all(index, expand.request_clauses(given.term_requests(terms), terms))


@query
def q6_search_terms(spark, sf):
    return _term_hits(spark, sf)


@query
def q6_search_passages(spark, sf):
    index, terms = _index(spark, sf)
    return search.search(index, expand.request_clauses(given.passage_requests(spark, sf), terms))


@query
def q6_search_titles(spark, sf):
    index, terms = _index(spark, sf)
    return search.search(index, expand.request_clauses(given.title_requests(spark, sf), terms))


def _kept_index(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """An index with kept postings after an upload, an update of the English articles and a removal: its documents, postings, topic terms and the postings' place."""
    index, places = staged_path(spark, "index"), staged_path(spark, "kept-postings")
    terms = given.topic_terms(spark, sf)
    rows = given.articles(spark, sf)
    index_store.load_index(given.enriched_articles(spark, sf, terms, "left"), index, "upload", 0)
    index_store.load_index(given.later_copies(given.stored_articles(rows)), index, "update", 0)
    for writer in ("upload", "update"):
        postings_store.add_postings(index_store.one_load(spark, index, writer, 0), places, writer, 0)
    index_store.remove_documents(rows.where(F.col("id").cast("bigint") % 7 == 3), index, "remove", 0)
    docs = index_store.read_index(spark, index, keep_topics=True, with_load=True)
    return docs, postings_store.read_postings(spark, places), terms, places


@query
def q6_kept_postings(spark, sf):
    """Search over postings that are kept through an update and a removal; no text is read."""
    docs, kept, terms, _ = _kept_index(spark, sf)
    return search.search(docs.drop("fulltext"), expand.request_clauses(given.term_requests(terms), terms), kept=kept)


@query
def q2_near_matches(spark, sf):
    """Near clauses of two and three words of each benchmark passage, over kept postings."""
    docs, kept, _, _ = _kept_index(spark, sf)
    said = given.passage_requests(spark, sf).select("request_id", "request", text.words(F.col("request")).alias("w"))
    clause = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    none = F.array().cast("array<string>").alias("topics")
    two = said.select((F.col("request_id") * 2).alias("request_id"), "request", F.array(clause(1, 2)).alias("words"), none)
    three = said.select((F.col("request_id") * 2 + 1).alias("request_id"), "request", F.array(clause(1, 3), clause(4, 1)).alias("words"), none)
    prepared = search.PreparedSearch(docs.drop("fulltext"), two.unionByName(three), kept=kept, distance=search.NEAR_DISTANCE)
    return prepared.per_request(prepared.top(search.RESULT_SIZE)).select("request_id", "id", "score", "order")


@query
def q5_frequency_top(spark, sf):
    """The best documents by term frequency, over kept postings, with bounds."""
    docs, kept, terms, places = _kept_index(spark, sf)
    prepared = search.PreparedSearch(docs.drop("fulltext"), expand.request_clauses(given.term_requests(terms), terms), kept=kept)
    lengths = postings_store.settled(postings_store.read_lengths(spark, places), prepared.narrow)
    ranking = frequency.FrequencyRanking(prepared, frequency.frequency_weights(prepared.found, lengths))
    return prepared.per_request(ranking.top()).select("request_id", "id", "score", "order")


# --- streaming ---------------------------------------------------------------------------


@query
def r1_sync_index_stream(spark, sf):
    """The article table streamed into an index that already holds topics."""
    table, index = staged_path(spark, "article-table"), staged_path(spark, "index")
    rows = given.articles(spark, sf)
    index_store.load_index(given.enriched_articles(spark, sf, given.topic_terms(spark, sf)), index, "upload", 0)
    writers.append_new(given.later_copies(rows), table, create=True)
    stream = sync.sync_index_stream(sync.article_stream(spark, table), index, staged_path(spark, "sync"))
    stream.awaitTermination()
    return index_store.read_index(spark, index, keep_topics=True).drop("model_version")


@query
def r1_first_seen_stream(spark, sf):
    """Raw items as a stream into an index of first items: the articles with later copies, and after a restart copies of older stamps."""
    raw, index, checkpoint = (staged_path(spark, n) for n in ("raw-items", "index", "first-seen"))
    rows = given.articles(spark, sf)
    copies = given.later_copies(rows)
    older = copies.withColumn("last_update", F.col("last_update") - 7200)
    for arrived in (rows.unionByName(copies), older):  # the older stamps come second, after a restart
        arrived.write.mode("append").parquet(raw)
        first_seen.load_first_seen(spark.readStream.schema(ARTICLE).parquet(raw), index, checkpoint).awaitTermination()
    return index_store.read_index(spark, index).drop("topics", "model_version")
