"""Schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", STRINGS),
    T.StructField("abstract", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("article_type", T.StringType()),
    T.StructField("fulltext", T.StringType()),
    T.StructField("file_url", T.StringType()),
    T.StructField("keywords", STRINGS),
    T.StructField("last_update", T.LongType()),
])

TOPIC_TERMS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

DOC_TOPICS = T.StructType([
    T.StructField("docname", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("proportion", T.DoubleType()),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("request", T.StringType()),
])

TOPIC_BAG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("fields", T.StructType([T.StructField("topics", STRINGS)])),
])

# Body of an index document, in output order; absent optionals are NULL and
# vanish from the JSON.
INDEX_FIELDS = (
    "title", "authors", "abstract", "release_date", "article_type",
    "file_url", "keywords", "fulltext", "last_update",
)

_ARTICLE_TYPES = {f.name: f.dataType for f in ARTICLE.fields}

INDEX_DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("fields", T.StructType(
        [T.StructField(name, _ARTICLE_TYPES[name]) for name in INDEX_FIELDS]
        + [T.StructField("topics", STRINGS)]
    )),
])

SEARCH_RESPONSE = T.StructType([
    T.StructField("hits", T.StructType([
        T.StructField("hit", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("fields", T.StructType([
                T.StructField("title", T.StringType()),
                T.StructField("abstract", T.StringType()),
                T.StructField("article_type", T.StringType()),
                T.StructField("topics", STRINGS),
            ])),
        ]))),
    ])),
])

MARK = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("committed_at", T.LongType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
