import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.session import check_shared, spread, stage, staged_path, staging
from corpusloom.sources.postings_store import add_postings, of_documents, read_postings
from corpusloom.sources.readers import read_pages


def test_staged_tables_are_broadcast_by_their_file_size(spark):
    big = spark.range(0, 200_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    small = stage(spark.range(10).select("id"), "small")
    plan = big.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    large = stage(big, "large")
    plan = large.join(stage(big, "other"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_spread_deals_out_as_asked(spark):
    path = staged_path(spark, "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert spread(spark.read.parquet(path), 5).rdd.getNumPartitions() == 5


def test_nothing_staged_is_left(spark):
    with staging(spark):
        rows = stage(spark.range(10).toDF("id"), "left")
        path = rows.inputFiles()[0].rsplit("/", 1)[0]
        assert rows.count() == 10 and os.path.isdir(path.removeprefix("file://").removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_folders_that_are_not_shared_are_refused():
    check_shared("local[8]", None)
    check_shared("local", "file:/tmp/x")
    check_shared("spark://host:7077", "hdfs://host/staging")
    for master, folder in (("spark://host:7077", None), ("yarn", "file:///tmp/x"), ("local-cluster[2,1,1024]", None)):
        with pytest.raises(ValueError):
            check_shared(master, folder)


def test_html_files_as_pages(spark):
    path = staged_path(spark, "html")
    spark.createDataFrame([("<h1>a</h1>\n<p>b</p>",)], "value string").coalesce(1).write.text(path)
    rows = read_pages(spark, path).collect()
    assert [r["html"].strip() for r in rows] == ["<h1>a</h1>\n<p>b</p>"]
    assert rows[0]["url"].endswith(".txt")


def shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def left_behind(spark, before):
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    return shuffle_files(spark) - before


def test_staging_leaves_no_shuffle_files(spark):
    """What a staged table was shuffled by goes with its write, not with the driver's next collection of garbage."""
    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    former = spark.conf.get(setting, None)
    counts = spark.range(10_000).groupBy((F.col("id") % 997).alias("g")).agg(F.count("*").alias("n"))
    table = stage(counts, "counts")
    assert not left_behind(spark, before) and spark.conf.get(setting, None) == former
    assert table.count() == counts.count() == 997


def test_kept_postings_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    docs = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("a title").alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit("b c").alias("fulltext"))
    path = staged_path(spark, "postings")
    add_postings(docs, path, "upload", 0)
    assert not left_behind(spark, before)
    assert of_documents(read_postings(spark, path).where("word is not null")).count() == 2000
