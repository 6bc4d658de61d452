from contextlib import contextmanager

from pyspark.sql import functions as F

from treegauge.joins import lookup
from treegauge.operators.graph import neighbours
from treegauge.operators.identity import tree_fingerprints


def test_lookup_keeps_rows_and_nulls(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "x")], "k int, v string")
    table = spark.createDataFrame([(1, "one"), (3, "three")], "k int, name string")
    assert rows(lookup(left, table, ["k"])) == [(1, "a", "one"), (1, "b", "one"), (2, "a", None),
                                                (None, "x", None)]
    assert rows(lookup(left, table, ["k"], "inner")) == [(1, "a", "one"), (1, "b", "one")]


@contextmanager
def small_partitions(spark):
    """Settings under which a hot key stands out in a small table."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split_over_tasks(spark):
    """A third of all rows on one key, next to an aggregate on that key."""
    with small_partitions(spark):
        many = spark.range(0, 90000, 1, 6).select(
            F.when(F.col("id") < 30000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        table = many.groupBy("k").agg(F.min("payload").alias("first"))
        joined = lookup(many, table, ["k"])
        assert joined.count() == 90000
        assert "skew=true" in plan_of(joined.select("k", "payload", "first"))


def test_the_keys_themselves_decide(spark, rows):
    left = spark.createDataFrame([("a\1", "b"), ("a", "\1b")], "k string, l string")
    table = spark.createDataFrame([("a", "\1b", 7)], "k string, l string, n int")
    assert rows(lookup(left, table, ["k", "l"])) == [("a", "\1b", 7), ("a\1", "b", None)]


def test_a_hub_and_a_top_folder_are_split(spark):
    with small_partitions(spark):
        edges = spark.range(0, 60000, 1, 6).select(
            F.when(F.col("id") < 30000, F.lit("hub")).otherwise(F.col("id").cast("string")).alias("src"),
            F.sha2(F.col("id").cast("string"), 256).alias("dst"))
        start = spark.range(0, 20000).select(F.when(F.col("id") == 0, F.lit("hub")).otherwise(
            (F.col("id") + 30000).cast("string")).alias("node"))
        used = neighbours(edges, start)[1]
        assert "skew=true" in plan_of(used) and used.count() == 30000 + 19999
        files = spark.range(0, 40000, 1, 6).select(
            F.concat(F.lit("/top/d"), (F.col("id") % 20000).cast("string"), F.lit("/f"),
                     F.sha2(F.col("id").cast("string"), 256)).alias("path"),
            F.lit("file").alias("kind"), F.lit(1).cast("bigint").alias("size"))
        only = spark.range(0, 20000).select(F.when(F.col("id") == 0, F.lit("/top")).otherwise(
            F.concat(F.lit("/top/d"), F.col("id").cast("string"))).alias("dir"))
        prints = tree_fingerprints(files, only)
        assert "skew=true" in plan_of(prints) and prints.filter("dir = '/top'").first()["files"] == 40000
