import os
import time

from pyspark.sql import functions as F

from treegauge.llm.components import components
from treegauge.session import RELEASE, cut_lineage, for_one_action


def shuffle_files(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for d in disks.localDirsString() for _, _, names in os.walk(d) for n in names
            if n.startswith("shuffle_")}


def stay(spark, before):
    """Shuffle files that are new and do not go; they are removed a moment after the action."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return set()
        time.sleep(0.1)
    return shuffle_files(spark) - before


def test_shuffle_files_go_when_rows_are_settled_or_collected(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(RELEASE, None)
    settled = cut_lineage(counted)
    assert len(for_one_action(counted).collect()) == len(for_one_action(counted).toPandas()) == 7
    assert for_one_action(counted).toArrow().num_rows == 7
    assert stay(spark, before) == set()
    assert spark.conf.get(RELEASE, None) == setting
    # What is settled is read from its files, the frame itself is as it was.
    assert sorted(settled.collect()) == sorted(settled.collect()) == sorted(counted.collect()) == sorted(
        counted.collect())


def test_rounds_of_components_leave_no_shuffle_files(spark):
    edges = cut_lineage(spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))
    before = shuffle_files(spark)
    found = components(edges)
    assert stay(spark, before) == set()
    assert sorted(found.collect()) == [(i, 0) for i in range(40)]
