"""Session defaults and the one place lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the frame that needed them is gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Sessions with a constant grouping key are merged before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


#: Shuffle files of a query go at the end of its action (Spark 4.1; earlier ones do not know it).
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "treegauge",
                  **extra: str) -> SparkSession:
    """A session with the defaults above; `master` only for local runs.

    A local run that names no checkpoint folder keeps one in the warehouse.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    context = spark.sparkContext
    context.setLogLevel("ERROR")
    if master and not (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return spark


def for_one_action(df: DataFrame) -> DataFrame:
    """The rows of `df` for a single action, at whose end the shuffle files behind it go.

    Otherwise these stay until the driver happens to collect its garbage, and
    steps with many rounds fill the disks meanwhile.  A second action on the
    frame returned would write them again; `df` itself stays as it is.
    """
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")  # read when a frame is made
    try:
        return df.select("*")
    finally:
        if before is None:
            conf.unset(RELEASE)
        else:
            conf.set(RELEASE, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    The folder comes from `spark.checkpoint.dir`; without one nothing is
    written anywhere.  The rows are read from there, so the shuffle files
    that they came from are not kept.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(shared)
    return for_one_action(df).checkpoint(eager=True)
