"""Sessions, and cutting lineage in the shared checkpoint folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "pagequarry", **conf: str) -> SparkSession:
    """A session with what this library expects: adaptive plans, UTC, small Arrow batches for large pages."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a temporary one, which only a local master may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that later plans start there and lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
