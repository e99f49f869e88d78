"""Session settings for a run that owns its session.

Operators never depend on these settings for right results; they only make a
cluster run faster. A session handed in by the caller is used as it is.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "dirwise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only under a local master, where it may be unset, is one made: a sub-folder
    of the warehouse for this run, which goes when the run ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/run-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(shutil.rmtree, made.removeprefix("file:"), ignore_errors=True)
    return made


def saved(df: DataFrame, join: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For inputs that a plan reads many times: the work is done once, survives a
    lost executor, and the copy has column pruning and size statistics.
    ``join`` is a hint for the joins of the copy: its files are much smaller than
    its rows, so a copy that grows with the input would be broadcast by their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/dirwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    return copy.hint(join) if join else copy


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores where the input has fewer pieces than that; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
