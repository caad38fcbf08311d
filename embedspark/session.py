"""Session helpers: a tuned local session and the shared scratch folder of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and single-node benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("embedspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there all executors share one machine.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if parent:
        return f"{parent.rstrip('/')}/embedspark-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="embedspark-", dir="/tmp")


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back.

    Cuts the lineage so that a lost executor repeats little, and gives Spark the true size of the
    table: joins with it broadcast only if it really is small.
    """
    folder = shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(f"{folder}/table")
    return df.sparkSession.read.parquet(f"{folder}/table")
