"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

_COMMITS = "batch bigint, day string, rows bigint"


def write_embeddings(df: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> None:
    """Embeddings, token counts and times as Parquet, one folder per partition value.

    Rows are brought together by partition value and spread evenly inside it (adaptive rebalance),
    so that one very large day is written by many tasks and small days do not become many files.
    """
    if partition is None:
        df.write.mode(mode).parquet(path)
        return
    df.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: a row for each committed batch and day."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).json(f"{path}/commits")


def commit_batch(rows: DataFrame, path: str, batch: int, day: str) -> bool:
    """Writes a batch by its number below ``path``, once: whether it was written now.

    A batch goes to partitions of its own by day and number, which a repeated attempt replaces as a whole (dynamic partition
    overwrite), and counts only from the moment its manifest stands. So an attempt that broke off changes
    nothing that readers see, and a batch that is committed already is left as it is.
    """
    spark = rows.sparkSession
    if _commits(spark, path).where(F.col("batch") == batch).limit(1).count():
        return False
    numbered = rows.withColumn("batch", F.lit(batch).cast("bigint")).hint("rebalance", day)
    writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day, "batch").parquet(f"{path}/data")
    counts = rows.groupBy(F.col(day).cast("string").alias("day")).agg(F.count("*").alias("rows"))
    manifest = counts.select(F.lit(batch).cast("bigint").alias("batch"), "day", "rows")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/commits/number={batch}")
    return True


def committed_rows(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The rows of all committed batches, with the day as text; null days are a day like any other."""
    commits = _commits(spark, path).select("batch", F.col("day").alias("_day"))
    rows = spark.read.parquet(f"{path}/data").withColumn(day, F.col(day).cast("string"))
    same = (rows["batch"] == commits["batch"]) & rows[day].eqNullSafe(commits["_day"])
    return rows.join(commits, same, "left_semi")


def exactly_once(stream: DataFrame, path: str, checkpoint: str, day: str = "day") -> StreamingQuery:
    """A stream into dated folders, each micro-batch committed once by its number."""

    def commit(rows: DataFrame, batch: int) -> None:
        commit_batch(rows.persist(), path, batch, day)
        rows.unpersist()

    return (
        stream.writeStream.foreachBatch(commit)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
