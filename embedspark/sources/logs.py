"""Text logs of a serving process as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the log files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def stage_milliseconds(line: Column, stage: str) -> Column:
    """Milliseconds of a named stage (``stage: 1.25ms``), NULL if the line lacks it."""
    text = F.regexp_extract(line, rf"(?:^|[\s,(]){stage}: ([0-9]+(?:\.[0-9]+)?)ms", 1)
    return F.when(text != "", text.cast("double"))


def line_kind(line: Column) -> Column:
    """Which handler wrote the timing line."""
    kind = F.regexp_extract(line, r"(\w+ \w+) timing - ", 1)
    return F.when(kind != "", F.lower(kind))


def stage_timings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Timing lines with their stages as columns; other lines are dropped."""
    column = F.col(line)
    kept = lines.where(column.contains(" timing - "))
    count = F.regexp_extract(column, r"count: ([0-9]+)", 1)
    return kept.withColumns(
        {
            "kind": line_kind(column),
            "items": F.when(count != "", count.cast("bigint")),
            **{
                name: stage_milliseconds(column, stage)
                for name, stage in (
                    ("tokenize_ms", "tokenize"),
                    ("inference_ms", "ONNX"),
                    ("postprocess_ms", "postprocess"),
                    ("preprocess_ms", "preprocess"),
                    ("total_ms", "total"),
                )
            },
        }
    )
