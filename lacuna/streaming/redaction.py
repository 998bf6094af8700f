"""Redaction of streams. The stages are stateless per row, so the batch pipeline runs unchanged on a stream.

A row must be a whole document: matches over several lines cannot be seen in a stream of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.plans.pipeline import Config, Pipeline


def redacted_stream(docs: DataFrame, text_col: str = "text", config: Config | None = None) -> DataFrame:
    return Pipeline(config or Config()).run(docs, text_col)


def counts_by_window(docs: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes", config: Config | None = None) -> DataFrame:
    """Spans per type and time window, with a watermark for late rows."""
    found = Pipeline(config or Config()).detect(docs.withWatermark(time_col, late))
    rows = found.select(time_col, F.explode_outer("spans.type").alias("type")).where("type is not null")
    return rows.groupBy(F.window(time_col, window).alias("window"), "type").agg(F.count("*").alias("n"))


def redact_folder(spark: SparkSession, source: str, target: str, checkpoint: str, config: Config | None = None) -> None:
    """Redacts the whole-text files of a folder that are new since the last call, then stops."""
    docs = spark.readStream.schema("value string").text(source, wholetext=True).withColumnRenamed("value", "text")
    out = redacted_stream(docs, "text", config).select("redacted", "spans")
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
