"""Sinks: texts, JSON lines (by split), and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, characters as they are."""
    rows.write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str, split_col: str = "split") -> None:
    """``path/train/``, ``path/validation/``, ``path/test/`` (one folder per split, named as it is), rows with all their
    columns. One pass writes all; then folders are renamed, which moves no data."""
    rows.withColumn("_folder", F.col(split_col)).write.mode("overwrite").partitionBy("_folder").json(path)
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("_folder="):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, name.removeprefix("_folder=")))


def write_text(rows: DataFrame, path: str, col: str = "redacted") -> None:
    rows.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def print_redacted(rows: DataFrame, col: str = "redacted") -> None:
    """The texts of a command-line run (one document, or a few files) to standard output, without added line feeds."""
    for r in rows.select(col).toLocalIterator():
        print(r[0] or "", end="")


def manifest(rows: DataFrame, key: str) -> str:
    """JSON of the row count and an order-free checksum: the sum of the rows' hashes."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("sum")).first()
    return json.dumps({"name": key, "rows": r["n"], "checksum": str(r["sum"] or 0), "columns": rows.columns}, sort_keys=True)


def with_digest(rows: DataFrame, col: str) -> DataFrame:
    return rows.withColumn(f"{col}_sha256", F.sha2(F.col(col), 256))
