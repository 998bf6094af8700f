"""What the operators share: settled tables and column guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.session import scratch, ship

__all__ = ["discard", "scratch", "settle", "ship", "sized_partitions", "table", "text_or_empty"]


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared scratch folder and reads it back.

    It cuts lineage (a lost executor costs a re-read, not a recomputation), and gives the optimizer the
    table's true size, so that it broadcasts the table only where it is known to be small.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def sized_partitions(df: DataFrame, per: int, least: int = 1) -> int:
    """Partitions of about ``per`` rows for a settled table (a count of a written table reads only footers)."""
    return max(least, -(-df.count() // per))
