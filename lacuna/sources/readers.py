"""Sources: tables, files as whole texts, JSON lines, word lists, token-class corpora, golden cases."""

from __future__ import annotations

import sys
import warnings
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.corpus import TRAINING_ROW, shuffle_rank

DOCUMENT = "doc_id string, kind string, name string, text string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out over all cores where the files give fewer tasks than there are (a few small files); tables of
    many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def from_string(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("string", "string", "string", text)], DOCUMENT)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row. A path without files is an error that names it."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"open {path!r}: no such file")
    at = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(at.alias("doc_id"), F.lit("file").alias("kind"), at.alias("name"), F.col("value").alias("text"))


def from_stdin(spark: SparkSession, stream: TextIO | None = None) -> DataFrame:
    return spark.createDataFrame([("-", "stdin", "-", (stream or sys.stdin).read())], DOCUMENT)


def resolve(spark: SparkSession, text: str | None, path: str | None, stream: TextIO | None = None) -> DataFrame:
    """``text`` if not empty, else the file, else standard input (or ``stream``)."""
    return from_string(spark, text) if text else from_files(spark, path) if path else from_stdin(spark, stream)


def read_jsonl(spark: SparkSession, path: str, schema: str = TRAINING_ROW) -> DataFrame:
    """JSON lines; blank lines are passed over, a line that is no JSON is an error. A missing path is a warning and an
    empty table."""
    if not _exists(spark, path):
        warnings.warn(f"{path} is missing; no rows are read", stacklevel=2)
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return lines.select("row.*")


def read_split(spark: SparkSession, folder: str, languages: tuple[str, ...] = (), most: int | None = None, schema: str = TRAINING_ROW) -> DataFrame:
    """All ``*.jsonl`` of a folder, or those of the languages; the first ``most`` rows by file and text."""
    paths = [f"{folder}/{x}.jsonl" for x in languages] or [f"{folder}/*.jsonl"]
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"no .jsonl files in {folder}")
    rows = spark.read.schema(schema).json(there)
    return rows if most is None else rows.select("*", F.col("_metadata.file_path").alias("_f")).orderBy("_f", "uid").limit(most).drop("_f")


def read_token_classes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("tokens", "ner_tags")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, category string, input string, expected_output string, notes string").json(path).where("id is not null")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words, trimmed, in order."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct().orderBy("word")


def username_core(line: Column) -> Column:
    """The first longest run of 4 to 20 letters, digits, ``_`` or ``.``; null without one."""
    runs = F.regexp_extract_all(line, F.lit("[A-Za-z0-9_.]{4,20}"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.nullif(longest, F.lit(""))


def read_usernames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(username_core(F.col("value")).alias("word")).where("word is not null").distinct().orderBy("word")


def read_gamer_tags(spark: SparkSession, path: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` whole-line tags of 3 to 20 letters, digits or ``_``: those of least hash."""
    tags = spark.read.text(path).select(F.trim("value").alias("word")).where(F.col("word").rlike(r"^[A-Za-z0-9_]{3,20}\z")).distinct()
    return tags.orderBy(shuffle_rank(seed, "word"), "word").limit(n)
