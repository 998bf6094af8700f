"""What SQL text can call: functions, a table function, and views of redacted tables.

``luhn_valid``, ``iban_valid`` and ``shannon_entropy`` are SQL expressions, which the optimizer sees through; so are the
views of :func:`redact_view`. ``redact``, ``pii_spans`` and ``pii_matches`` of single values run in Arrow batches
(:mod:`lacuna.functions.arrow_engine`): the pipeline's expression is too large to be written into every query text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from lacuna.functions import arrow_engine as engine
from lacuna.plans.pipeline import Config, Pipeline
from lacuna.sources.session import ship

SPANS = "array<struct<type:string,start:int,end:int,text:string>>"


def _rows(text: str) -> list[dict]:
    """Spans with byte offsets."""
    return [{"type": k, "start": len(text[:a].encode()), "end": len(text[:b].encode()), "text": text[a:b]} for k, a, b in engine.spans(text)]


def _function(kind: str, one: Callable):
    @pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda s: None if s is None else one(s))

    return run


class _Matches:
    def eval(self, text: str) -> Iterator[tuple]:
        for m in _rows(text) if text is not None else ():
            yield m["type"], m["start"], m["end"], m["text"]


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_EXPRESSIONS = {
    "luhn_valid(v STRING) RETURNS BOOLEAN": f"""length({_DIGITS}) >= 13 AND aggregate(transform(filter(split(reverse({_DIGITS}), ''), c -> c <> ''), (c, k) ->
        CASE WHEN k % 2 = 0 THEN cast(c AS INT) WHEN cast(c AS INT) > 4 THEN cast(c AS INT) * 2 - 9 ELSE cast(c AS INT) * 2 END), 0, (a, x) -> a + x) % 10 = 0""",
    "iban_valid(v STRING) RETURNS BOOLEAN": """length(v) BETWEEN 15 AND 34 AND aggregate(split(substring(v, 5) || substring(v, 1, 4), ''), 0, (a, c) -> CASE WHEN a < 0 THEN a
        WHEN ascii(c) BETWEEN 48 AND 57 THEN (a * 10 + ascii(c) - 48) % 97 WHEN ascii(c) BETWEEN 65 AND 90 THEN (a * 100 + ascii(c) - 55) % 97 ELSE -1000000 END) = 1""",
    "shannon_entropy(v STRING) RETURNS DOUBLE": """CASE WHEN v = '' THEN cast(0 AS DOUBLE) ELSE aggregate(array_distinct(split(v, '')), cast(0 AS DOUBLE), (a, c) ->
        a - (length(v) - length(replace(v, c, ''))) / length(c) / octet_length(v) * log2((length(v) - length(replace(v, c, ''))) / length(c) / octet_length(v))) END""",
}


def register(spark: SparkSession) -> None:
    """Publishes ``redact``, ``pii_spans``, ``luhn_valid``, ``iban_valid``, ``shannon_entropy``, and ``pii_matches`` (a table function)."""
    ship(spark)
    for head, body in _EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, kind, one in (("redact", "string", engine.redact), ("pii_spans", SPANS, _rows)):
        spark.udf.register(name, _function(kind, one))
    spark.udtf.register("pii_matches", udtf(_Matches, returnType="type string, start int, end int, text string"))


def redact_view(spark: SparkSession, source: str, target: str, text_col: str = "text", config: Config | None = None) -> DataFrame:
    """A temporary view of ``source`` with ``redacted`` and ``spans``, for use from SQL text; all in the JVM."""
    out = Pipeline(config or Config()).run(spark.table(source), text_col)
    out.createOrReplaceTempView(target)
    return out
