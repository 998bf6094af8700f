"""The redaction pipeline: stages one after the other, each seeing what is claimed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.detect import SPAN, pattern_stage, secret_stage
from lacuna.operators.entities import Backend, entity_stage
from lacuna.operators.ruleset import ALL_TYPES, PATTERNS, RULES, Pattern, Rule
from lacuna.operators.spans import fully_covered, merge, only_types, redact
from lacuna.functions.columns import none_of


class Stage(Protocol):
    """Adds a column ``found`` of spans to rows with columns ``text`` and ``claimed``."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Config:
    """``disabled`` types are dropped after each stage, so that later stages see their text as free.

    ``dry_run`` leaves texts as they are and reports spans. ``thorough`` adds the entity stage where a backend is
    given. ``entropy_threshold`` is kept for callers that set it; the rules carry their own floors.
    """

    disabled: tuple[str, ...] = ()
    dry_run: bool = False
    thorough: bool = False
    entropy_threshold: float = 3.5
    patterns: tuple[Pattern, ...] = PATTERNS
    rules: tuple[Rule, ...] = RULES

    @property
    def enabled(self) -> tuple[str, ...]:
        return tuple(t for t in ALL_TYPES if t not in self.disabled)


@lru_cache(maxsize=16)
def _expression(kind: str, rules: tuple, app: str) -> Column:
    """A stage's expression, built once per application: it takes thousands of calls into the JVM."""
    return pattern_stage(F.col("text"), rules) if kind == "patterns" else secret_stage(F.col("text"), F.col("claimed"), rules)


def patterns_stage(config: Config) -> Stage:
    return lambda df: df.withColumn("found", _expression("patterns", config.patterns, df.sparkSession.sparkContext.applicationId))


def secrets_stage(config: Config) -> Stage:
    return lambda df: df.withColumn("found", _expression("secrets", config.rules, df.sparkSession.sparkContext.applicationId))


@dataclass(frozen=True)
class Pipeline:
    config: Config = field(default_factory=Config)
    stages: tuple[Stage, ...] | None = None
    backend: Backend | None = None

    def _stages(self) -> tuple[Stage, ...]:
        if self.stages is not None:
            return self.stages
        entities = (entity_stage(self.backend),) if self.config.thorough and self.backend is not None else ()
        return (patterns_stage(self.config), secrets_stage(self.config), *entities)

    def detect(self, docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
        """Adds the spans found by all stages. Per row only: no shuffle, batch and streaming alike."""
        own = docs.columns
        df = docs.select(*(F.col(c) for c in own), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), none_of(SPAN).alias("_claimed"))
        for stage in self._stages():
            found = stage(df.select(*(F.col(c).alias(f"_own_{k}") for k, c in enumerate(own)), F.col("_text").alias("text"), F.col("_claimed").alias("claimed")))
            merged: Column = merge(F.col("claimed"), F.col("found"))
            done = (F.size("claimed") > 0) & fully_covered(F.col("text"), F.col("claimed"))
            df = found.select(*(F.col(f"_own_{k}").alias(c) for k, c in enumerate(own)), F.col("text").alias("_text"), F.when(done, F.col("claimed")).otherwise(only_types(merged, self.config.enabled)).alias("_claimed"))
        return df.withColumnRenamed("_claimed", spans_col).drop("_text")

    def run(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds ``redacted`` and ``spans`` (type, start, end in bytes, text)."""
        found = self.detect(docs, text_col, "_spans")
        out = F.col(text_col) if self.config.dry_run else F.when(F.col(text_col).isNotNull(), redact(F.col(text_col), F.col("_spans")))
        plain = F.transform("_spans", lambda m: F.struct(*(m[k].alias(k) for k in ("type", "start", "end", "text"))))
        return found.withColumn("redacted", out).withColumn("spans", plain).drop("_spans")


def chain(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
