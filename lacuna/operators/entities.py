"""Entity stage: a pluggable model over what is still unclaimed, and the relational parts around it."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.columns import let, none_of
from lacuna.sources.session import ship

from .detect import SPAN, in_order
from .ruleset import NER_TYPES
from .spans import extend_house_numbers, gaps, merge_adjacent

MODEL_TYPE = "token-classifier-v1"
MOST_SPANS = 32
THRESHOLD = 0.5
OVERLAP_TOKENS = 64


class Backend(Protocol):
    """A model: for each text, entities as (start byte, end byte, type, score). Loaded once per worker."""

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]: ...


def guard_model(folder: str | None) -> bool:
    """Whether a model is installed; refuses artifacts of another kind."""
    if not folder or not os.path.exists(os.path.join(folder, "config.json")):
        return False
    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        kind = json.load(f).get("model_type")
    if kind != MODEL_TYPE:
        raise ValueError(f"unsupported model_type {kind!r}, expected {MODEL_TYPE!r}")
    return True


def windows(text: str, n_tokens: int, max_len: int) -> list[tuple[int, int]]:
    """Byte windows of a text longer than ``max_len`` tokens, ending at blanks of their second half where there are some."""
    data = text.encode()
    if n_tokens <= max_len:
        return [(0, len(data))]
    step, out, at = max(1, max_len - OVERLAP_TOKENS), [], 0
    while at < len(data):
        end = min(at + max_len, len(data))
        if end < len(data):
            blank = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if blank > at + max_len // 2:
                end = blank
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append((at, end))
        if end == len(data):
            break
        at += min(step, end - at)
        while data[at] & 0xC0 == 0x80:
            at += 1
    return out


_models: dict[str, Backend] = {}


class Loaded:
    """A backend that a worker loads when it first needs it, and keeps: ``factory`` makes the model, ``name`` tells it from
    others. ``max_len`` is the most tokens it takes (none: any number); ``count`` counts tokens."""

    def __init__(self, name: str, factory: Callable[[], Backend], max_len: int | None = None) -> None:
        self.name, self.factory, self.max_len = name, factory, max_len

    def _model(self) -> Backend:
        if self.name not in _models:
            _models[self.name] = self.factory()
        return _models[self.name]

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        return self._model()(texts)

    def count(self, text: str) -> int:
        return self._model().count(text)

    def close(self) -> None:
        """Lets this worker's model go; the next call loads it again."""
        _models.pop(self.name, None)


def best_first(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Greedily by falling score, without overlaps: what :func:`lacuna.operators.spans.best_by_score` does to columns."""
    kept: list[tuple[int, int, str, float]] = []
    for e in sorted(found, key=lambda e: (-e[3], e[0])):
        if all(e[1] <= k[0] or k[1] <= e[0] for k in kept):
            kept.append(e)
    return kept


def ask(backend: Backend, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Entities of each text: at most ``MOST_SPANS``, those of known types and enough score.

    Texts of more tokens than the backend takes go in overlapping windows, of whose entities the best are kept. Where a
    batch fails, its pieces are asked one by one, and only a piece that fails by itself has no entities.
    """
    longest, count = getattr(backend, "max_len", None), getattr(backend, "count", None)
    pieces: list[tuple[int, int, str]] = []
    for k, t in enumerate(texts):
        data = t.encode()
        cut = windows(t, count(t), longest) if longest and count else [(0, len(data))]
        pieces += [(k, a, data[a:b].decode()) for a, b in cut]

    def try_each(some: list[str]) -> list[list]:
        try:
            return list(backend(some))
        except Exception:  # noqa: BLE001 - the stage degrades to no entities
            return [[]] if len(some) == 1 else [x for one in some for x in try_each([one])]

    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    windowed = [0] * len(texts)
    for (k, a, _), entities in zip(pieces, try_each([p for _, _, p in pieces]) if pieces else []):
        windowed[k] += 1
        found[k] += [(a + s, a + e, t, score) for s, e, t, score in entities if t in NER_TYPES and score >= THRESHOLD]
    return [sorted(best_first(f) if n > 1 else f, key=lambda e: e[0])[:MOST_SPANS] for f, n in zip(found, windowed)]


def entity_stage(backend: Backend | None):
    """A pipeline stage over what is still unclaimed. Without a backend it finds nothing."""

    def stage(df: DataFrame) -> DataFrame:
        if backend is None:
            return df.withColumn("found", none_of(SPAN))
        ship(df.sparkSession)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float32())]))
        names = [*df.columns, "gaps"]
        src = df.withColumn("gaps", F.when(F.col("text") != "", gaps(F.col("text"), F.col("claimed"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                chunks = b.column(len(names) - 1).to_pylist()
                answers = iter(ask(backend, [g["text"] for row in chunks for g in row or ()]))
                rows = [[{"start": g["start"] + a, "end": g["start"] + z, "type": t, "score": s} for g in row or () for a, z, t, s in next(answers)] for row in chunks]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind)], [*names[:-1], "entities"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        out = src.mapInArrow(run, f"{schema}, entities array<struct<start:int,end:int,type:string,score:float>>")
        chars = lambda n: F.length(F.substring(F.col("text").cast("binary"), F.lit(1), n).cast("string"))

        def span(e: Column) -> Column:
            return let(F.struct(chars(e["start"]).alias("a"), chars(e["end"]).alias("b")), lambda c: F.struct(
                e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"), F.substring(F.col("text"), c["a"] + 1, c["b"] - c["a"]).alias("text"), c["a"].alias("cstart"), c["b"].alias("cend")))

        found = let(in_order(F.transform("entities", span)), lambda s: merge_adjacent(F.col("text"), s))
        return out.withColumn("found", let(found, lambda s: extend_house_numbers(F.col("text"), s))).drop("entities")

    return stage


# -- relational parts ---------------------------------------------------------------------------------------


def softmax_argmax(logits: Column) -> Column:
    """``struct<label_id, score>`` of the largest logit; of equal ones, the last."""

    def best(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        last = F.size(logits) - F.array_position(F.reverse(logits), top)
        return F.struct(last.cast("int").alias("label_id"), (1 / total).alias("score"))

    return let(F.array_max(logits), best)


def bio_decode(tokens: DataFrame, threshold: float = THRESHOLD, allowed: tuple[str, ...] = NER_TYPES) -> DataFrame:
    """Entities from labelled tokens (doc_id, pos, start, end, label, score), as islands of one type.

    Tokens without width or below the threshold, and labels that are no BIO tags or not allowed, end an entity; an
    ``I-`` without an open entity of its type begins one. Score = least score of its tokens.
    """
    type_of = F.regexp_extract("label", "^[BI]-(.*)$", 1)
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens.withColumn("type", F.when((F.col("start") < F.col("end")) & (F.col("score") >= threshold) & type_of.isin(*allowed), type_of))
    t = t.withColumn("before", F.lag("type").over(w))
    t = t.withColumn("first", (F.col("type").isNotNull() & (F.startswith(F.col("label"), F.lit("B-")) | ~F.col("type").eqNullSafe(F.col("before")))).cast("int"))
    t = t.withColumn("island", F.sum("first").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.where("type is not null").groupBy("doc_id", "island").agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score")).drop("island")
