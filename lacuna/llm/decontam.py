"""Benchmark decontamination by spaced-seed hashing.

A mask picks some word positions of a window and ignores the rest, so that a substituted word at an ignored
position does not change the hash. Hashes of the benchmark's windows and of the documents' windows are joined;
every hit fixes an alignment of a document with an item, and the words around it are compared there.

A document holds an item if some stretch of ``min(words of the item, WINDOW)`` words of it is there with at
least ``SIMILARITY`` of the words equal in place. Items of fewer than five words count only where they are the
whole document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

WINDOW = 20
SIMILARITY = 0.8
#: Benchmark words per broadcast block; a larger benchmark is searched in several passes over the documents.
BLOCK_WORDS = 1_000_000
#: Two weight-5 masks that together hit every alignment of 15 words or more with a fifth of them substituted. Both have
#: gaps, as have those of shorter items of three words or more.
LONG_MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
LONG = 15
_WORD = re.compile(r"\w+")
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def _covers(mask: tuple[int, ...], length: int, gone: tuple[int, ...]) -> bool:
    return any(all(i + o not in gone for o in mask) for i in range(length - mask[-1]))


@cache
def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """Masks that together hit that many words with a fifth of them substituted: of the largest weight at which masks
    with gaps can do so, found greedily."""
    if length >= LONG:
        return LONG_MASKS
    if length < 3:
        return (tuple(range(length)),)
    for weight in range(5, 0, -1):
        left = set(combinations(range(length), length // 5))
        every = [(0, *m) for m in combinations(range(1, length), weight - 1) if (0, *m) != tuple(range(weight)) or weight == 1]
        hits = {m: {g for g in left if _covers(m, length, g)} for m in every}
        chosen = []
        while left and every:
            best = max(every, key=lambda m: (len(hits[m] & left), -m[-1]))
            if not hits[best] & left:
                break
            chosen.append(best)
            left -= hits[best]
        if not left:
            return tuple(chosen)
    raise ValueError("a mask of one position hits any word that is left")


class SeedIndex:
    """The seeds of one block of benchmark items: sorted hashes with item and position."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.codes = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int32) for _, ws in items]
        use: dict[tuple[int, ...], list[int]] = {}
        for k, c in enumerate(self.codes):
            for mask in masks_of(min(len(c), LONG)) if len(c) else ():
                use.setdefault(mask, []).append(k)
        self.tables = []
        for mask, owners in use.items():
            found = []
            for k in owners:
                h = self.hashes(self.codes[k], np.arange(len(self.codes[k]) - mask[-1]), mask)
                found.append(np.column_stack([h.view(np.int64), np.full(len(h), k), np.arange(len(h))]))
            rows = np.concatenate(found)
            h = rows[:, 0].copy().view(np.uint64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, h[order], rows[order, 1], rows[order, 2], bits))

    @staticmethod
    def hashes(codes: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for o, m in zip(mask, _MULT):
                h = (h + codes[at + o].astype(np.uint64) + np.uint64(1)) * np.uint64(m)
                h ^= h >> np.uint64(29)
        return h

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, item id, words equal, words compared) of each item found in each text."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        vocab, parts, sizes = self.vocab, [], []
        for t in texts:
            ws = words(t)
            sizes.append(len(ws))
            parts.append(np.fromiter((vocab.get(w, 0) for w in ws), np.int32, len(ws)))
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.cumsum(np.array(sizes, np.int64))
        starts = ends - np.array(sizes, np.int64)
        some = np.flatnonzero(codes)
        for mask, h, item, pos, bits in self.tables:
            at = some[some + mask[-1] < len(codes)]
            for o in mask[1:]:
                at = at[codes[at + o] > 0]
            found = self.hashes(codes, at, mask)
            keep = bits[(found >> np.uint64(44)).astype(np.int64)]
            at, found = at[keep], found[keep]
            lo, hi = np.searchsorted(h, found, "left"), np.searchsorted(h, found, "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            bounds = np.searchsorted(np.cumsum(hi - lo), np.arange(1, (hi - lo).sum() // 500_000 + 1) * 500_000).tolist()
            for x, y in zip([0, *bounds], [*bounds, len(at)]):  # hits expand in bounded portions
                n = hi[x:y] - lo[x:y]
                rows = np.repeat(lo[x:y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.searchsorted(ends, np.repeat(at[x:y], n), "right")
                lines = np.unique(np.column_stack([doc, item[rows], np.repeat(at[x:y], n) - pos[rows]]), axis=0)
                for d, k, first in lines.tolist():
                    self._compare(codes, starts[d], ends[d], d, k, first, best)
        return [(d, self.ids[k], a, b) for (d, k), (a, b) in sorted(best.items())]

    def _compare(self, codes: np.ndarray, start: int, end: int, d: int, k: int, first: int, best: dict) -> None:
        want = self.codes[k]
        w = min(len(want), WINDOW)
        a, b = max(first, start), min(first + len(want), end)
        same = np.zeros(len(want) + 1, np.int64)
        same[a - first + 1 : b - first + 1] = codes[a:b] == want[a - first : b - first]
        total = np.cumsum(same)
        n = int((total[w:] - total[:-w]).max())
        if n >= SIMILARITY * w - 1e-9 and n > best.get((d, k), (0, 0))[0]:
            best[d, k] = (n, w)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_WORDS) -> Iterator[SeedIndex]:
    """Indexes over blocks of at most ``most`` words (an item longer than that is a block by itself)."""
    held: list[tuple[int, list[str]]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long"), text_col).where(f"`{text_col}` is not null and `{id_col}` is not null").toLocalIterator():
        ws = words(r[1])
        if held and size + len(ws) > most:
            yield SeedIndex(held)
            held, size = [], 0
        held.append((r[0], ws))
        size += len(ws)
    if held:
        yield SeedIndex(held)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_matched, n_window)`` for each document and item it holds.

    Documents are never shuffled: each block of the benchmark goes to all tasks. Null and empty texts hold
    nothing; null items and items without words are passed over; repeated rows of either table are searched
    each; other columns are not looked at. Without benchmark rows the result is empty.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, n_matched long, n_window long"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def one(index: SeedIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shared.value.search(b.column(1).to_pylist())
                cols = list(zip(*found)) or [()] * 4
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "n_matched", "n_window"])

        return src.mapInArrow(run, schema)

    parts = [settle(one(x), "contaminations") for x in blocks(benchmark)]  # one block at a time is held and sent
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, in place.

    Null and empty texts hold nothing and stay; repeated rows go or stay alike; other columns pass through whatever
    their names. After all blocks of the benchmark but the last, the rows left are written.
    """
    spark = docs.sparkSession
    ship(spark)
    n = docs.columns.index(text_col)
    searched = False
    for index in blocks(benchmark):
        docs = settle(docs, "decontaminated") if searched else docs
        searched = True
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in shared.value.search(b.column(n).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10(spark, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same rows by comparing all words of all documents and items along all alignments.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT row, doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS q FROM b),
pairs AS (SELECT row, doc_id, item_id, n, p - q AS line, q FROM dw JOIN bw USING (word)),
many AS (SELECT row, doc_id, item_id, line, n FROM pairs GROUP BY ALL HAVING 5 * count(*) >= 4 * least(n, 20)),
near AS (
  SELECT row, doc_id, item_id, least(n, 20) AS win,
         count(*) OVER (PARTITION BY row, item_id, line ORDER BY q RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS same
  FROM pairs SEMI JOIN many USING (row, item_id, line)
)
SELECT doc_id, item_id, max(same)::BIGINT AS n_matched, win::BIGINT AS n_window
FROM near GROUP BY row, doc_id, item_id, win HAVING 5 * max(same) >= 4 * win
"""
