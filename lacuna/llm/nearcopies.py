"""Groups of near copies: SimHash links completed to all pairs of a Jaccard similarity of word shingles.

Texts with equal sets of shingles collapse to one representative. Candidates come from two searches: the pivot
distance tables of :mod:`lacuna.llm.simhash` over fingerprints of the same shingles, and ``BANDS`` keys of ``ROWS``
minima of hashed shingles, which reach those similar pairs that no fingerprint radius that can be indexed covers. A
pair of similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS, so that one of 0.8 is missed once in
10**9. Among texts that share a key, those are linked whose parity bitmaps allow the similarity: a bitmap has 4 to 8
bits a shingle, every shingle turns one over, and so two bitmaps differ in no more bits than their sets in shingles.
The bound loses no pair, and leaves few that are much less similar.

Candidate links only decide which texts meet. Components over them are compared on their whole sets of shingles, each
set in one place; components of many shingles are split into pairs of chunks. What is found similar there, and
nothing else, makes groups. Links that span the connections are kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, ship
from .components import connected_components
from .simhash import HOT_KEY, SEED, chunk_pairs, fingerprint_links, majority, shingle_hashes, signed

NGRAM = 5
#: The least similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 4
#: Shingles of a component that are compared in one task; larger ones are split.
HOT_SHINGLES = 4_000_000
#: Keys with more texts than this are searched by matrices of bits, others pair by pair.
SHORT_GROUP = 24
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8. Fewer words than ``ngram``: one shingle of all of them."""
    return np.unique(shingle_hashes(data, ngram))


def keys(found: np.ndarray) -> np.ndarray:
    """One key per band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(found), 512):  # keeps the matrix in the cache
        h = (found[k : k + 512, None] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, ((h ^ (h >> np.uint64(32))) * _MIX[0]).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def bitmap(found: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits, in the least power of two of bytes with 4 bits a shingle or more."""
    size = 1 << max(6, (4 * len(found) - 1).bit_length())
    at = ((found ^ (found >> np.uint64(31))) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fits(differ, sizes, least: tuple[int, int]):
    """Sets of so many shingles together that differ in no fewer than ``differ`` can have the similarity."""
    return differ * (least[1] + least[0]) <= sizes * (least[1] - least[0])


def _signatures(docs: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """``(doc_id, digest, n, fp, keys, bits)``: digest of the set of shingles, its size, SimHash, keys and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [shingle_hashes(t or b"", ngram) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps = [signed(majority(h)) for h in every]
            found = [np.unique(h) for h in every]
            own = np.concatenate([np.zeros(0, np.int64), *(keys(s).view(np.int64) for s in found if len(s))])
            ends = np.cumsum([0, *(BANDS * (len(s) > 0) for s in found)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array(fps, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own)), pa.array([bitmap(s) for s in found], pa.binary()),
                ],
                ["doc_id", "digest", "n", "fp", "keys", "bits"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, digest binary, n long, fp long, keys array<long>, bits binary")


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    """``docs`` (id, text) to ``(id, n, found)`` with all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t or b"", ngram).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), values], ["id", "n", "found"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, found array<long>")


class _Forest:
    """Union-find over ids; tells whether a link joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _walk(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the connections of ``n`` things; ``near(x, rest)`` tells which of the rest are linked to x.
    What is reached is not compared again as the rest of anything."""
    out, rest = [], np.arange(n)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = near(x, rest)
            out += [(x, y) for y in rest[hit].tolist()]
            front += rest[hit].tolist()
            rest = rest[~hit]
    return out


def _bit_links(sizes: list[int], bits: list[bytes], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links among texts of one key whose bitmaps allow the similarity. Sets whose bitmaps differ by more than a factor
    of two in size differ too much themselves."""
    n = len(sizes)
    if n <= SHORT_GROUP:
        whole = [int.from_bytes(b, "little") for b in bits]

        def fold(k: int, size: int) -> int:
            x, own = whole[k], len(bits[k])
            while own > size:
                own //= 2
                x = (x >> 8 * own) ^ (x & ((1 << 8 * own) - 1))
            return x

        forest, out = _Forest(), []
        for a in range(n):
            for b in range(a + 1, n):
                if min(sizes[a], sizes[b]) * least[1] >= max(sizes[a], sizes[b]) * least[0] and forest.root(a) != forest.root(b):
                    size = min(len(bits[a]), len(bits[b]))
                    if _fits((fold(a, size) ^ fold(b, size)).bit_count(), sizes[a] + sizes[b], least):
                        forest.join(a, b)
                        out.append((a, b))
        return out
    count = np.array(sizes)
    wide = np.array([len(b) for b in bits])
    rows = {w: np.flatnonzero(wide == w) for w in set(wide.tolist())}
    at = np.zeros(n, np.int64)
    for r in rows.values():
        at[r] = np.arange(len(r))
    full = {w: np.frombuffer(b"".join(bits[k] for k in r), np.uint64).reshape(len(r), -1) for w, r in rows.items()}
    half = {w: m[:, : w // 16] ^ m[:, w // 16 :] for w, m in full.items() if w >= 16}

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        hit, w = np.zeros(len(rest), bool), int(wide[x])
        for other, one, many in ((w, full[w], full.get(w)), (2 * w, full[w], half.get(2 * w)), (w // 2, half.get(w), full.get(w // 2))):
            if many is None or one is None:
                continue
            k = np.flatnonzero(wide[rest] == other)
            differ = np.bitwise_count(many[at[rest[k]]] ^ one[at[x]]).sum(axis=1, dtype=np.int64)
            hit[k] = _fits(differ, count[rest[k]] + count[x], least)
        return hit & (np.minimum(count[rest], count[x]) * least[1] >= np.maximum(count[rest], count[x]) * least[0])

    return _walk(n, near)


def _set_links(found: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links among texts, by their whole sets of shingles."""
    sizes = np.array([len(s) for s in found])
    flat = np.unique(np.concatenate(found), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    there = np.zeros(int(flat.max(initial=0)) + 1, np.int64)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        own = flat[starts[x] : ends[x]]
        fit = np.flatnonzero(np.minimum(sizes[rest], sizes[x]) * least[1] >= np.maximum(sizes[rest], sizes[x]) * least[0])
        hit = np.zeros(len(rest), bool)
        if len(fit):
            k = rest[fit]
            there[own] = 1
            first = np.cumsum(sizes[k]) - sizes[k]
            codes = flat[np.repeat(starts[k] - first, sizes[k]) + np.arange(int(sizes[k].sum()))]
            both = np.add.reduceat(there[codes], first)
            there[own] = 0
            hit[fit] = both * least[1] >= (sizes[k] + sizes[x] - both) * least[0]
        return hit

    return _walk(len(found), near)


def _grouped(rows: DataFrame, links: Callable[[list], list[tuple[int, int]]], own: str) -> DataFrame:
    """``rows`` (place, sub, id, ...) to links ``(a, b)``, by ``links`` of the rows of one place and sub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, forest = None, [], _Forest()

        def flush() -> list[tuple[int, int]]:
            found = [(held[a][0], held[b][0]) for a, b in links([r[1:] for r in held])] if len(held) > 1 else []
            return [p for p in found if forest.join(*p)]

        for b in batches:
            out: list[tuple[int, int]] = []
            place, sub = b.column(0).to_pylist(), b.column(1).to_pylist()
            cols = [c.to_pylist() if not pa.types.is_list(c.type) else [x.values.to_numpy() for x in c] for c in b.columns[2:]]
            for key, *row in zip(zip(place, sub), *cols):
                if key != at:
                    out += flush()
                    at, held = key, []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])
        out = flush()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])

    return rows.select("place", "sub", "id", *own.split()).repartition("place", "sub").sortWithinPartitions("place", "sub").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, least: tuple[int, int] = LEAST) -> DataFrame:
    """``(doc_id, component_id)``, one row per document; component = least id reachable over pairs of at least the similarity.

    Ids are unique and not null. Null texts count as empty; texts without words are one group. Other columns are not
    looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    every = settle(_signatures(docs, id_col, text_col, ngram), "signatures")
    signs = settle(every.select("doc_id", "digest"), "digests")
    reps = settle(signs.groupBy("digest").agg(F.min("doc_id").alias("id")), "set-representatives")
    own = settle(every.where("n > 0").join(reps.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "fp", "keys", "bits"), "sets")

    discard(spark, every)
    keyed = settle(own.select(F.explode("keys").alias("key"), "id"), "shingle-keys")
    sizes = settle(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared-keys")
    shared = settle(chunk_pairs(keyed.join(sizes.hint("merge"), "key"), "key", F.ceil(F.col("m") / HOT_KEY), "id"), "key-places")
    placed = shared.join(own.select("id", "n", "bits").hint("merge"), "id")
    alike = settle(_grouped(placed, lambda rows: _bit_links([r[0] for r in rows], [r[1] for r in rows], least), "n bits"), "alike")
    by_fp = settle(own.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    same = own.join(by_fp.withColumnRenamed("id", "first").hint("merge"), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    meet = connected_components(alike.unionByName(same).unionByName(fingerprint_links(by_fp)))
    for done in (keyed, sizes, shared, alike, by_fp):
        discard(spark, done)

    meet = settle(meet.join(own.select(F.col("id").alias("node"), "n").hint("merge"), "node"), "meeting")
    load = meet.groupBy("component").agg(F.sum("n").alias("load"))
    meet = settle(meet.join(load, "component").select(F.col("node").alias("id"), "component", F.ceil(F.col("load") / HOT_SHINGLES).alias("g")), "meeting-places")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(meet.select("id"), "id", "left_semi")  # few texts meet
    sets = settle(_sets(texts, ngram).join(meet, "id"), "meeting-sets")
    pieces = chunk_pairs(sets, "component", F.col("g"), "id")
    links = settle(_grouped(pieces, lambda rows: _set_links([r[0] for r in rows], least), "found"), "links")
    comp = connected_components(links)
    by_digest = settle(reps.join(comp.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")), "set-components")
    out = settle(signs.select("doc_id", "digest").join(by_digest.hint("merge"), "digest").select("doc_id", "component_id"), "near-copies")
    for done in (signs, reps, own, sets, links, by_digest):
        discard(spark, done)
    return out


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies, with all their columns.

    The document with the smallest id stays (null ids come last, then the first row). Rows are numbered in a table
    that is written once, so that they bear the same number wherever they are read; repeated rows are copies.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_copies(numbered, row, text_col, ngram, least)
    ids = numbered.select(F.col(row).alias("doc_id"), F.col(id_col).alias("own_id"))
    order = F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", F.col("doc_id").alias("row"))
    stay = groups.join(ids.hint("merge"), "doc_id").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    # rows are unique keys: one way of joining at every size, without skew
    return numbered.join(settle(stay, "survivors").hint("merge"), row, "left_semi").select(docs.columns)
