"""Near-duplicates by SimHash fingerprints, searched through pivot distance tables.

A fingerprint is 64 bits. ``PIVOTS`` fixed reference fingerprints are given; the distance of a fingerprint to
a pivot is the sum of its distances over ``SEGMENTS`` disjoint bit segments, and the distances of every
possible segment value to every pivot are precomputed (the pivot distance tables, a few thousand short rows).

Two fingerprints at most ``radius`` bits apart differ in no more than ``radius`` segments. So on at least
``SEGMENTS - radius`` segments their bits are equal: those bits are the search key, and every choice of segments is
one table of keys. (Equal bits have equal distances to all pivots; with 16 pivots the converse holds too, so that keys
of pivot coordinates would be the same keys.) Of the pairs that share a key, those are discarded of which any pivot
coordinate, the distance summed over all segments, differs by more than ``radius`` (triangle inequality); what
survives is verified on the bits. No link is lost. With seven segments a key has some 27 bits, so that few unrelated
fingerprints share one even where there are a billion.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, ship
from .components import connected_components

SEED = 42
PIVOTS = 16
SEGMENTS = 7
#: A key with more fingerprints than this is searched as pairs of chunks, in as many tasks as there are pairs.
HOT_KEY = 16_384
#: Runs up to this length are compared by shifts over a whole batch, longer ones one by one through leaders.
SHORT_RUN = 48
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(data: bytes, ngram: int) -> np.ndarray:
    """Hashes of the shingles of a text in UTF-8, repeats included. Fewer words than ``ngram``: one shingle of all of them."""
    words = data.translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= ngram:
        return np.array([digest(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: len(words) - ngram + 1].tolist(), ends[ngram - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero without hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):  # keeps the bit matrix small for very long texts
        total += np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.dtype("<u8"))[0])


def fingerprint(data: bytes, ngram: int = 4) -> int:
    """SimHash of one text in UTF-8. No words: zero. Fewer words than ``ngram``: one shingle of all of them."""
    return majority(shingle_hashes(data, ngram))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` the fingerprint's 64 bits as a signed long. Null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t, ngram)) if t else 0 for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class PivotTables:
    """Distances of all segment values to all pivots, and the keys that follow from them."""

    def __init__(self, radius: int = 4, segments: int = SEGMENTS, pivots: int = PIVOTS) -> None:
        if not 0 <= radius < segments:
            raise ValueError("radius must be below the number of segments")
        self.radius = radius
        refs = [xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(pivots)]
        edges = [round(64 * k / segments) for k in range(segments + 1)]
        self.shift = edges[:-1]
        self.width = [b - a for a, b in zip(edges, edges[1:])]
        self.near = []
        for s, w in zip(self.shift, self.width):
            values = np.arange(1 << w, dtype=np.uint64)
            own = np.array([(r >> s) & ((1 << w) - 1) for r in refs], np.uint64)
            self.near.append(np.bitwise_count(values[:, None] ^ own[None, :]).astype(np.int8))
        self.tables = list(combinations(range(segments), segments - radius))

    def _parts(self, fp: np.ndarray) -> list[np.ndarray]:
        return [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(self.shift, self.width)]

    def distances(self, fp: np.ndarray) -> np.ndarray:
        return sum(d[p] for d, p in zip(self.near, self._parts(fp)))

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """One row of keys per table: its number, and the bits of its segments."""
        parts = self._parts(fp)
        out = np.empty((len(self.tables), len(fp)), np.int64)
        for k, chosen in enumerate(self.tables):
            key = np.full(len(fp), k, np.int64)
            for s in chosen:
                key = (key << self.width[s]) | parts[s]
            out[k] = key
        return out

    def verified(self, fp: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, j), those whose pivot coordinates agree within the radius and whose bits do too."""
        keep = np.abs(near[i] - near[j]).max(axis=1) <= self.radius if len(i) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= self.radius
        return i[keep], j[keep]


class _Forest:
    """Union-find over row numbers; keeps only links that join two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((a, b))


def link_runs(fp: np.ndarray, runs: np.ndarray, pt: PivotTables) -> list[tuple[int, int]]:
    """Links between rows of equal ``runs`` value (sorted) that span all connections within them."""
    n = len(fp)
    forest, near = _Forest(n), pt.distances(fp)
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    ends = np.repeat(starts + sizes, sizes)
    for step in range(1, int(sizes[sizes <= SHORT_RUN].max(initial=1))):
        i = np.flatnonzero(short[: n - step] & (np.arange(n - step) + step < ends[: n - step]))
        forest.add(*pt.verified(fp, near, i, i + step))
    for a, size in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        _link_long(fp, near, np.arange(a, a + size), forest, pt)
    return forest.links


def _link_long(fp: np.ndarray, near: np.ndarray, rows: np.ndarray, forest: _Forest, pt: PivotTables) -> None:
    """Each row joins the first leader within the radius; then rows of different trees are compared, where the
    distance to a leader does not rule it out. Rows that a leader already joins are not compared again."""
    rest, groups = rows, []
    while len(rest):
        close = np.abs(near[rest] - near[rest[0]]).max(axis=1) <= pt.radius
        close[close] = np.bitwise_count(fp[rest[close]] ^ fp[rest[0]]) <= pt.radius
        own = rest[close]
        forest.add(np.full(len(own) - 1, own[0]), own[1:])
        groups.append(own)
        rest = rest[~close]
    for g, own in enumerate(groups[:-1]):
        later = np.concatenate(groups[g + 1 :])
        later = later[np.abs(near[later] - near[own[0]]).max(axis=1) <= 2 * pt.radius]
        later = later[np.bitwise_count(fp[later] ^ fp[own[0]]) <= 2 * pt.radius]
        if not len(later):
            continue
        for x in own:
            here = forest.root(int(x))
            other = later[np.fromiter((forest.root(int(y)) != here for y in later), bool, len(later))]
            if not len(other):
                break
            forest.add(*pt.verified(fp, near, np.full(len(other), x), other))


def chunk_pairs(rows: DataFrame, place: str, chunks: Column, by: str) -> DataFrame:
    """Adds ``place`` (that column) and ``sub``: rows of a place with one chunk meet there, others once for each pair of
    chunks of the place, so that every two of them meet in one sub, and no sub holds more than two chunks."""
    g = F.greatest(chunks.cast("long"), F.lit(1).cast("long"))
    cut = rows.withColumn("_g", g).withColumn("_c", F.pmod(F.xxhash64(by), F.col("_g"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
    return cut.withColumn("sub", F.least("_c", "_o") * F.col("_g") + F.greatest("_c", "_o")).withColumnRenamed(place, "place").drop("_g", "_c", "_o")


def fingerprint_links(reps: DataFrame, radius: int = 4, segments: int = SEGMENTS) -> DataFrame:
    """``reps`` (fp, id), one row per fingerprint, to links ``(a, b)`` of ids that span all pairs within ``radius``.

    The links found are true ones, and any two fingerprints within the radius are joined by a path of them;
    a group's pairs are not all listed.
    """
    spark = reps.sparkSession
    ship(spark)
    pt = PivotTables(radius, segments)

    def explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            keys = pt.keys(fp.view(np.uint64))
            t = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.tile(fp, t)), pa.array(np.tile(ids, t))], ["key", "fp", "id"])

    keyed = settle(reps.select("fp", "id").mapInArrow(explode_keys, "key long, fp long, id long"), "pivot-keys")
    # rows are dealt by their key at every size alike; only keys of many rows, which are few, are looked up and split
    hot = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY), "hot-keys")
    shared = chunk_pairs(keyed.join(hot, "key", "left"), "key", F.ceil(F.coalesce("n", F.lit(1)) / HOT_KEY), "fp").withColumnRenamed("place", "key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(m: np.ndarray) -> pa.RecordBatch:
            change = np.any(m[1:, :2] != m[:-1, :2], axis=1)
            runs = np.r_[0, np.cumsum(change)] if len(m) else np.zeros(0, np.int64)
            links = np.array(link_runs(np.ascontiguousarray(m[:, 2]).view(np.uint64), runs, pt), np.int64).reshape(-1, 2)
            ids = m[:, 3]
            return pa.RecordBatch.from_arrays([pa.array(ids[links[:, 0]]), pa.array(ids[links[:, 1]])], ["a", "b"])

        for b in batches:
            held.append(np.column_stack([c.to_numpy().astype(np.int64) for c in b.columns]))
            m = np.concatenate(held)
            last = np.flatnonzero(np.any(m[:, :2] != m[-1, :2], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield flush(m[:cut])
            held = [m[cut:]]
        if held and len(held[0]):
            yield flush(held[0])

    links = settle(shared.select("key", "sub", "fp", "id").repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(link, "a long, b long"), "links")
    discard(spark, keyed)
    discard(spark, hot)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document; component = least id reachable over links.

    Copies share a fingerprint and meet as one representative. Null and empty texts have fingerprint zero and
    are linked like any other; null ids stay with their fingerprint's component (null only if no other id is
    there); repeated rows are returned as often as they come; other columns are not looked at.
    """
    fps = settle(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    reps = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "representatives")
    links = fingerprint_links(reps.where("id is not null"), radius)
    comp = connected_components(links)
    by_fp = settle(reps.join(comp, reps["id"] == comp["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id")), "components")
    for done in (reps, links, comp):
        discard(docs.sparkSession, done)
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
