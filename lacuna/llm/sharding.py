"""Contiguous sharding with the smallest possible largest shard.

Documents of equal text are one atomic group. Groups are ordered by their least document id; each shard is a
contiguous run of groups. The smallest feasible capacity is found by binary search, each capacity being checked
greedily; then the order is cut: each shard is as near to an even share of what is left as that capacity and the
shards to come allow.

The groups stay distributed. What the driver sees is a list of at most ``CELLS`` cells of the running total
(several neighbouring groups each, at first), on which every check either decides or names the cells that it
needs to see more finely; those are looked up and the search goes on. So the answer is exact for any number of
groups, while the driver holds a bounded list.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, sized_partitions

SHARDS = 24
CELLS = 65_536
OVERHEAD = 8
#: Rows of narrow tables that one task orders.
ORDERED_ROWS = 500_000


class Cells:
    """Ends of the known groups or runs of groups on the axis of the running total.

    ``ends[k]`` closes cell k, which begins at ``ends[k - 1]``; ``whole[k]`` says that it is one group, which
    can't be cut. Cells of several groups also know where their first group ends and their last one begins.
    """

    def __init__(self, rows: list[tuple[int, int, int, int, int]]) -> None:
        """rows: (start, end, number of groups, end of the first group, start of the last group)."""
        self.rows = sorted(rows)
        self.ends = [r[1] for r in self.rows]
        self.total = self.ends[-1] if rows else 0

    def last_cut(self, x: int) -> tuple[int, int, int | None]:
        """Bounds on the largest cut at or below ``x``, and the cell to look into if they differ."""
        if x >= self.total:
            return self.total, self.total, None
        k = bisect.bisect_right(self.ends, x)  # the cell that x lies in
        start, _, n, first, last = self.rows[k]
        if n == 1 or x < first:
            return start, start, None
        if x >= last:
            return last, last, None
        return first, min(x, last), k

    def next_cut(self, x: int) -> tuple[int, int, int | None]:
        """Bounds on the smallest cut above ``x``."""
        if x >= self.total:
            return self.total, self.total, None
        k = bisect.bisect_right(self.ends, x)
        start, end, n, first, last = self.rows[k]
        if n == 1 or x >= last:
            return end, end, None
        if x < first:
            return first, first, None
        return x + 1, last, k

    def fits(self, capacity: int, shards: int, low: int = 0, high: int | None = None) -> tuple[bool | None, set[int]]:
        """Greedily: does what comes after the cut at ``low`` (or ``high``) fit? None: look into the cells named."""
        high, need = low if high is None else high, set()
        for _ in range(shards):
            low, _, a = self.last_cut(low + capacity)
            _, high, b = self.last_cut(high + capacity)
            need |= {a, b} - {None}
        if low >= self.total:
            return True, set()
        return (False, set()) if high < self.total else (None, need)


def _least_capacity(cells: Cells, shards: int, low: int, high: int) -> tuple[int, int, set[int]]:
    """Binary search as far as the cells allow: capacity is above ``low`` and at most ``high``."""
    while high - low > 1:
        mid = (low + high) // 2
        fits, need = cells.fits(mid, shards)
        if fits is None:
            return low, high, need
        low, high = (low, mid) if fits else (mid, high)
    return low, high, set()


def _cuts(cells: Cells, shards: int, capacity: int) -> tuple[list[int], set[int]]:
    """Cut after cut: nearest to an even share, unless the rest then no longer fits; at the latest the greedy cut."""
    at, out = 0, []
    for left in range(shards, 1, -1):
        share = at + (cells.total - at) // left
        (below, _, a), (above, _, b), (most, _, c) = cells.last_cut(share), cells.next_cut(share), cells.last_cut(at + capacity)
        if need := {a, b, c} - {None}:
            return out, need
        choice = most
        for cut in sorted({max(below, at), above}, key=lambda y: abs(y - share)):
            if at <= cut <= at + capacity:
                fits, need = cells.fits(capacity, left - 1, cut)
                if fits is None:
                    return out, need
                if fits:
                    choice = cut
                    break
        out.append(choice)
        at = choice
    return out, set()


def minimax_cuts(look, shards: int) -> tuple[int, list[int]]:
    """(capacity, cuts on the running total). ``look(None)`` gives first cells, ``look(spans)`` finer ones.

    A span is the start of a cell's first and last group; its finer cells must set these two apart.
    """
    rows = look(None)
    if not rows:
        return 0, [0] * (shards - 1)
    cells = Cells(rows)
    low, high = max(max(r[1] - r[0] for r in cells.rows if r[2] == 1) if any(r[2] == 1 for r in cells.rows) else 0, -(-cells.total // shards)) - 1, cells.total
    while True:
        low, high, need = _least_capacity(cells, shards, low, high)
        if not need:
            cuts, need = _cuts(cells, shards, high)
            if not need:
                return high, cuts
        spans = [(cells.rows[k][0], cells.rows[k][4]) for k in sorted(need)]
        finer = look(spans)
        cells = Cells([r for k, r in enumerate(cells.rows) if k not in need] + finer)


def _group_totals(rows: DataFrame, key: str) -> DataFrame:
    """Settled ``(key, start, size)``: groups in order with the running total before them.

    Ordered by ranges, a running total within each range, and the ranges' totals summed on the driver (one
    number per range).
    """
    spark = rows.sparkSession
    groups = settle(rows.groupBy(key).agg(F.min("doc_id").alias("first"), F.sum("size").alias("size")), "groups")
    parts = sized_partitions(groups, ORDERED_ROWS, spark.sparkContext.defaultParallelism)
    ranged = settle(groups.repartitionByRange(parts, F.asc_nulls_first("first"), key).withColumn("part", F.spark_partition_id()), "ranged-groups")
    sums = {r["part"]: r["s"] for r in ranged.groupBy("part").agg(F.sum("size").alias("s")).collect()}
    offset, total = {}, 0
    for p in sorted(sums):
        offset[p], total = total, total + sums[p]
    inner = F.sum("size").over(W.partitionBy("part").orderBy(F.asc_nulls_first("first"), key)) - F.col("size")
    before = spark.createDataFrame(sorted(offset.items()), "part int, before long")  # one row per range of ORDERED_ROWS
    return settle(ranged.withColumn("start", inner).join(F.broadcast(before), "part").select(key, (F.col("start") + F.col("before")).alias("start"), "size"), "running-totals")


def _look(totals: DataFrame, cells: int):
    """Cells of the running total, from the distributed table of groups."""

    def summed(df: DataFrame, cell) -> list[tuple]:
        end = F.col("start") + F.col("size")
        g = df.groupBy(cell.alias("cell")).agg(F.min("start").alias("a"), F.max(end).alias("b"), F.count("*").alias("n"), F.min(end).alias("c"), F.max("start").alias("d"))
        return [tuple(r)[1:] for r in g.collect()]

    def look(spans):
        if spans is None:
            last = totals.agg(F.max("start")).first()[0]
            return [] if last is None else summed(totals, F.floor(F.col("start") / (last // cells + 1)))
        each = max(2, cells // len(spans))
        found = []
        for k in range(0, len(spans), 64):
            some = spans[k : k + 64]
            inside = [(F.col("start") >= a) & (F.col("start") <= b) for a, b in some]
            any_of, cell = inside[0], None
            for c in inside[1:]:
                any_of = any_of | c
            for n, (c, (a, b)) in enumerate(zip(inside, some)):
                v = F.lit(n * each) + F.floor((F.col("start") - a) / ((b - a) // each + 1))
                cell = F.when(c, v) if cell is None else cell.when(c, v)
            found += summed(totals.where(any_of), cell)
        return found

    return look


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, one row per document; ``slot`` counts from 0 in each shard.

    Null text has no bytes and is a group of its own, apart from empty text; null ids come first; repeated rows
    take a slot each; empty shards happen only where there are fewer groups than shards; an empty table gives an
    empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = settle(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"").cast("binary")).alias("group"),
        ),
        "shard-rows",
    )
    totals = _group_totals(rows, "group")
    _, cuts = minimax_cuts(_look(totals, cells), shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("start") >= c).cast("int")
    placed = settle(rows.join(totals.select("group", number.alias("shard")), "group").select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("nth")), "sharded-rows")
    parts = sized_partitions(placed, ORDERED_ROWS, spark.sparkContext.defaultParallelism)
    ranged = settle(placed.repartitionByRange(parts, "shard", F.asc_nulls_first("doc_id"), "nth").withColumn("part", F.spark_partition_id()), "ranged-rows")
    counts = {(r["part"], r["shard"]): r["n"] for r in ranged.groupBy("part", "shard").agg(F.count("*").alias("n")).collect()}
    before, running = {}, {}
    for p, s in sorted(counts):
        before[p * shards + s] = running.get(s, 0)
        running[s] = running.get(s, 0) + counts[p, s]
    known = spark.createDataFrame(sorted(before.items()), "at long, before long")  # shards x ranges rows at most
    inner = F.row_number().over(W.partitionBy("part", "shard").orderBy(F.asc_nulls_first("doc_id"), "nth")) - 1
    out = ranged.withColumn("inner", inner).withColumn("at", (F.col("part") * shards + F.col("shard")).cast("long")).join(F.broadcast(known), "at")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("inner") + F.col("before")).alias("slot"))


def op3(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
