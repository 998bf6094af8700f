"""Best-fit packing of tokenized documents by the sum-of-squares rule.

A sequence holds ``capacity`` tokens. Open sequences are counted by residual gap; a piece goes where the sum of
the squared counts becomes smallest. The rule needs one array of ``capacity`` counts per bin set, so that any
number of pieces streams through in bounded memory.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

CAPACITY = 2048
#: Pieces that share one set of open sequences. Each set ends with a few open sequences, so a larger one wastes less.
SET_PIECES = 8192
#: Words whose ids a worker keeps; the memory is let go when full.
CACHED_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte: itself where printable, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Exact for tokenizers whose tokens never span a space or line feed: parts between those are encoded by the
    tokenizer itself, each distinct part once while it is remembered. Parts may hold any other white space.

    A part that is a word and closing marks is encoded as the word in lower case and the marks, if the tokenizer
    takes them apart and ignores case, which is probed when it is loaded; so case and marks don't multiply words.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        probes = ["The", "straße,", "ÉTÉ.", "a?!", "ñandúes", "Wörter;", "naïve...", "ΩΜΕΓΑ", "Привет,", "x", "日本語:", "it's", "B2B,"]
        self.splits = all((self._split(p) or self._whole([p])[0]) == self._whole([p])[0] for p in probes)

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def _split(self, part: str) -> bytes | None:
        """Ids of word and marks; None if the part is something else, or of letters whose case is not plain."""
        word = part.rstrip(self.MARKS)
        if "Σ" in word or not word.isalpha():  # its small letter depends on its place
            return None
        low = word.lower()
        ids = self.words.get(low)
        if ids is None:
            if not low.isascii() and (not low.isalpha() or len(low) != len(word) or not (unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low))):
                return None
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            ids = self.words[low] = np.array([t.id for t in self.tok.model.tokenize(shown)], "<u4").tobytes()
        if len(word) == len(part):
            return ids
        end = part[len(word) :]
        if end not in self.marks:
            self.marks[end] = self._whole([end])[0]
        return ids + self.marks[end]

    def learn(self, parts: list[str]) -> None:
        if self.splits:
            left = []
            for p in parts:
                ids = self._split(p)
                if ids is None:
                    left.append(p)
                else:
                    self.known[p] = ids
            parts = left
        for k in range(0, len(parts), 20_000):
            some = parts[k : k + 20_000]
            self.known.update(zip(some, self._whole(some)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 256):
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
                self.words.clear()
                self.marks.clear()
            split = [t.replace("\n", " ").split(" ") for t in texts[k : k + 256]]
            self.learn(list(set().union(*split).difference(self.known)))
            known = self.known
            for parts in split:
                yield b"".join(map(known.__getitem__, parts))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut only where longer than ``capacity``."""
    ship(docs.sparkSession)
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset per piece, in the order given; every size lies in 1..capacity.

    Adding a piece of size s to gap g takes one bin from gap g and, if g > s, gives one to gap g - s: the sum of
    squared counts changes by -2N(g) + 1 + 2N(g - s) + 1. A new bin counts as gap ``capacity``. Ties go to the
    smaller gap.
    """
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins are closed
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, new = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        grow = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        grow[0] -= 2 * count[0] + 1  # gap s becomes full: nothing is added at gap 0
        usable = count[s:] > 0
        usable[-1] = True  # a new bin
        grow[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = s + int(np.where(usable, grow, never).argmin())
        if g == capacity:
            b, at, new = new, 0, new + 1
        else:
            b, at = open_bins[g].pop(), capacity - g
            count[g] -= 1
        bins[k], offsets[k] = b, at
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares over pieces from large to small."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins[order], offsets[order] = sum_of_squares(sizes[order], capacity)
    return bins, offsets


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, set_pieces: int = SET_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to settled pieces.

    Pieces are dealt by a hash of document, piece and row into sets of about ``set_pieces``; every set is packed by
    itself, so that work and memory per task are bounded whatever the input, and no key can fill one task.
    """
    spark = pieces_df.sparkSession
    ship(spark)
    sets = max(1, -(-pieces_df.count() // set_pieces))
    schema = pieces_df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            bins, offsets = best_fit(t["length"].to_numpy(), capacity)
            t = t.append_column("sequence_id", pa.array(bins * sets + now)).append_column("offset", pa.array(offsets))
            yield from t.drop_columns(["pack_set"]).to_batches()

        for b in batches:
            keys = b.column(b.schema.get_field_index("pack_set")).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if now is not None and keys[x] != now:
                    yield from flush()
                    held = []
                now = int(keys[x])
                held.append(b.slice(x, y - x))
        if held:
            yield from flush()

    key = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(sets))
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    dealt = pieces_df.withColumn("pack_set", key).repartition(sets, "pack_set").sortWithinPartitions("pack_set", F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(run, f"{cols}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its place.

    Null and empty texts are one piece of the end id alone; an empty table gives an empty result; repeated rows
    are packed as often as they come; other columns are not looked at.
    """
    return pack(settle(pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity), "pieces"), capacity)


def op8(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
