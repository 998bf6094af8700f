"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Two models, toxic and ordinary, give every character of a word (and its end) a probability after the up to
``ORDER - 1`` characters before it in the word:

* the class's own order: (c(h, x) - D)+ / c(h) + lambda(h) * shared(x | h without its first character), where c counts
  labelled documents of the class times their distinct words, and lambda(h) is the mass that the discount D took;
* the shared orders below, the same for both classes: interpolated Kneser-Ney over continuation counts, the number of
  distinct words, of all documents, labelled or not, that an n-gram was seen in; below them, an even share for every
  character and for one never seen.

Both sum to 1 after every context. A rare expression that neither class has seen rests on the same shared counts in
both and cancels but for the back-off masses. A word's comparison is the difference of its two log-likelihoods. A
text is compared by two numbers normalised by its length: the mean difference per word, and the share of words whose
difference is above ``DECISIVE``. A logistic curve over them gives the score. It is fitted on the labelled documents,
each compared by models that have not counted its own fold.

Bound: models and curve are fitted on at most ``FIT_DOCS`` labelled documents a class (those of least hash). What is
sent to tasks are the n-grams of those documents; nothing else is left out of the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, ship

FOLDS = 5
ORDER = 5
#: Taken from every count of a class. High, as copies of few documents make up much of a class.
DISCOUNT = 3.0
#: Taken from every shared count.
SHARED_DISCOUNT = 0.75
FIT_DOCS = 20_000
#: A word is decisive if it is e**3, some twenty times, likelier in one class.
DECISIVE = 3.0
#: Ridge of the curve.
HOLD = 0.1
BEGIN, END = "^", "$"  # no word holds them
CACHED_WORDS = 400_000
FLUSH_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def grams(word: str, order: int) -> list[str]:
    """Every character of the word and its end, with the up to ``order - 1`` characters before it."""
    s = f"{BEGIN}{word}{END}"
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


# -- counts ---------------------------------------------------------------------------------------------------


def distinct_words(texts: DataFrame) -> DataFrame:
    """``(w)``: the distinct words of all texts; repeats go in the tasks, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words(t))
                if len(seen) > FLUSH_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["w"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["w"])

    return texts.mapInArrow(run, "w string").distinct()


def continuation_counts(vocabulary: DataFrame, order: int) -> DataFrame:
    """``(g, n)``: in how many distinct words each n-gram of up to ``order`` characters comes (each place counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["g", "n"])
        for b in batches:
            for w in b.column(0).to_pylist():
                seen.update(grams(w, order))
            if len(seen) > FLUSH_WORDS:
                yield out()
                seen.clear()
        yield out()

    longest = vocabulary.mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    ends = longest.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.substring("g", k, F.lit(order)))).alias("g"))
    return ends.groupBy("g").agg(F.sum("n").alias("n"))


def shared_model(counts: DataFrame, order: int) -> DataFrame:
    """``(g, p)``: the shared probability of the last character of each n-gram seen, after the others."""
    context = F.substring("g", F.lit(1), F.length("g") - 1)
    counts = counts.withColumn("k", F.length("g")).withColumn("h", context)
    after = settle(counts.groupBy("k", "h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")), "toxicity-contexts")
    rows = counts.join(after, ["k", "h"])
    first = after.where("k = 1").select((1 / (F.col("kinds") + 1)).alias("even"))
    even = (first.first() or [1.0])[0]
    d = SHARED_DISCOUNT
    model = None
    for k in range(1, order + 1):
        own = rows.where(F.col("k") == k)
        low = own.withColumn("low", F.lit(even)) if model is None else own.join(model.select(F.col("g").alias("rest"), F.col("p").alias("low")), F.substring("g", 2, order) == F.col("rest"))
        at = low.select("g", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") * F.col("low")).alias("p"))
        at = settle(at, "toxicity-shared")
        model = at if model is None else model.unionByName(at)
    return model


def class_counts(labelled: DataFrame) -> DataFrame:
    """``(g, t1..t4, o1..o4)``: toxic and ordinary documents, by fold, times their distinct words, that hold each n-gram."""
    kinds = [f"{c}{f}" for c in "to" for f in range(1, FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                part = b.slice(k, 2_000)
                held: dict[str, Counter] = {}
                for t, y, f in zip(*(c.to_pylist() for c in part.columns)):
                    held.setdefault(f"{'t' if y else 'o'}{f}", Counter()).update(set(words(t)))
                for kind, seen in held.items():
                    found: Counter[str] = Counter()
                    for w, n in seen.items():
                        for g in grams(w, ORDER):
                            found[g] += n
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([kind] * len(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["g", "kind", "n"])

    tall = labelled.select("text", F.col("toxic") > 0, "fold").mapInArrow(run, "g string, kind string, n long")
    return tall.groupBy("g").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds))


def class_models(own: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per n-gram of either class: its context ``h``, and for each fold f left out (0: none) the probabilities
    ``t_f`` and ``o_f`` of its last character and the back-off masses ``lt_f`` and ``lo_f`` of the context."""
    own = own.withColumn("h", F.substring("g", F.lit(1), F.length("g") - 1))
    left = range(FOLDS)
    count = lambda c, f: sum((F.col(f"{c}{k}") for k in range(1, FOLDS) if k != f), F.lit(0))
    own = own.select("g", "h", *(count(c, f).alias(f"{c}_{f}") for c in "to" for f in left))
    most = F.lit(DISCOUNT)
    after = own.groupBy("h").agg(*(x for c in "to" for f in left for x in (F.sum(f"{c}_{f}").alias(f"all_{c}_{f}"), F.sum(F.least(F.col(f"{c}_{f}").cast("double"), most)).alias(f"taken_{c}_{f}"))))
    low = shared.select(F.col("g").alias("rest"), "p")
    rows = own.join(after, "h").join(low, F.substring("g", 2, ORDER) == F.col("rest"))

    def of(c: str, f: int) -> list[Column]:
        total, back = F.col(f"all_{c}_{f}"), F.coalesce(F.try_divide(F.col(f"taken_{c}_{f}"), F.col(f"all_{c}_{f}")), F.lit(1.0))
        seen = F.coalesce(F.try_divide(F.greatest(F.col(f"{c}_{f}") - most, F.lit(0.0)), total), F.lit(0.0))
        return [(seen + back * F.col("p")).alias(f"p{c}_{f}"), back.alias(f"l{c}_{f}")]

    return rows.select("g", "h", "p", *(x for c in "to" for f in left for x in of(c, f)))


# -- the model in a task ----------------------------------------------------------------------------------------


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each starts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat, np.cumsum([0, *map(len, texts)])[:-1]


def _hashes(flat: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """For each place, a hash of the up to ``most`` characters that end there; ``place`` counts from a text's start."""
    out, power = np.zeros(len(flat), np.uint64), np.uint64(1)
    code = flat.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for d in range(min(most, len(flat))):
            out[d:] += np.where(place[d:] >= d, code[: len(code) - d] * power, np.uint64(0))
            power *= _MIX
    return out


def _whole(texts: list[str]) -> np.ndarray:
    """The hash of each text as a whole (none empty, none longer than ``ORDER``)."""
    flat, starts = _codes(texts)
    sizes = np.diff(np.r_[starts, len(flat)])
    return _hashes(flat, np.arange(len(flat)) - np.repeat(starts, sizes), ORDER)[starts + sizes - 1] if len(texts) else np.zeros(0, np.uint64)


class _Table:
    """Hashes to rows of values; 0 for what is not there."""

    def __init__(self, texts: list[str], values: np.ndarray) -> None:
        key = _whole(texts)
        order = np.argsort(key)
        self.key, self.values = key[order], values[order].astype(np.float32)

    def look(self, h: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(h), np.float32), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        hit = self.key[at] == h
        return np.where(hit, self.values[at, column], np.float32(0)), hit


class Model:
    """Log-likelihood differences of words. Column 0 of the tables is the whole fit, column f the one without fold f."""

    def __init__(self, seen: _Table, back: _Table) -> None:
        self.seen, self.back = seen, back
        self.curve = np.zeros(3)
        self.known: dict[int, dict[str, float]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def compare(self, ws: list[str], column: int = 0) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        known = self.known.setdefault(column, {})
        if sum(map(len, self.known.values())) > CACHED_WORDS:
            for words_known in self.known.values():
                words_known.clear()
        if fresh := list(set(ws).difference(known)):
            flat, starts = _codes([f"{BEGIN}{w}{END}" for w in fresh])
            place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.r_[starts, len(flat)]))
            value, hit = self.seen.look(_hashes(flat, place, ORDER), column)
            context = np.r_[np.uint64(0), _hashes(flat, place, ORDER - 1)[:-1]]
            lost = np.flatnonzero(~hit)
            value[lost] = self.back.look(context[lost], column)[0]
            value[starts] = 0  # the beginning is given
            known.update(zip(fresh, np.add.reduceat(value, starts, dtype=np.float64).tolist()))
        return np.fromiter(map(known.__getitem__, ws), float, len(ws))

    def features(self, text: str | None, column: int = 0) -> tuple[float, float]:
        """Mean difference per word, and share of decisive words; 0 for a text without words."""
        ws = words(text)
        if not ws:
            return 0.0, 0.0
        v = self.compare(ws, column)
        return float(v.mean()), float((v > DECISIVE).mean())

    def score(self, text: str | None) -> float:
        z = float(self.curve @ (1.0, *self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge on scaled numbers, by Newton's method; weights of 1 and of the numbers."""
    mean, wide = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / wide])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + HOLD * np.eye(len(w)), z.T @ (y - p) - HOLD * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    own = w[1:] / wide
    return np.r_[w[0] - own @ mean, own]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """None without a labelled document with words of either class."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold("doc_id").cast("int")).where("fold <> 0")
    pick = lambda which: known.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    chosen = settle(pick("toxic > 0").union(pick("toxic <= 0")), "toxicity-rows")
    # at most 2 * FIT_DOCS rows of three numbers: small enough for every task
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labelled = settle(texts.join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), "fold"), "toxicity-texts")
    own = settle(class_counts(labelled), "toxicity-classes")
    t, o = own.agg(*(F.coalesce(F.sum(sum(F.col(f"{c}{k}") for k in range(1, FOLDS))), F.lit(0)) for c in "to")).first()
    if not t or not o:
        return None
    vocabulary = settle(distinct_words(texts.select("text")), "toxicity-words")
    counts = settle(continuation_counts(vocabulary, ORDER - 1), "toxicity-counts")
    models = settle(class_models(own, shared_model(counts, ORDER - 1)), "toxicity-models")
    ratio = lambda a, b: [F.log(F.col(f"{a}_{f}") / F.col(f"{b}_{f}")).cast("float").alias(f"r{f}") for f in range(FOLDS)]
    seen = models.select(F.col("g").alias("x"), *ratio("pt", "po")).toArrow()
    back = models.groupBy(F.col("h").alias("x")).agg(*(F.first(f"{c}_{f}").alias(f"{c}_{f}") for c in ("lt", "lo") for f in range(FOLDS))).select("x", *ratio("lt", "lo")).toArrow()
    table = lambda a: _Table(a["x"].to_pylist(), np.column_stack([a[f"r{f}"].to_numpy() for f in range(FOLDS)]))
    model = Model(table(seen), table(back))
    x = labelled.select("text", "toxic", "fold").mapInArrow(_features_of(model, docs), "y int, mean double, share double").toArrow()  # three numbers a labelled row
    model.curve = fit_curve(np.column_stack([x["mean"].to_numpy(), x["share"].to_numpy()]), x["y"].to_numpy().astype(float))
    for done in (labelled, chosen, own, vocabulary, counts, models):
        discard(spark, done)
    return model


def _features_of(model: Model, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shared.value.features(t, f) for t, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(2))], ["y", "mean", "share"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document.

    Labels count only from folds 1 to 4; text alone makes the score. Null and empty texts score as texts without
    evidence; repeated rows are scored each; a document labelled twice counts as toxic if one label says so; rows
    with null labels teach nothing. Without labelled rows of both classes every score is 0. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    model = train(docs, labels, id_col, text_col, label_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([shared.value.score(t) if shared.value else 0.0 for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
