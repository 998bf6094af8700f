"""Quality rules with robust multivariate outlier rejection, in DataFrame operations only.

Base statistics come from the whole text. A document that passes the base rules is then judged by the vector of
its transformed statistics: for each language and source, the minimum-covariance-determinant estimate of centre
and scatter is found by concentration steps, and a document is rejected where its squared Mahalanobis distance
is above ``CUT``.

The estimate starts from coordinate medians and median deviations. Each step takes the ``SUBSET`` share of a
group nearest to the current estimate and recomputes mean and covariance from it; the covariance's determinant
never grows. Shares are cut at bins of the logarithm of the distance, counted per group, so that nothing is
sorted, every row counts, and a hot group is only ever pre-aggregated. ``FLOORS`` are added to the variances
(most documents have no symbols or repeats at all, so that plain scatter would be singular).

Groups are alike at every size: the moments of a group are joined by those of its language with the weight of
``PRIOR`` documents, and a language's by those of all documents. So a small group is judged mostly by its language, and
a large one by itself.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, settle

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
FEATURES = ("x_word_length", "x_symbols", "x_lines", "x_repeats", "x_upper")
#: Standard deviations added (squared) to each feature's variance.
FLOORS = (0.25, 0.35, 0.35, 0.35, 0.15)
SUBSET = 0.75
STEPS = 6
#: Squared distance; five normal coordinates exceed it about once in 600 million documents.
CUT = 50.0
#: Scatter of the nearest 75 % of five normal coordinates is too small by this factor.
CONSISTENCY = 1.41
#: Documents that the moments of the language count for in a group, and those of all documents in a language.
PRIOR = 40
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight found twice or more."""
    n = F.size(words)

    def positions(hashes: Column) -> Column:
        def covered(order: Column) -> Column:
            same = lambda x, at: F.coalesce(F.get(order, at)["h"] == x["h"], F.lit(False))
            twice = F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)), F.lit(0).cast("long"), lambda s, x: s + x))

        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(order, covered))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, positions))


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the base statistics (long) and ``base_failed``; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = let(
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    long_length = lambda c: F.length(c).cast("long")
    stats = F.struct(
        counted.alias("c"), dup.alias("n_dup_lines"), long_length(F.translate(text, SPACE, "")).alias("word_chars"),
        (long_length(text) - long_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), (long_length(text) - long_length(F.translate(text, UPPER, ""))).alias("n_upper"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
    )
    s = F.col(f"{prefix}_stats")
    of = {"n_words": s["c"]["n_words"], "word_chars": s["word_chars"], "n_symbols": s["n_symbols"], "n_dup_lines": s["n_dup_lines"], "n_repeat_words": s["c"]["n_repeat_words"], "n_upper": s["n_upper"], "n_lines": s["n_lines"]}
    out = docs.withColumn(f"{prefix}_stats", stats)
    out = out.withColumns({prefix + k: v for k, v in of.items()}).drop(f"{prefix}_stats")
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.withColumn(f"{prefix}base_failed", (n < 20) | (100 * r > 30 * n))


def _features(p: str = "") -> list[Column]:
    """Length of words with a prior of twenty words of five letters, and logarithms of rates."""
    c = lambda k: F.col(p + k).cast("double")
    return [
        (c("word_chars") + 100) / (c("n_words") + 20),
        F.log1p(100 * c("n_symbols") / (c("n_words") + 20)),
        F.log1p(20 * c("n_dup_lines") / (c("n_lines") + 5)),
        F.log1p(20 * c("n_repeat_words") / (c("n_words") + 20)),
        F.log1p(20 * c("n_upper") / (c("word_chars") + 100)),
    ]


def _key(c: str) -> Column:
    """Group columns without nulls."""
    return F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))


def _bins_up_to(x: DataFrame, bin_col: Column, by: list[str], share: float) -> DataFrame:
    """Per group, the lowest bin at or below which at least ``share`` of its rows lie."""
    counts = x.groupBy(*by, bin_col.alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    upto = counts.withColumn("up", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return upto.where(F.col("up") >= F.col("all") * share).groupBy(*by).agg(F.min("bin").alias("cut"))


def _whitening(p: DataFrame) -> DataFrame:
    """From group means ``m*`` and covariances ``c*_*``: rows of the inverse Cholesky factor ``w*_*``."""
    d = len(FEATURES)
    for i in range(d):
        for j in range(i + 1):
            inner = F.col(f"c{i}_{j}") - reduce(add, (F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            p = p.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-9))) if i == j else inner / F.col(f"l{j}_{j}"))
    for j in range(d):
        for i in range(j, d):
            if i == j:
                p = p.withColumn(f"w{i}_{j}", 1 / F.col(f"l{i}_{i}"))
            else:
                s = reduce(add, (F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)))
                p = p.withColumn(f"w{i}_{j}", -s / F.col(f"l{i}_{i}"))
    return p.select("g", *(f"m{i}" for i in range(d)), *(f"w{i}_{j}" for i in range(d) for j in range(i + 1)))


def _distance(x: list[Column], prefix: str = "") -> Column:
    d = len(FEATURES)
    z = [reduce(add, (F.col(f"{prefix}w{i}_{j}") * (x[j] - F.col(f"{prefix}m{j}")) for j in range(i + 1))) for i in range(d)]
    return reduce(add, (v * v for v in z))


def _joined(groups: DataFrame, names: list[str]) -> DataFrame:
    """Means ``names`` of groups (k_lang, g, n) joined by those of their language, and these by those of all: each counts
    for ``PRIOR`` rows more. ``groups`` is written first: one row a group, and nothing of documents is counted twice. The
    sums over all groups are one row."""
    groups = settle(groups, "quality-means")
    total = [F.sum(F.col("n") * F.col(c)).alias(c) for c in names]
    every = groups.agg(F.sum("n").alias("n"), *total).first()
    mean = {c: (every[c] or 0.0) / (every["n"] or 1) for c in names}
    langs = groups.groupBy("k_lang").agg(F.sum("n").alias("n"), *total)
    langs = langs.select("k_lang", *(((F.col(c) + PRIOR * mean[c]) / (F.col("n") + PRIOR)).alias(f"{c}_lang") for c in names))
    return groups.join(langs, "k_lang").select("g", *(((F.col("n") * F.col(c) + PRIOR * F.col(f"{c}_lang")) / (F.col("n") + PRIOR)).alias(c) for c in names))


def fit(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """One row of estimates per language and source; ``stats`` is a settled table with statistics."""
    d = len(FEATURES)
    rows = stats.where(~F.col(f"{prefix}base_failed")).select(_key(lang_col).alias("k_lang"), _key(source_col).alias("k_source"), *(v.alias(k) for k, v in zip(FEATURES, _features(prefix))))
    x = settle(rows.select("k_lang", "k_source", F.to_json(F.struct("k_lang", "k_source")).alias("g"), *FEATURES), "quality-vectors")
    groups = settle(x.groupBy("k_lang", "k_source", "g").agg(F.count("*").alias("n")), "quality-groups")

    # start: coordinate medians, then median deviations, from bins of 1/256
    tall = lambda t, v: t.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v(i).alias("v")) for i in range(d)))).alias("e")).select("g", "e.i", "e.v")
    wide = lambda t, name: t.groupBy("g").agg(*(((F.max(F.when(F.col("i") == i, F.col("cut"))) + 0.5) / 256).alias(f"{name}{i}") for i in range(d)))
    sized = groups.select("k_lang", "g", "n")
    med = wide(_bins_up_to(tall(x, lambda i: F.col(FEATURES[i])), F.floor(F.col("v") * 256), ["g", "i"], 0.5), "m")
    centre = settle(_joined(sized.join(med, "g"), [f"m{i}" for i in range(d)]), "quality-medians")
    dev = wide(_bins_up_to(tall(x.join(centre, "g"), lambda i: F.abs(F.col(FEATURES[i]) - F.col(f"m{i}"))), F.floor(F.col("v") * 256), ["g", "i"], 0.5), "s")
    spread = settle(_joined(sized.join(dev, "g"), [f"s{i}" for i in range(d)]), "quality-deviations")
    start = centre.join(spread, "g")
    for i in range(d):
        for j in range(i + 1):
            start = start.withColumn(f"c{i}_{j}", 1.4826**2 * F.col(f"s{i}") * F.col(f"s{i}") + FLOORS[i] ** 2 if i == j else F.lit(0.0))
    estimate = settle(_whitening(start), "quality-start")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    for _ in range(STEPS):
        at = x.join(estimate, "g").select("k_lang", "g", *FEATURES, F.floor(F.log2(_distance([F.col(k) for k in FEATURES]) + 1e-6) * 32).alias("bin"))
        cut = settle(_bins_up_to(at, F.col("bin"), ["g"], SUBSET), "quality-cut")
        near = at.join(cut, "g").where("bin <= cut")
        moments = near.groupBy("k_lang", "g").agg(F.count("*").alias("n"), *(F.avg(k).alias(f"m{i}") for i, k in enumerate(FEATURES)), *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs))
        raw = moments.select("k_lang", "g", "n", *(f"m{i}" for i in range(d)), *((F.col(f"c{i}_{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}_{j}") for i, j in pairs))
        moments = settle(_joined(raw, [*(f"m{i}" for i in range(d)), *(f"c{i}_{j}" for i, j in pairs)]), "quality-moments")
        for i, j in pairs:
            moments = moments.withColumn(f"c{i}_{j}", CONSISTENCY * (F.col(f"c{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0))
        new = settle(_whitening(moments), "quality-estimate")
        discard(stats.sparkSession, estimate)
        discard(stats.sparkSession, cut)
        estimate = new
    out = settle(groups.join(estimate, "g").drop("g", "n"), "quality-model")
    for done in (x, groups, centre, estimate):
        discard(stats.sparkSession, done)
    return out


def judge(stats: DataFrame, model: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """Adds ``distance`` (squared; null without an estimate) and ``kept``."""
    keyed = stats.withColumns({f"{prefix}k_lang": _key(lang_col), f"{prefix}k_source": _key(source_col)})
    m = model.select(*(F.col(c).alias(prefix + c) for c in model.columns))
    own = [c for c in m.columns if not c.startswith(f"{prefix}k_")]
    out = keyed.join(m, [f"{prefix}k_lang", f"{prefix}k_source"], "left")
    out = out.withColumn(f"{prefix}distance", F.when(~F.col(f"{prefix}base_failed"), _distance(_features(prefix), prefix))).drop(*own, f"{prefix}k_lang", f"{prefix}k_source")
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.coalesce(F.col(f"{prefix}distance") <= CUT, F.lit(True)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: statistics, ``base_failed``, ``distance`` and ``kept``.

    Null and empty texts have no words and fail the base rules; null languages and sources are groups of their
    own; repeated rows are judged each; other columns are not looked at. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = settle(with_statistics(src).drop("text"), "quality-statistics")
    return judge(stats, fit(stats)).select("doc_id", *STATISTICS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns.

    Rows are written once with their statistics, and model and verdict read those: texts are not counted twice, nor
    shuffled. Null and empty texts go; repeated rows go or stay alike; other columns pass through whatever their names.
    """
    p = "_quality_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    counted = settle(with_statistics(docs, text_col, p), "quality-rows")
    judged = judge(counted, fit(counted, lang_col, source_col, p), lang_col, source_col, p)
    return judged.where(F.col(f"{p}kept")).select(docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance")
