"""Corpus preparation for span models: labels, deduplication, sampling, splits, token and span conversions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.columns import find_all, let, none_of

# Source labels and the entity types they stand for; None is outside.
LABELS = {
    "GIVENNAME": "NAME", "SURNAME": "NAME", "FIRSTNAME": "NAME", "MIDDLENAME": "NAME", "LASTNAME": "NAME", "USERNAME": "USERNAME", "NAME": "NAME", "ADDRESS": "ADDRESS", "STREET": "ADDRESS",
    "BUILDINGNUM": "ADDRESS", "BUILDINGNUMBER": "ADDRESS", "SECONDARYADDRESS": "ADDRESS", "CITY": "ADDRESS", "STATE": "ADDRESS", "COUNTY": "ADDRESS", "ZIPCODE": "ADDRESS", "EMAIL": None,
    "CREDITCARDNUMBER": None, "TELEPHONENUM": None, "SOCIALNUM": None, "DATEOFBIRTH": None, "PASSWORD": None, "ACCOUNTNUM": None, "DRIVERLICENSENUM": None, "IDCARDNUM": None, "TAXNUM": None,
    "COMPANYNAME": None, "JOBTITLE": None, "JOBAREA": None, "NEARBYGPSCOORDINATE": None,
}
BIO_LABELS = ("O", "B-NAME", "I-NAME", "B-ADDRESS", "I-ADDRESS", "B-USERNAME", "I-USERNAME")
#: Class of tokens that name a person, in token-class corpora.
PERSON = 7
MASK = "array<struct<start:int,end:int,label:string,value:string>>"
TRAINING_ROW = f"source_text string, language string, locale string, split string, privacy_mask {MASK}, uid long, masked_text string"


def map_label(label: Column) -> Column:
    """Entity type of a source label; null is outside."""
    return reduce(lambda acc, kv: acc.when(label == kv[0], F.lit(kv[1])), ((k, v) for k, v in LABELS.items() if v), F.when(F.lit(False), F.lit(None).cast("string")))


def entity_type(bio: Column) -> Column:
    return F.when(bio.rlike("^[BI]-"), F.substring(bio, 3, 1000))


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def normalise(rows: DataFrame) -> DataFrame:
    """The columns of a training row; other columns go, and language, locale and values have defaults.

    ``split`` and ``masked_text`` are placeholders, whatever was there. ``uid`` is null until :func:`with_uids`.
    """
    have = set(rows.columns)
    of = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
    mask = F.transform(F.coalesce(F.col("privacy_mask"), none_of(MASK[6:-1])), lambda m: F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), m["label"].alias("label"), F.coalesce(m["value"], F.lit("")).alias("value"))) if "privacy_mask" in have else none_of(MASK[6:-1])
    return rows.select(
        of("source_text", "").alias("source_text"), of("language", "en").alias("language"), of("locale", "US").alias("locale"), F.lit("train").alias("split"),
        mask.alias("privacy_mask"), F.lit(None).cast("long").alias("uid"), F.lit("").alias("masked_text"),
    )


def mask_key(mask: Column) -> Column:
    """The set of (start, end, label) as a sorted array."""
    return F.array_sort(F.array_distinct(F.transform(mask, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label")))))


def distinct_spans(mask: Column) -> Column:
    """Spans once each by (start, end, label), the first of them, in order of start."""
    first = F.filter(mask, lambda m, k: ~F.exists(F.slice(mask, F.lit(1), k), lambda x: (x["start"] == m["start"]) & (x["end"] == m["end"]) & x["label"].eqNullSafe(m["label"])))
    return F.array_sort(first, lambda a, b: a["start"] - b["start"])


def row_key(text: Column, mask: Column) -> Column:
    """One hash for the text and the set of its spans."""
    shown = F.transform(mask_key(mask), lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"), m["label"]))
    return F.sha2(F.concat(F.array_join(shown, ","), F.lit("|"), text), 256)


def deduplicate(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row (by ``order``, nulls last) of each key; no row needs an id.

    Whole rows are carried by a minimum per key that is pre-aggregated before the shuffle, so that a hot key is one
    row per task. Null keys are keys like any other.
    """
    key = F.sha2(F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))), 256)
    place = F.struct(*(x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"o{i}"))))
    first = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), place).alias("_row"))
    return first.select("_row.*")


def shuffle_rank(seed: int | str, *cols: str) -> Column:
    """A seeded pseudo-random order that every engine with MD5 can repeat."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def sample_rows(rows: DataFrame, n: int, seed: int | str, id_col: str) -> DataFrame:
    """``n`` rows without replacement: those of least hash."""
    return rows.orderBy(shuffle_rank(seed, id_col), id_col).limit(n)


def label_distribution(labels: DataFrame, col: str = "label") -> DataFrame:
    """Count and share of each label."""
    counts = labels.groupBy(col).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # over the labels' counts: as many rows as there are labels
    return counts.withColumn("share", F.col("n") / total)


def stratum(mask: Column) -> Column:
    """The set of entity types in a row, as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(mask, lambda m: map_label(m["label"])), lambda t: t.isNotNull()))), "+")


def ranks_within(rows: DataFrame, stratum_col: str, rank: Column, id_col: str) -> DataFrame:
    """Adds ``n`` and ``k`` (from 1, by ``rank``, then id) within each stratum, without a window over a whole stratum.

    ``rank`` is a hash in hexadecimal: its first three digits cut every stratum, however large, into 4096 stretches
    that keep the order. Places run inside each stretch, and the stretches' counts (one small row each) are added.
    """
    cut = rows.withColumn("_rank", rank).withColumn("_cut", F.substring("_rank", 1, 3))
    counts = cut.groupBy(stratum_col, "_cut").agg(F.count("*").alias("_n"))
    w = W.partitionBy(stratum_col)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(w)).drop("_n")
    inner = F.row_number().over(W.partitionBy(stratum_col, "_cut").orderBy("_rank", id_col))
    return cut.withColumn("_k", inner).join(before, [stratum_col, "_cut"]).withColumn("k", F.col("_k") + F.col("_before")).drop("_k", "_before", "_cut", "_rank")


def with_uids(rows: DataFrame, rank: Column, first: int = 0) -> DataFrame:
    """``uid`` from ``first`` on, in the order of ``rank`` (a hash in hexadecimal, unique but for rows that are the same)."""
    every = rows.drop("uid").withColumn("_all", F.lit("all")).withColumn("_rank_of", rank)
    return ranks_within(every, "_all", F.col("_rank_of"), "_rank_of").withColumn("uid", F.col("k") - 1 + first).drop("k", "n", "_all", "_rank_of")


def stratified_split(rows: DataFrame, stratum_col: str, id_col: str, seed: int = 42, train: float = 0.8, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds ``split``. A stratum too small to leave a test row goes to training as a whole."""
    if abs(train + validation + test - 1) > 1e-3:
        raise ValueError("fractions must sum to 1")
    r = ranks_within(rows, stratum_col, shuffle_rank(seed, id_col), id_col)
    n_train, n_val = F.greatest(F.lit(1), F.floor(F.col("n") * train)), F.greatest(F.lit(1), F.floor(F.col("n") * validation))
    split = F.when(F.col("n") - n_train - n_val < 1, "train").when(F.col("k") <= n_train, "train").when(F.col("k") <= n_train + n_val, "validation").otherwise("test")
    return r.withColumn("split", split).drop("n", "k")


def carve_test(rows: DataFrame, stratum_col: str, id_col: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``carved``: the first ``max(1, share)`` of each stratum."""
    r = ranks_within(rows, stratum_col, shuffle_rank(seed, id_col), id_col)
    return r.withColumn("carved", F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).drop("n", "k")


def tokens_to_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def tokens_to_spans(tokens: Column, tags: Column, wanted: int = PERSON, label: str = "NAME") -> Column:
    """Runs of one tag as character spans of the tokens joined by single blanks."""
    kind = "struct<start:int,end:int,label:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("on"), none_of(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end, hit = a["at"] + F.length(x["t"]), x["g"] == wanted
        one = lambda s: F.struct(s.alias("start"), end.alias("end"), F.lit(label).alias("label"))
        more = F.array_append(F.slice(a["out"], 1, F.size(a["out"]) - 1), one(F.element_at(a["out"], -1)["start"]))
        out = F.when(~hit, a["out"]).when(a["on"], more).otherwise(F.array_append(a["out"], one(a["at"])))
        return F.struct((end + 1).alias("at"), F.coalesce(hit, F.lit(False)).alias("on"), out.alias("out"))

    return F.aggregate(F.arrays_zip(tokens.alias("t"), tags.alias("g")), start, step, lambda a: a["out"])


def interleave(rows: DataFrame, class_col: str, id_col: str, seed: int = 42, first_uid: int = 2_000_000) -> DataFrame:
    """Positive and negative rows in turn, the rest after them; ``uid`` counts from ``first_uid`` in that order."""
    r = ranks_within(rows, class_col, shuffle_rank(seed, id_col), id_col)
    place = r.groupBy(class_col).agg(F.max("n").alias("other")).select((~F.col(class_col)).alias(class_col), "other")
    at = r.join(F.broadcast(place), class_col, "left").withColumn("other", F.coalesce("other", F.lit(0)))  # two rows
    second = (~F.col(class_col)).cast("int")
    uid = F.when(F.col("k") <= F.col("other"), 2 * (F.col("k") - 1) + second).otherwise(F.col("k") + F.col("other") - 1)
    return at.withColumn("uid", uid + first_uid).drop("n", "k", "other")


def bio_encode(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``tag`` to tokens (doc_id, pos, start, end) from spans (doc_id, start, end, type).

    A token wholly inside a span is inside its first one (by start, then end), ``B-`` where it begins it; tokens without
    width are null. Spans and tokens are laid in one line a document: one shuffle, no pairs. Spans that open no later
    than a token are behind it; of those that reach its end, the first is wanted. Where spans do not overlap, that is
    the last one behind it; where they do, those still open are kept in an array that holds overlapping spans only.
    """
    g = gold.select("doc_id", F.lit(None).cast("int").alias("pos"), "start", "end", F.col("type").alias("g_type"))
    line = tokens.select("doc_id", "pos", "start", "end", F.lit(None).cast("string").alias("g_type")).unionByName(g)
    # a run of spans that overlap one another is an island; a token can only be inside spans of the last island before it
    order = W.partitionBy("doc_id").orderBy("start", F.col("pos").isNotNull(), "end", "pos")
    span = F.col("g_type").isNotNull()
    reach = F.max(F.when(span, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    line = line.withColumn("_new", (span & F.coalesce(F.col("start") >= reach, F.lit(True))).cast("int"))
    line = line.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    inner = W.partitionBy("doc_id", "_island").orderBy("start", F.col("pos").isNotNull(), "end", "pos").rowsBetween(W.unboundedPreceding, 0)
    behind = F.collect_list(F.when(span, F.struct("start", "end", "g_type"))).over(inner)
    line = line.withColumn("_behind", behind).where(~span)
    first = F.get(F.filter("_behind", lambda x: x["end"] >= F.col("end")), F.lit(0))
    tag = F.when(F.col("start") == F.col("end"), F.lit(None)).when(first.isNull(), "O").otherwise(F.concat(F.when(F.col("start") == first["start"], "B-").otherwise("I-"), first["g_type"]))
    return line.select("doc_id", "pos", "start", "end", tag.alias("tag"))


def find_needles(text: Column, needle: Column | str) -> Column:
    """All occurrences of a literal as ``array<struct<s,e,cs,ce>>``."""
    java = F.lit(re.escape(needle)) if isinstance(needle, str) else F.concat(F.lit("\\Q"), needle, F.lit("\\E"))
    return let(java, lambda n: find_all(text, n))


def casing(text: Column, how: Column) -> Column:
    return F.when(how == "upper", F.upper(text)).when(how == "lower", F.lower(text)).otherwise(text)


#: Kinds of generated texts: name, weight (fixed values: results depend on the shares), case of the values, and texts. A slot
#: in braces becomes a value; NAME, ADDRESS and USERNAME are spans.
KINDS = (
    ("stack trace", 10, "as is", ("Traceback (most recent call last):\n  File \"/home/{USERNAME}/app/{WORD}.py\", line {NUM}, in {WORD}\nValueError: no account for {NAME}", "panic: {WORD} failed\n\tat /srv/{USERNAME}/{WORD}.go:{NUM}\nreported by {NAME} <{AT}>")),
    ("environment block", 8, "as is", ("APP_OWNER={NAME}\nAPP_USER={USERNAME}\nAPP_PORT={NUM}", "export DEPLOY_USER={USERNAME}\nexport REGION={WORD}-{NUM}\nexport BILLING_ADDRESS=\"{ADDRESS}\"")),
    ("access log", 10, "as is", ("{IP} - {USERNAME} [{AT}] \"GET /{WORD}/{NUM} HTTP/1.1\" 200 {NUM}", "{AT} {IP} login ok user={USERNAME} name=\"{NAME}\"")),
    ("change listing", 8, "as is", ("commit {HEX}\nAuthor: {NAME} <{USERNAME}@{WORD}.example>\nDate: {AT}\n\n    fix {WORD}", "--- a/{WORD}.py\n+++ b/{WORD}.py\n-# owner: {NAME}\n+# owner: {NAME}")),
    ("hard negatives", 16, "as is", ("The {WORD} service restarted after {NUM} seconds.", "Release {NUM}.{NUM} of {WORD} ships on {AT}.", "Build {HEX} passed in Austin mode; see Jordan rules.", "Set max_{WORD}={NUM} in the Lincoln profile.")),
    ("stack trace, capitals", 4, "upper", ("ERROR IN MODULE {WORD} LINE {NUM}\nOWNER: {NAME}",)),
    ("log, capitals", 4, "upper", ("{AT} WARN USER {USERNAME} LOCKED OUT", "{AT} INFO SHIPMENT FOR {NAME} TO {ADDRESS}")),
    ("environment, capitals", 3, "upper", ("OWNER={NAME}\nCONTACT={NAME}",)),
    ("small letters", 5, "lower", ("talked to {NAME} about {WORD} today", "{NAME} lives at {ADDRESS} now", "ask {USERNAME}, not {NAME}")),
    ("hard negatives, mixed case", 4, "as is", ("WARN {WORD} RETRY {NUM}", "deploying {WORD} to Stage-{NUM}")),
    ("structured log", 7, "as is", ("{{\"at\":\"{AT}\",\"user\":\"{USERNAME}\",\"name\":\"{NAME}\",\"ms\":{NUM}}}", "{{\"ship_to\":\"{ADDRESS}\",\"id\":{NUM}}}")),
    ("cluster event", 5, "as is", ("Normal Pulled pod/{WORD}-{HEX} by {USERNAME} at {AT}", "Warning BackOff pod/{WORD}-{NUM} owner={NAME}")),
    ("pipeline output", 5, "as is", ("[{AT}] step {NUM}/{NUM} started by {USERNAME}\n[{AT}] approved by {NAME}",)),
    ("query result", 4, "as is", (" id | name | address\n----+------+--------\n {NUM} | {NAME} | {ADDRESS}\n {NUM} | {NAME} | {ADDRESS}",)),
    ("chat message", 4, "as is", ("@{USERNAME} can you look at {WORD}? {NAME} is out", "{{\"text\":\"{NAME} joined #{WORD}\"}}")),
    ("code comment", 4, "as is", ("# TODO({USERNAME}): ask {NAME} about {WORD}", "// reviewed by {NAME}, see {WORD} #{NUM}")),
    ("container log", 4, "as is", ("{WORD}_1  | {AT} session opened for {USERNAME} from {IP}", "{WORD}_1  | mail queued for {NAME}")),
    ("plan output", 4, "as is", ("  + owner = \"{NAME}\"\n  + user  = \"{USERNAME}\"\n  + id    = \"{HEX}\"",)),
    ("cloud output", 4, "as is", ("{{\"UserName\": \"{USERNAME}\", \"Arn\": \"arn:{WORD}:{NUM}\"}}", "OWNER  {NAME}\nSINCE  {AT}")),
    ("code block", 10, "as is", ("def notify():\n    user = \"{USERNAME}\"\n    send(\"{NAME}\", \"{ADDRESS}\")\n    return {NUM}", "class {WORD}:\n    author = \"{NAME}\"\n    limit = {NUM}")),
    ("nothing of anyone", 10, "as is", ("for i in range({NUM}):\n    {WORD}(i)", "select {WORD} from {WORD} where id = {NUM}", "{AT} {WORD} {WORD} {NUM}")),
)
_ENTITY = ("NAME", "ADDRESS", "USERNAME")
_FIRST = ("Ana", "Ben", "Chloe", "Dev", "Elif", "Farid", "Greta", "Hugo")
_LAST = ("Ruiz", "Okafor", "Lindt", "Marsh", "Novak", "Sato", "Weber", "Yilmaz")
_STREET = ("Oak St", "Mill Lane", "High Road", "Station Ave", "Park Way", "Lake Drive")
_CITY = ("Leeds", "Lyon", "Ghent", "Porto", "Graz", "Turku")
_WORDS = ("billing", "cache", "export", "gateway", "index", "ledger", "queue", "worker")


def _slot(slot: str, seed: int, salt: str, case: str) -> Column:
    """The value of a slot, drawn by the row's id."""
    d = lambda what: draw(seed, f"{salt}{what}", "id")
    pick = lambda values, what: F.element_at(F.array(*map(F.lit, values)), (d(what) % len(values) + 1).cast("int"))
    if slot == "NAME":
        out = F.concat_ws(" ", pick(_FIRST, "first"), pick(_LAST, "last"))
    elif slot == "ADDRESS":
        out = F.concat(F.concat_ws(" ", (d("house") % 999 + 1).cast("string"), pick(_STREET, "street")), F.when(d("long") % 2 == 0, F.concat(F.lit(", "), pick(_CITY, "city"))).otherwise(F.lit("")))
    elif slot == "USERNAME":
        out = F.concat(F.lower(pick(_FIRST, "first")), F.lit("_"), (d("digits") % 9999).cast("string"))
    elif slot == "IP":
        return random_ip("id", seed)
    elif slot == "AT":
        return random_timestamp("id", seed)
    elif slot == "HEX":
        return F.substring(F.md5(F.concat_ws("-", F.lit(f"{seed}{salt}"), F.col("id").cast("string"))), 1, 12)
    elif slot == "NUM":
        return (d("number") % 1000).cast("string")
    else:
        return pick(_WORDS, "word")
    return casing(out, F.lit(case))


def _filled(text: str, seed: int, salt: str, case: str) -> Column:
    """``struct<text, mask>`` of one text with its slots filled, spans in order."""
    parts = [p for p in re.split(r"(\{[A-Z]+\}|\{\{|\}\})", text) if p]
    is_slot = lambda p: p.startswith("{") and p != "{{"
    values = F.array(*(_slot(p[1:-1], seed, f"{salt}-{k}-", case) if is_slot(p) else F.lit({"{{": "{", "}}": "}"}.get(p, p)) for k, p in enumerate(parts)))

    def spans(v: Column) -> Column:
        start = lambda k: F.length(F.array_join(F.slice(v, 1, k), ""))
        one = lambda k, p: F.struct(start(k).alias("start"), start(k + 1).alias("end"), F.lit(p[1:-1]).alias("label"), F.get(v, F.lit(k)).alias("value"))
        found = [one(k, p) for k, p in enumerate(parts) if is_slot(p) and p[1:-1] in _ENTITY]
        return F.struct(F.array_join(v, "").alias("text"), (F.array(*found) if found else none_of(MASK[6:-1])).cast(MASK).alias("mask"))

    return let(values, spans)


def generate(spark, n: int, seed: int = 42, first_uid: int = 1_000_000) -> DataFrame:
    """``n`` synthetic training rows: a kind by weight, one of its texts, and values in its slots, all drawn from hashes of
    the row's number that every engine with MD5 can repeat. Rows hold any number of spans and lines, or none."""
    place = draw(seed, "kind", "id") % sum(k[1] for k in KINDS)
    made, kind, upto = F.when(F.lit(False), _filled("", seed, "", "as is")), F.when(F.lit(False), F.lit("")), 0
    for number, (name, weight, case, texts) in enumerate(KINDS):
        upto += weight
        which = draw(seed, f"text{number}", "id") % len(texts)
        one = F.when(F.lit(False), _filled("", seed, "", "as is"))
        for k, t in enumerate(texts):
            one = one.when(which == k, _filled(t, seed, f"{number}-{k}", case))
        made, kind = made.when(place < upto, one), kind.when(place < upto, F.lit(name))
    rows = spark.range(n).select("id", kind.alias("kind"), made.alias("made"))
    return rows.select(F.col("made.text").alias("source_text"), F.lit("en").alias("language"), F.lit("US").alias("locale"), F.lit("train").alias("split"), distinct_spans(F.col("made.mask")).alias("privacy_mask"), (F.col("id") + first_uid).alias("uid"), F.lit("").alias("masked_text"), "kind")


def draw(seed: int, salt: str, id_col: str) -> Column:
    """A number below 2**32 from a hash that every engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(salt), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")


def random_ip(id_col: str, seed: int = 42) -> Column:
    p = lambda s, a, b: (draw(seed, s, id_col) % (b - a + 1) + a).cast("string")
    return F.concat_ws(".", F.lit("10"), p("b", 0, 255), p("c", 0, 255), p("d", 1, 254))


def random_timestamp(id_col: str, seed: int = 42) -> Column:
    """An instant of 2025 as ISO text in UTC."""
    seconds = draw(seed, "at", id_col) % (365 * 86_400)
    return F.date_format(F.timestamp_seconds(F.lit(1_735_689_600) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def balanced(rows: DataFrame, class_col: str, id_col: str, positives: int, negatives: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each class: those of least hash."""
    return sample_rows(rows.where(F.col(class_col)), positives, seed, id_col).unionByName(sample_rows(rows.where(~F.col(class_col)), negatives, seed, id_col))


def from_token_classes(rows: DataFrame, seed: int = 42, positives: int = 50_000, negatives: int = 100_000) -> DataFrame:
    """Training rows from (tokens, ner_tags): sampled by class, interleaved, with ``uid`` from 2,000,000."""
    text, spans_ = tokens_to_text(F.col("tokens")), tokens_to_spans(F.col("tokens"), F.col("ner_tags"))
    mask = F.transform("_s", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label"), F.substring(F.col("source_text"), m["start"] + 1, m["end"] - m["start"]).alias("value")))
    base = rows.select(text.alias("source_text"), spans_.alias("_s")).withColumn("_id", F.md5("source_text"))
    chosen = balanced(base.withColumn("_positive", F.size("_s") > 0), "_positive", "_id", positives, negatives, seed)
    return normalise(interleave(chosen, "_positive", "_id", seed).withColumn("privacy_mask", mask))


def prepare(*sources: DataFrame, seed: int = 42) -> DataFrame:
    """Union, normal form, deduplication by text and set of spans (of equal rows, one of the first source stays), hash
    order with new ``uid`` from 0 on, and stratified splits. No source needs a ``uid``."""
    rows = reduce(DataFrame.unionByName, (normalise(s).withColumn("_source", F.lit(k)) for k, s in enumerate(sources)))
    rows = rows.withColumn("_key", row_key(F.col("source_text"), F.col("privacy_mask")))
    kept = deduplicate(rows, [F.col("_key")], [F.col("_source"), F.col("language"), F.col("locale"), F.to_json("privacy_mask")]).drop("_source")
    ranked = with_uids(kept, F.md5(F.concat(F.lit(f"{seed}-"), F.col("_key")))).drop("_key")
    return stratified_split(ranked.drop("split").withColumn("_stratum", stratum(F.col("privacy_mask"))), "_stratum", "uid", seed).drop("_stratum").select(*(f.split()[0] for f in TRAINING_ROW.replace(MASK, "mask").split(", ")))
