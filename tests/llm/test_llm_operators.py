"""The training-data operators against brute force, round trips, planted cases and odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import duckdb
from lacuna.llm import chat, decontam, html, packing, pii, quality, sharding, simhash, toxicity, warc
from lacuna.llm.components import connected_components
from lacuna.llm.queries import oracle_sql, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone cloud lamp glass north ember field crow salt path maple iron dusk tide hollow bright quiet amber slate".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use themselves."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "a b c d e f", None, "a", 3), (4, long, "en", None, len(long)), (5, long, "en", "a", len(long)), (6, " \t\n", "en", "a", 3), (7, "é😀" * 3, "fr", "a", 6)]
    rows += [(k, prose(rng, 40), "en", "a", 0) for k in range(8, 60)]
    rows += [(rows[-1])] * 3
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("n_words", "m0", "w0_0", "g", "bin", "fp", "component_id", "shard", "slot", "kept", "toxic", "fold", "spans", "key", "pack_set", "length", "score", "k_lang", "_stats")})


def written(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


# -- whole queries against SQL -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# -- chat ------------------------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|says|>", ""]), st.text(alphabet="\\<|>/s[]INSTend turn\nés", max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat.compiled().render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    plain = text.replace(chat.TURN, "").replace(chat.SEP, "").replace(chat.END, "")
    assert text.count(chat.TURN) == text.count(chat.END) == len(turns)
    assert all(c not in t for t in (chat.compiled()._run and [plain]) for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_template_language_folds_and_is_sandboxed():
    t = chat.Template("{% if 1 + 1 == 2 %}a{{ 2 * 3 }}{% else %}b{% endif %}{# c #} {{- x.y | upper }}{% for i in [1, 2] %}{{ loop.index }}{{ ';' if not loop.last }}{% endfor %}")
    assert t.tree[0] == chat.Output(chat.Const("a6"))
    assert t.render(x={"y": "z"})[0] == "a6Z1;2"
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ x | nofilter }}", "{% if x %}", "{% for a b %}{% endfor %}", "{{ 'a' * 9 }}", "{% include x %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad).render(x={})
    assert chat.Template("{{ x.upper }}").render(x="s")[0] == ""
    for deep in ("{{ " + "(" * 5_000 + "1" + ")" * 5_000 + " }}", "{% if x %}" * 5_000 + "{% endif %}" * 5_000):
        with pytest.raises(chat.TemplateError):
            chat.Template(deep)


def test_chat_odd_tables(spark):
    rows = [(1, 2, "user", "c"), (1, 1, None, None), (None, 0, "user", "x"), (1, 2, "user", "c"), (2, None, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\nc\nuser\nc\n").hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"</s>").hexdigest() and got[2]["loss_chars"] == 4
    assert chat.format_conversations(df.limit(0)).count() == 0


# -- web archives ------------------------------------------------------------------------------------------------


def test_warc_segments_and_revisits(spark, tmp_path):
    rng = random.Random(2)
    big = "é" * 700 + prose(rng, 300)
    rows = [(3, "http://a", big), (1, "http://b c\r\nX: y", big), (2, None, None), (5, "u", "short"), (4, "u", "short"), (None, "n", big), (1, "again", big), (6, "crlf", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"), segment=100)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == 8 and all(r["complete"] for r in got)
    body = {r["record_id"].split(":")[2]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert body["1"] == big and body["2"] == "" and body["6"] == rows[-1][2] and body["4"] == body["5"] == "short"
    refers = [r["refers_to"].split(":")[2] for r in got if r["record_type"] == "revisit"]
    assert refers == ["1"] * 2 and all(r["said_bytes"] == len(big.encode()) for r in got if r["record_type"] == "revisit")
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_repeated_ids_as_in_sql(spark, tmp_path):
    """Rows that repeat the least id of a payload are responses, as in the query's SQL."""
    big = "word " * 60
    rows = [(2, "a", big), (1, "b", big), (1, "c", big), (3, None, big), (2, "d", big), (5, "e", "s"), (5, "e", "s")]
    (tmp_path / "t").mkdir()
    written(spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path / "t" / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/t/pages.parquet/*.parquet'")
    want = con.sql(warc.OP2_SQL)
    assert sorted(str(list(r)) for r in warc.op2(spark, str(tmp_path / "t")).select(*want.columns).collect()) == sorted(map(str, (list(r) for r in want.fetchall())))


def test_warc_incomplete_segments(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"x" * 50, 7)
    cut = [block[k : k + 20] for k in range(0, len(block), 20)]
    seg = lambda rid, n, b, total=None: (rid, "response" if n == 1 else "continuation", None, None, None, False, None, b and bytearray(b), n, None if n == 1 else rid.split("/")[0], total)
    rows = []
    for name, drop, extra, void in (("good", None, 0, None), ("gap", 1, 0, None), ("twice", None, 1, None), ("void", None, 0, 1)):
        for n, b in enumerate(cut, 1):
            if n - 1 != drop:
                rows += [seg(name if n == 1 else f"{name}/{n}", n, None if n - 1 == void else b, len(block) if n == len(cut) else None)] * (1 + (extra and n == 2))
    parts = spark.createDataFrame(rows, warc._ddl(warc._PART)).repartition(3)
    got = {r["record_id"]: r for r in warc.reassembled(parts).collect()}
    assert {k: r["complete"] for k, r in got.items()} == {"good": True, "gap": False, "twice": False, "void": False}
    assert bytes(got["good"]["payload"]) == b"x" * 50
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc" and warc.unchunked(b"5\r\nab") is None


def test_warc_bad_records_are_incomplete_rows(spark, tmp_path):
    import gzip

    good = [b + b"\r\n\r\n" for k in range(3) for b in warc.response_records(f"<urn:page:{k}:0>", "u", b"payload %d" % k, "d")]
    wrong = good[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    data = b"noise\r\n\r\n" + good[0] + wrong + good[2].replace(b"Content-Length", b"Content-Length: x\r\nOther", 1) + good[2] + good[0][:-30]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.gz").write_bytes(gzip.compress(data))
    (tmp_path / "w" / "b.gz").write_bytes(gzip.compress(b"".join(good))[:-20])
    (tmp_path / "w" / "c.gz").write_bytes(gzip.compress(good[0]) + gzip.compress(good[1]))
    (tmp_path / "w" / "d.gz").write_bytes(b"\x1f\x8bnot what it says")
    assert [b is not None for _, b in warc.parse_records(data)] == [True, False, False, True, False]
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sum(r["complete"] for r in got) >= 2 + 2 and all(r["payload"] is None for r in got if not r["complete"])
    assert Counter(bytes(r["payload"]) for r in got if r["complete"])[b"payload 0"] >= 2


# -- sharding ------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(8, 300), max_size=40), st.integers(1, 7), st.integers(2, 6))
@settings(max_examples=150, deadline=None)
def test_minimax_is_exact_on_any_cells(sizes, shards, cells):
    starts = [0, *itertools.accumulate(sizes)]

    def grouped(rows, cell):
        found = {}
        for i in rows:
            found.setdefault(cell(starts[i]), []).append(i)
        return [(starts[v[0]], starts[v[-1] + 1], len(v), starts[v[0] + 1], starts[v[-1]]) for v in found.values()]

    def look(spans):
        if spans is None:
            return grouped(range(len(sizes)), lambda s: s // (starts[-2] // cells + 1)) if sizes else []
        return [r for a, b in spans for r in grouped([i for i in range(len(sizes)) if a <= starts[i] <= b], lambda s, a=a, b=b: (s - a) // ((b - a) // cells + 1))]

    def feasible(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            used, at = (used + 1, s) if at + s > c else (used, at + s)
        return used <= shards

    capacity, cuts = sharding.minimax_cuts(look, shards)
    assert capacity == (min(c for c in range(starts[-1] + 1) if feasible(c)) if sizes else 0)
    ends = [0, *cuts, starts[-1]]
    assert len(cuts) == shards - 1 and all(c in starts for c in cuts) and all(0 <= b - a <= capacity for a, b in zip(ends, ends[1:]))


def test_shards_of_odd_tables(spark, odd):
    rows = sharding.shard(odd, shards=5, cells=8).collect()
    texts = Counter((r["text"],) for r in odd.collect())
    assert len(rows) == sum(texts.values())
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    null = next(r for r in rows if r["doc_id"] == 1)
    assert null["size"] == 8 and null["text_crc32"] == 0
    assert sharding.shard(odd.limit(0)).count() == 0


# -- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out_and_odd(spark, odd):
    rng = random.Random(3)
    rude = ["snarl", "grot", "blech"]
    rows, labels = [], []
    for k in range(900):
        toxic = int(k % 6 == 0)
        ws = prose(rng, 60).split()
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(rude))
        rows.append((1000 + k, " ".join(ws), "en", "a", 0))
        labels.append((1000 + k, toxic))
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    lab = spark.createDataFrame([*labels, (4, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows) + odd.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    none = toxicity.toxicity(docs.limit(3), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0


def brute_kneser_ney(texts: dict[int, str], toxic: dict[int, int]):
    """Both classes' probabilities of a character after a context, from the formulas, and the differences of words."""
    order, d, ds = toxicity.ORDER, toxicity.DISCOUNT, toxicity.SHARED_DISCOUNT
    kinds = {w for t in texts.values() for w in toxicity.words(t)}
    shared: Counter = Counter()
    for w in kinds:
        for g in toxicity.grams(w, order - 1):
            shared.update(g[k:] for k in range(len(g)))
    follow: dict[str, dict[str, int]] = {}
    for g, n in shared.items():
        follow.setdefault(g[:-1], {})[g[-1]] = n

    def low(h: str, x: str) -> float:
        seen = follow.get(h)
        rest = low(h[1:], x) if h else 1 / (len(seen) + 1)
        return rest if not seen else max(seen.get(x, 0) - ds, 0) / sum(seen.values()) + ds * len(seen) / sum(seen.values()) * rest

    own: dict[int, dict[str, Counter]] = {0: {}, 1: {}}
    for k, y in toxic.items():
        for w in set(toxicity.words(texts[k])):
            for g in toxicity.grams(w, order):
                own[y].setdefault(g[:-1], Counter())[g[-1]] += 1

    def high(y: int, h: str, x: str) -> float:
        seen, rest = own[y].get(h), low(h[1:], x)
        return rest if not seen else max(seen[x] - d, 0) / sum(seen.values()) + sum(min(n, d) for n in seen.values()) / sum(seen.values()) * rest

    def compare(w: str) -> float:
        return sum(float(np.log(high(1, g[:-1], g[-1]) / high(0, g[:-1], g[-1]))) for g in toxicity.grams(w, order))

    return high, compare, {g[-1] for g in shared}, sorted({h for y in (0, 1) for h in own[y]})


def test_toxicity_models_against_brute_force(spark):
    """Every context's probabilities sum to 1, and the model's differences of words, seen or not, are those of the formulas."""
    rng = random.Random(11)
    stems = ["gro", "ble", "tar", "mon", "sil", "ka", "é"]
    texts = {k: " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(12)) + (" grobled tarmonk" * (k % 4 == 0)) for k in range(140)}
    labels = {k: int(k % 4 == 0) for k in texts if k % 7}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    ask = sorted({w for t in texts.values() for w in toxicity.words(t)})[:40] + ["grobledgro", "kakakaka", "éé", "zzz", "grozz"]
    for left in (0, 2):
        fit = {k: y for k, y in labels.items() if fold(k) not in (0, left)}
        high, compare, alphabet, contexts = brute_kneser_ney(texts, fit)
        for h in rng.sample(contexts, 60):
            for y in (0, 1):
                unseen = high(y, h, "\x00")
                assert abs(sum(high(y, h, x) for x in alphabet) + unseen - 1) < 1e-9 and unseen > 0
        assert np.allclose(model.compare(ask, left), [compare(w) for w in ask], atol=2e-4)
    text = texts[4]
    v = model.compare(toxicity.words(text))
    assert np.allclose(model.features(text), (v.mean(), (v > toxicity.DECISIVE).mean())) and model.features(None) == (0.0, 0.0)


# -- quality -----------------------------------------------------------------------------------------------------------


def brute_statistics(text: str | None) -> tuple[int, ...]:
    t = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    ws, seen, dup = word.findall(t), set(), 0
    for line in t.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    repeat = {j for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat)


def test_quality_statistics_and_outliers(spark, odd):
    rng = random.Random(4)
    rows = [(5000 + k, prose(rng, rng.randint(40, 400)), "en", "hot", 0) for k in range(400)]
    rows += [(1000 + k, " ### ".join(prose(rng, 60).split()), "en", "hot", 0) for k in range(12)]
    rows += [(2000, "a b c d e f g h i " * 3, "en", "hot", 0), (2001, "x\n\nx\ny\nx", "en", "b", 0), (2002, prose(rng, 9) + "\n" + prose(rng, 30), "de", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = quality.quality(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = brute_statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.STATISTICS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["kept"] or not r["base_failed"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[1000 + k] for k in range(12)) and sum(kept[5000 + k] for k in range(400)) >= 399
    good = quality.keep_good(odd)
    assert good.columns == odd.columns and {r["doc_id"] for r in good.collect()} >= {4, 5}
    assert quality.quality(odd.limit(0)).count() == 0


def test_concentration_steps_match_numpy(spark):
    """The estimates of groups of many rows and few, repeated in numpy from the same vectors."""
    rng = random.Random(8)
    place = lambda k: ("en", "a") if k < 200 else ("en", "b") if k < 207 else ("en", "c") if k < 208 else ("de", "a")
    rows = [(k, prose(rng, rng.randint(30, 200)) + (" #" * rng.randint(0, 30) if k % 9 == 0 else ""), *place(k), 0) for k in range(300)]
    stats = quality.settle(quality.with_statistics(spark.createDataFrame(rows, DOCS)).drop("text"), "t")
    model = {(r["k_lang"], r["k_source"]): r for r in quality.fit(stats).collect()}
    vectors = {}
    for r in stats.where("not base_failed").select("lang", "source", *quality._features()).collect():
        vectors.setdefault((r[0], r[1]), []).append(list(r)[2:])
    vectors = {g: np.array(v) for g, v in vectors.items()}
    assert len(vectors) == len(model) == 4 and len(vectors["en", "c"]) == 1

    def joined(of, sizes):
        langs = {}
        for (lang, _), v in of.items():
            langs.setdefault(lang, []).append(v)
        n_of = {lang: sum(sizes[g] for g in of if g[0] == lang) for lang in langs}
        total = {lang: sum(sizes[g] * of[g] for g in of if g[0] == lang) for lang in langs}
        every = sum(total.values()) / sum(n_of.values())
        own = {lang: (total[lang] + quality.PRIOR * every) / (n_of[lang] + quality.PRIOR) for lang in langs}
        return {g: (sizes[g] * of[g] + quality.PRIOR * own[g[0]]) / (sizes[g] + quality.PRIOR) for g in of}

    middle = lambda v: (np.sort(np.floor(v * 256), axis=0)[int(np.ceil(len(v) * 0.5)) - 1] + 0.5) / 256
    sizes = {g: len(v) for g, v in vectors.items()}
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    m = joined({g: middle(v) for g, v in vectors.items()}, sizes)
    mad = joined({g: middle(np.abs(v - m[g])) for g, v in vectors.items()}, sizes)
    c = {g: np.diag((1.4826 * mad[g]) ** 2) + floors for g in vectors}
    for _ in range(quality.STEPS):
        near = {}
        for g, v in vectors.items():
            b = np.floor(np.log2(np.einsum("ij,jk,ik->i", v - m[g], np.linalg.inv(c[g]), v - m[g]) + 1e-6) * 32)
            near[g] = v[b <= sorted(b)[int(np.ceil(len(v) * quality.SUBSET)) - 1]]
        sizes = {g: len(v) for g, v in near.items()}
        m = joined({g: v.mean(axis=0) for g, v in near.items()}, sizes)
        second = joined({g: v.T @ v / len(v) for g, v in near.items()}, sizes)
        c = {g: quality.CONSISTENCY * (second[g] - np.outer(m[g], m[g])) + floors for g in vectors}
    for g, r in model.items():
        assert np.allclose([r[f"m{i}"] for i in range(5)], m[g], atol=1e-6)
        w = np.linalg.inv(np.linalg.cholesky(c[g]))
        assert np.allclose([[r[f"w{i}_{j}"] if j <= i else 0 for j in range(5)] for i in range(5)], w, atol=1e-5)


# -- html -----------------------------------------------------------------------------------------------------------------


def test_html_unseen_layouts():
    rng, field, exact = random.Random(1234), html.trained(), 0
    for _ in range(150):
        page, keep = html.labelled_page(rng)
        exact += html.main_text(page, field) == " ".join(" ".join(t.split()) for t in keep)
    assert exact >= 135


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(0)
    f = html.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 7):
        x = rng.normal(size=(n, 3))
        s = x @ f.node
        score = lambda y: f.first[y[0]] + sum(s[k, y[k]] for k in range(len(y))) + sum(f.step[a, b] for a, b in zip(y, y[1:]))
        assert tuple(f.viterbi(x)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_html_blocks_and_odd_pages(spark):
    src = "<body><p>a<b>b</b> c&nbsp;d &amp &lt;x&gt;<br>e<p>f<script>var x='</p>'</script>g<ul><li>h<li>i</ul><!-- z --><style>q</style>5 < 6<div hidden>no"
    assert [b.text for b in html.blocks(src)] == ["ab c d & <x> e", "fg", "h", "i", "5 < 6", "no"]
    loose = {
        "<p class=it's>a</p><p title='x > y' data-x=\"1>2\">b</p><p \"q>c": ["a", "b", "c"],
        "<div><button>go</div><p>a<p>b": ["a", "b"], "<button>go<p>a</p><p>b</p>": ["a", "b"], "<form><select><option>x<option>y</form><p>a": ["a"],
        "<p>a <button>go</button> b</p><button>x<button>y</button><p>c</p>": ["a b", "c"], "<p>a<select><option>x</select>b</p>": ["ab"], "<svg><p>x</p></svg><p>a": ["a"],
    }
    for source, want in loose.items():
        assert [b.text for b in html.blocks(source)] == want, source
    assert html.features(html.blocks("<p>" + "word " * 500 + "2024</p>"))[0].tolist() != html.features(html.blocks("<p>" + "word " * 501 + "</p>"))[0].tolist()
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some main text stands here, long enough to be read.</p></article>"), (4, "u", "<" * 2000), (5, "u", "<p" + " a='" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["text"] == "" and got[2]["n_chars"] == 0 and got[None]["text"].startswith("Some main text") and len(got) == 5
    assert html.extract(df.limit(0)).count() == 0


# -- near-duplicates --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text: str | None) -> int:
    t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    up = {k: k for k in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


@given(st.text(alphabet="aAbB \t\n\x0b\x85é", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [simhash.HOT_KEY, 40])
def test_links_find_all_components(spark, monkeypatch, hot):
    """Clusters by bit flips (chains included), random ones, and one dense group, also where every key is hot."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = random.Random(6)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a, b in ((rng.randrange(64), rng.randrange(64)) for _ in range(150))}
    byid = dict(enumerate(sorted(fps, key=lambda f: xxhash.xxh64_intdigest(str(f)))))
    reps = spark.createDataFrame([(simhash.signed(f), i) for i, f in byid.items()], "fp long, id long")
    links = simhash.fingerprint_links(reps)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = brute_components(byid)
    assert {k: got.get(k, k) for k in byid} == want
    assert links.count() < 20 * len(byid)


def test_near_duplicates_odd_tables(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    fps = {k: brute_fingerprint(t) for k, t in ((r["doc_id"], r["text"]) for r in odd.collect()) if k is not None}
    want = brute_components(fps)
    assert all(by[k]["component_id"] == want[k] for k in fps)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# -- packing ---------------------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_places_each_piece_best(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, np.int64), 30)
    level: dict[int, int] = {}
    for s, b, at in zip(sizes, bins.tolist(), offsets.tolist()):
        open_gaps = Counter(30 - v for v in level.values() if v < 30)

        def cost(g):
            after = Counter(open_gaps)
            if g < 30:
                after[g] -= 1
            if g > s:
                after[g - s] += 1
            return sum(v * v for v in after.values())

        g = 30 - level.get(b, 0)
        assert at == level.get(b, 0) and g >= s
        assert cost(g) == min(cost(x) for x in {30, *(x for x in open_gaps if x >= s)})
        level[b] = level.get(b, 0) + s


def test_packing_is_whole(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(packing.settle(packing.pieces(odd, packing.default_tokenizer()), "p"), set_pieces=16).collect()
    want = Counter()
    for r in odd.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs: dict[int, list] = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(odd.limit(0)).count() == 0


@given(st.text(alphabet="aAbBéÉßẞİΣσς'’.,;!?\t\n\r\x0b\x1c\x85 0²½日ｶ\u0301-_😀", max_size=25))
@settings(max_examples=300, deadline=None)
def test_word_encoder_is_exact(text):
    e = packing.encoder(packing.default_tokenizer())
    assert next(e.encode([text])) == np.array(e.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# -- personal data ------------------------------------------------------------------------------------------------------------------


def brute_base(t: str) -> list[tuple[int, int, int]]:
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@given(st.text(alphabet="ab.@-+() 0123456789é_%", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_field_adds_repeated_mentions_and_leaves_clean_texts_alone():
    text = "Card 4111 1111 1111 1111 was charged. Later 4111.1111.1111.1111 was refused; order 20240501 v1.2.3 costs 12.50 on 2024-05-01 at 10:30."
    base, every = pii.find([text, "", "No digits here"], pii.trained())[0]
    assert [text[a:b] for a, b, _ in base] == ["4111 1111 1111 1111"]
    assert [text[a:b] for a, b, _ in every] == ["4111 1111 1111 1111", "4111.1111.1111.1111"]
    assert pii.masked(text, every).startswith("Card [CARD] was charged. Later [CARD] was refused; order 20240501")
    clean = [f"item {k} of {k * 37} at {k}.{k % 10} on 19{k % 90 + 10}-0{k % 9 + 1}-1{k % 9}" for k in range(200)]
    assert all(not s for _, s in pii.find(clean, pii.trained()))


def _scored(field, docs):
    """Precision and recall of the added spans: of the things told, those that no base span touches."""
    right = wrong = missed = 0
    for (_, truth), (base, every) in zip(docs, pii.find([t for t, _ in docs], field)):
        added = [s for s in every if s not in base]
        hits = lambda s, of: any(s[0] < x[1] and x[0] < s[1] and s[2] == x[2] for x in of)
        right += sum(hits(s, truth) for s in added)
        wrong += sum(not hits(s, truth) for s in added)
        missed += sum(not hits(w, added) for w in truth if not any(w[0] < x[1] and x[0] < w[1] for x in base))
    return right / max(1, right + wrong), right / (right + missed)


def test_skip_edges_find_mentions_that_nothing_else_finds():
    """On unseen documents; without skip potentials, or without any, most mentions are lost."""
    rng = random.Random(99)
    docs = [pii.labelled_document(rng) for _ in range(400)]
    field = pii.trained()
    without = pii.SkipChain(field.node, *field.pairs[:2], np.zeros((5, 5)))
    alone = pii.SkipChain(field.node, *(np.zeros((5, 5)) for _ in range(3)))
    precision, recall = _scored(field, docs)
    assert precision >= 0.97 and recall >= 0.8
    assert _scored(without, docs)[1] < recall - 0.3 and _scored(alone, docs)[1] < recall - 0.3
    text = "Reach me at +14155550198 any time. There were 12 of us, and many words in between. So try 415-555-0198 later."
    spans = lambda f: [text[a:b] for a, b, _ in pii.find([text], f)[0][1]]
    assert spans(field) == ["+14155550198", "415-555-0198"] and spans(without) == ["+14155550198"]


def test_graphs_are_cut_between_texts(monkeypatch):
    rng = random.Random(5)
    texts = [pii.labelled_document(rng)[0] for _ in range(40)] + ["", "no number"]
    whole = pii.find(texts, pii.trained())
    monkeypatch.setattr(pii, "GRAPH_TOKENS", 30)
    assert pii.find(texts, pii.trained()) == whole and pii.find([], pii.trained()) == []


def test_loopy_messages_are_exact_on_trees():
    rng = np.random.default_rng(1)
    f = pii.SkipChain(rng.normal(size=(3, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    x = rng.normal(size=(5, 3))
    edges = [(0, 1, pii.BESIDE), (1, 2, pii.SKIP), (1, 3, pii.SKIP), (3, 4, pii.APART)]
    p = np.zeros((5, 5))
    s = x @ f.node
    for y in itertools.product(range(5), repeat=5):
        w = np.exp(sum(s[k, y[k]] for k in range(5)) + sum(f.pairs[k][y[a], y[b]] for a, b, k in edges))
        for k in range(5):
            p[k, y[k]] += w
    assert np.allclose(f.marginals(x, np.full(5, -1), edges), p / p.sum(axis=1, keepdims=True), atol=1e-6)
    twice = f.marginals(np.r_[x, x], np.full(10, -1), [*edges, *((a + 5, b + 5, k) for a, b, k in edges)], np.repeat([0, 1], 5))
    assert np.allclose(twice, np.tile(p / p.sum(axis=1, keepdims=True), (2, 1)), atol=1e-6)


def test_thirty_mentions_share_what_one_of_them_shows():
    """However far apart, and without evidence of their own; messages pass until they settle."""
    text = "seen 192.168.100.101 here " + "\n".join(f"and word {k % 7} then 192-168-100-101 again" for k in range(30))
    toks = pii.tokens(text)
    at = [k for k, (a, b) in enumerate(toks) if pii.shared_form(text[a:b])]
    assert len(at) == 31
    field, seen = pii.trained(), np.full(len(toks), -1)
    seen[at[0]] = 2
    edges = [e for e in pii.graph(text, toks, pii.base_spans(text)) if e[2] == pii.SKIP]
    p = field.marginals(np.zeros((len(toks), field.node.shape[0])), seen, edges)
    assert p[at[1], 2] > 0.5 and np.allclose(p[at[1:], 2], p[at[1], 2], atol=1e-4)
    card = "card 378282246310005 here " + " ".join("and then 3782_822463_10005 again" for _ in range(30))
    assert len(pii.find([card], field)[0][1]) == 31
    line = [(k, k + 1, pii.SKIP) for k in range(29)]  # a long line of edges: exact only once settled
    strong = pii.SkipChain(field.node, *field.pairs[:2], np.eye(5) * 6)
    seen = np.full(30, -1)
    seen[0] = 2
    far = strong.marginals(np.zeros((30, field.node.shape[0])), seen, line)[29, 2]
    same, e = np.exp(6.0), 29
    gain = ((same - 1) / (same + 4)) ** e
    assert np.isclose(far, 0.2 + 0.8 * gain, atol=1e-4)


def test_personal_data_odd_tables(spark, odd):
    more = spark.createDataFrame([(70, "x@y.zz é +49 170 1234567", "en", "a", 0), (71, "9" * 50_000 + "@" + "a." * 20_000, "en", "a", 0)], DOCS)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[70]["spans"] == "email:0:6,phone:9:24" and got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r for r in pii.mask_personal_data(docs).collect()}
    assert masked[70]["text"] == "[EMAIL] é [PHONE]" and masked[70]["n_chars"] == 17 and masked[1]["text"] is None
    assert pii.mask_personal_data(docs.limit(0)).count() == 0


# -- decontamination -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", range(1, 21))
def test_masks_hit_every_pattern_of_substitutions(length):
    masks = decontam.masks_of(length)
    assert length < 3 or all(m != tuple(range(len(m))) for m in masks)
    for gone in itertools.combinations(range(length), length // 5):
        assert any(decontam._covers(m, length, gone) for m in masks)


def test_contaminations_against_brute_force(spark, odd):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([3, 5, 7, 11, 14, 15, 20, 33, 60])] + [(90, None), (91, ""), (92, "quokka"), (93, "quokka wombat")]
    rows, want = [], set()
    for k, (i, t) in enumerate(items[:9]):
        ws = t.split()
        for subs in range(0, 4):
            x = list(ws)
            for at in rng.sample(range(len(x)), min(len(x), subs)):
                x[at] = "zzz"
            body = [*prose(rng, 10).split(), *x, *prose(rng, 10).split()]
            rows.append((100 * k + subs, " ".join(body).upper() + "!", "en", "a", 0))
            w = min(len(ws), 20)
            best = max(sum(a == b for a, b in zip(x[j : j + w], ws[j : j + w])) for j in range(len(ws) - w + 1))
            if best >= 0.8 * w:
                want.add((100 * k + subs, i))
    rows += [(5000, "a Quokka, and a wombat", "en", "a", 0), (5001, "one quokka wombat", "en", "a", 0)]
    want |= {(5000, 92), (5001, 92), (5001, 93)}
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 1000 or doc_id is null"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs, bench).collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want} | {None}
    assert decontam.contaminations(docs, bench.limit(0)).count() == 0 and decontam.contaminations(docs.limit(0), bench).count() == 0
    small = decontam.blocks(bench, most=30)
    assert sum(len(b.ids) for b in small) == 12
    decontam.blocks.__defaults__, before = ("item_id", "text", 30), decontam.blocks.__defaults__
    try:  # several blocks give the same rows
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs, bench).collect()} == want
        assert Counter(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == Counter(r[0] for r in rows if r[0] not in {d for d, _ in want}) + Counter([None])
    finally:
        decontam.blocks.__defaults__ = before


def test_near_copies_are_all_pairs_of_similarity(spark, tmp_path):
    """Edited copies by up to a fifth of their shingles, chains of edits, and pairs just below, against all pairs."""
    import corpus_pipeline as cp

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    rng = random.Random(17)
    texts = []
    for _ in range(60):
        w = prose(rng, rng.choice([24, 60, 150, 400])).split()
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(["mole", "newt", "otter"])
    base = prose(rng, 300).split()
    texts += [" ".join([*base[:k], "heron", *base[k + 1 :]]) for k in range(0, 300, 2)]  # one large group
    sets = dict(enumerate(map(shingles, texts)))
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    far = 0
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
            far += (simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() > 4
    assert far > 20  # near copies that op7's radius does not reach
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    kept = cp.near_duplicate_stage(spark, written(docs, tmp_path / "copies"), SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({root(k) for k in sets})


# -- pipeline ----------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, odd):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in cp.STAGES] == ["quality", "near-duplicates", "decontamination", "personal-data", "packing"]
    final = cp.run(spark, SF).collect()
    step = docs
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = written(stage(spark, step, SF), tmp_path / name)
        assert out.columns == docs.columns and out.count() <= step.count()
        step = out
    assert {r["doc_id"] for r in final} == {r["doc_id"] for r in step.collect()} and 0 < step.count() < docs.count()
    hit = {r["doc_id"] for r in decontam.contaminations(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not hit & {r["doc_id"] for r in step.collect()}
    assert all(r["spans"] == "" for r in pii.personal_data(step).collect() if r["doc_id"] % 3 == 0)
    strange = written(odd, tmp_path / "odd")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, strange, SF)
        assert out.columns == strange.columns and out.count() <= strange.count()
        assert stage(spark, strange.limit(0), SF).count() == 0
    alone = cp.near_duplicate_stage(spark, strange, SF).collect()
    assert Counter(r["doc_id"] for r in alone)[2] == 0 and Counter(r["doc_id"] for r in alone)[1] == 1  # texts without words: one stays
    assert {r["doc_id"] for r in alone} & {4, 5} == {4}
