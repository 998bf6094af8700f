"""Every query against SQL on the smallest tables; queries without SQL against brute force."""

from __future__ import annotations

import math
from collections import Counter

import pytest

import duckdb
from lacuna.plans.oracle import oracle_sql
from lacuna.plans.queries import _cases, queries, texts, tokens

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_gives_the_same_rows(spark, con, name):
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(tuple(r[c] for c in want.columns) for r in got.collect()) == shown(want.fetchall())


def test_the_rest_has_no_sql():
    assert set(queries()) - set(oracle_sql()) == {"nms_by_score", "generate_rows", "entity_stage"}


def _greedy(expected, predicted):
    taken, out = set(), []
    for e in expected:
        hit = next((k for k, p in enumerate(predicted) if k not in taken and e["start"] < p["end"] and p["start"] < e["end"] and e["type"] == p["type"]), -1)
        taken.add(hit)
        out.append(hit)
    return out


def test_greedy_matching_and_metrics(spark):
    cases = _cases(spark, SF).collect()
    want = Counter((c["doc_id"], k, m) for c in cases for k, m in enumerate(_greedy(c["expected"], c["predicted"])))
    assert Counter(tuple(r) for r in queries()["match_spans"](spark, SF).collect()) == want
    tp = sum(m >= 0 for _, _, m in want.elements())
    n_e, n_p = sum(len(c["expected"]) for c in cases), sum(len(c["predicted"]) for c in cases)
    total = next(r for r in queries()["prf_metrics"](spark, SF).collect() if r["type"] is None)
    assert (total["tp"], total["n_expected"], total["n_predicted"]) == (tp, n_e, n_p)
    p, r = tp / n_p, tp / n_e
    assert math.isclose(total["f1"], 2 * p * r / (p + r))


def test_alignment_finds_what_was_redacted(spark):
    whole = {r["doc_id"]: r["text"] for r in texts(spark, SF).collect()}
    found = queries()["align_golden"](spark, SF).collect()
    assert found
    mails = [whole[r["doc_id"]][r["start"] : r["end"]] for r in found if r["type"] == "EMAIL"]
    assert mails and all("@" in m for m in mails)


def test_generated_rows_hold_their_values(spark):
    """Kinds by weight, spans that hold their values, and kinds of no one without spans."""
    from lacuna.operators.corpus import KINDS, generate

    rows = generate(spark, 3000).collect()
    assert all(r["source_text"][m["start"] : m["end"]] == m["value"] for r in rows for m in r["privacy_mask"])
    assert [r["uid"] for r in rows][:2] == [1_000_000, 1_000_001] and len({r["source_text"] for r in rows}) > 2000
    total, seen = sum(k[1] for k in KINDS), Counter(r["kind"] for r in rows)
    assert len(KINDS) == 21 and total == 133 and all(abs(seen[k] / 3000 - w / total) < 0.03 for k, w, _, _ in KINDS)
    assert all((len(r["privacy_mask"]) == 0) == (r["kind"].startswith(("hard", "nothing"))) for r in rows)
    assert any(len(r["privacy_mask"]) > 2 for r in rows) and any("\n" in r["source_text"] for r in rows) and not any("{" + x in r["source_text"] for r in rows for x in ("NAME}", "NUM}", "WORD}"))
    assert [tuple(r) for r in generate(spark, 5).collect()] == [tuple(r) for r in rows[:5]]


def test_entity_operators_read_the_documents(spark):
    """Every decoded entity of every document goes in, and some are joined or moved."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    every = queries()["bio_decode"](spark, SF).select("doc_id", "type", "start", "end")
    ids = {r["doc_id"] for r in every.collect()}
    assert len(ids) > d.count() // 2
    joined = queries()["merge_adjacent_documents"](spark, SF)
    assert {r["doc_id"] for r in joined.collect()} == ids and 0 < joined.count() < every.count()
    moved = queries()["house_number_documents"](spark, SF)
    assert {r["doc_id"] for r in moved.collect()} == ids and moved.count() == every.count()
    assert sorted((r["doc_id"], r["end"]) for r in moved.collect()) == sorted((r["doc_id"], r["end"]) for r in every.collect())


def test_best_by_score_of_whole_documents(spark, monkeypatch):
    """All kept spans of every document, those after the 200th too."""
    from lacuna.operators import spans

    monkeypatch.setattr(spans, "first_spans", lambda s: s)
    by: dict[int, list] = {}
    for t in tokens(spark, SF).where("start < end").collect():
        by.setdefault(t["doc_id"], []).append((t["start"], t["end"] + 3, t["score"]))
    want = Counter()
    for d, rows in by.items():
        taken: set[int] = set()
        for s, e, _ in sorted(rows, key=lambda x: (-x[2], x[0])):
            if taken.isdisjoint(range(s, e)):
                taken |= set(range(s, e))
                want[d, s, e] += 1
    assert max(map(len, by.values())) > 2_000
    assert Counter((r["doc_id"], r["start"], r["end"]) for r in queries()["nms_by_score"](spark, SF).collect()) == want


def test_entity_stage_over_documents(spark):
    """The backend's words in what the first two stages leave, in windows where a stretch is long, at most 32 a stretch."""
    import re

    from lacuna.functions import arrow_engine as engine
    from lacuna.operators.entities import MOST_SPANS, ask
    from lacuna.plans.fixtures import capital_words

    got = Counter((r["doc_id"], r["type"], r["start"], r["end"]) for r in queries()["entity_stage"](spark, SF).collect())
    found = Counter(k for k in got if k[1] == "NAME")
    assert len(found) > 100 and {k for k in got if k[1] != "NAME"} == {(r["doc_id"], k, len(r["text"][:a].encode()), len(r["text"][:b].encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for k, a, b in engine.spans(r["text"])}
    texts_ = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    connector = re.compile(r"^,?[\t\n\f\r ]*[A-Z0-9]{0,6}[\t\n\f\r ]*,?[\t\n\f\r ]*\Z")
    want = Counter()
    for d, t in texts_.items():
        at, out = 0, []
        for _, a, b in [*engine.spans(t), ("", len(t), len(t))]:
            gap = t[at:a]
            front = len(gap) - len(gap.lstrip())
            base = len(t[: at + front].encode())
            if gap.strip():
                out += [(base + s, base + e) for s, e, *_ in ask(capital_words(), [gap.strip()])[0]]
            at = b
        data, merged = t.encode(), []
        for s, e in sorted(out):
            if merged and connector.match(data[merged[-1][1] : s].decode()):
                merged[-1] = (merged[-1][0], e)
            else:
                merged.append((s, e))
        want.update((d, "NAME", s, e) for s, e in merged)
    assert found == want and MOST_SPANS == 32


def test_a_failing_piece_costs_only_itself():
    from lacuna.operators.entities import Loaded, _models, ask

    calls = []

    class Fragile:
        def __call__(self, texts):
            calls.append(len(texts))
            if any("boom" in t for t in texts):
                raise RuntimeError
            return [[(0, 2, "NAME", 0.9), (3, 4, "OTHER", 0.9), (4, 5, "NAME", 0.1)] for _ in texts]

    backend = Loaded("fragile", Fragile)
    assert ask(backend, ["ab c", "boom", "de f"]) == [[(0, 2, "NAME", 0.9)], [], [(0, 2, "NAME", 0.9)]] and calls == [3, 1, 1, 1]
    assert "fragile" in _models and ask(backend, []) == []
    backend.close()
    assert "fragile" not in _models


def test_long_stretches_go_in_windows():
    from lacuna.operators.entities import ask
    from lacuna.plans.fixtures import capital_words

    text = " ".join(f"word{k} Capital" if k % 50 == 0 else f"word{k}" for k in range(900))
    found = ask(capital_words(), [text])[0]
    assert [text[a:b] for a, b, _, _ in found] == ["Capital"] * 18 and found == sorted(found)
