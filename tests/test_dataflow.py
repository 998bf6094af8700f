"""Sources, sinks, corpus preparation, streaming, command line."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from lacuna.operators import corpus
from lacuna.sources import readers, writers
from lacuna.streaming.redaction import counts_by_window, redact_folder
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\nmail a@b.co\n")
    assert readers.from_files(spark, str(tmp_path / "a.txt")).first()["text"] == "x\nmail a@b.co\n"
    with pytest.raises(FileNotFoundError, match="missing"):
        readers.from_files(spark, str(tmp_path / "missing"))
    assert readers.resolve(spark, "t", "ignored").first()["kind"] == "string" and readers.resolve(spark, "", str(tmp_path / "a.txt")).first()["kind"] == "file"
    (tmp_path / "s").mkdir()
    row = {"source_text": "Ana é", "language": "en", "privacy_mask": [{"start": 0, "end": 3, "label": "GIVENNAME"}], "uid": 1}
    (tmp_path / "s/en.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"uid": 2}) + "\n")
    (tmp_path / "s/fr.jsonl").write_text(json.dumps(row | {"uid": 3}) + "\n")
    rows = readers.read_split(spark, str(tmp_path / "s"))
    assert rows.where("uid is not null").count() == 3 and readers.read_split(spark, str(tmp_path / "s"), ("fr",)).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_split(spark, str(tmp_path / "s"), ("de",))
    with pytest.warns(UserWarning):
        assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    n = corpus.normalise(rows.where("uid is not null")).first()
    assert (n["locale"], n["privacy_mask"][0]["value"]) == ("US", "")
    (tmp_path / "w.txt").write_text(" beta \n\nalpha\nbeta\nab.cd-efgh_1 x\n!!\n")
    assert [r[0] for r in readers.read_word_list(spark, str(tmp_path / "w.txt")).collect()] == ["!!", "ab.cd-efgh_1 x", "alpha", "beta"]
    assert [r[0] for r in readers.read_usernames(spark, str(tmp_path / "w.txt")).collect()] == ["alpha", "beta", "efgh_1"]
    assert {r[0] for r in readers.read_gamer_tags(spark, str(tmp_path / "w.txt"), 5).collect()} == {"alpha", "beta"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "train"), (2, "b", "test")], "uid long, source_text string, split string")
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    writers.write_splits(df, str(tmp_path / "k"))
    assert {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()} == {"train", "test"}
    assert [json.loads(x) for p in (tmp_path / "k" / "test").glob("*.json") for x in p.read_text().splitlines()] == [{"uid": 2, "source_text": "b", "split": "test"}]
    with pytest.raises(Exception, match="(?i)malformed"):  # noqa: B017 - Spark's own error, whatever its class
        (tmp_path / "bad.jsonl").write_text('{"uid": 1}\n\nno json\n')
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "uid long").collect()
    a, b = json.loads(writers.manifest(df, "x")), json.loads(writers.manifest(df.repartition(3), "x"))
    assert a == b and a["rows"] == 2
    assert writers.with_digest(df, "source_text").where("uid = 2").first()["source_text_sha256"].startswith("3e23e8160039594a")


def test_corpus_steps(spark):
    m = lambda *xs: [{"start": a, "end": b, "label": k, "value": ""} for a, b, k in xs]
    rows = spark.createDataFrame([(1, "t", m((0, 1, "CITY"), (2, 3, "EMAIL"))), (2, "t", m((2, 3, "EMAIL"), (0, 1, "CITY"))), (3, "t", m((0, 1, "CITY"))), (4, "u", [])], f"uid long, source_text string, privacy_mask {corpus.MASK}")
    kept = corpus.deduplicate(rows, [F.col("source_text"), corpus.mask_key(F.col("privacy_mask"))], [F.col("uid")])
    assert sorted(r["uid"] for r in kept.collect()) == [1, 3, 4]
    assert {r["uid"]: r["s"] for r in rows.select("uid", corpus.stratum(F.col("privacy_mask")).alias("s")).collect()} == {1: "ADDRESS", 2: "ADDRESS", 3: "ADDRESS", 4: ""}
    many = spark.range(1000).select(F.col("id").alias("uid"), F.when(F.col("id") < 3, "tiny").otherwise("big").alias("s"))
    split = {(r["s"], r["split"]): r["n"] for r in corpus.stratified_split(many, "s", "uid").groupBy("s", "split").agg(F.count("*").alias("n")).collect()}
    assert split == {("tiny", "train"): 3, ("big", "train"): 797, ("big", "validation"): 99, ("big", "test"): 101}
    with pytest.raises(ValueError):
        corpus.stratified_split(many, "s", "uid", train=0.9)
    out = corpus.interleave(spark.range(7).select(F.col("id").alias("uid_"), (F.col("id") < 2).alias("positive")), "positive", "uid_").orderBy("uid").collect()
    assert [r["positive"] for r in out] == [True, False, True, False, False, False, False] and [r["uid"] - 2_000_000 for r in out] == list(range(7))
    t = spark.createDataFrame([(["Ana", "Ruiz", "met", "Bo"], [7, 7, 0, 7])], "tokens array<string>, tags array<int>")
    got = t.select(corpus.tokens_to_text(F.col("tokens")).alias("t"), corpus.tokens_to_spans(F.col("tokens"), F.col("tags")).alias("s")).first()
    assert [got["t"][x["start"] : x["end"]] for x in got["s"]] == ["Ana Ruiz", "Bo"]
    assert spark.range(3).select(corpus.random_ip("id").alias("ip")).where("ip rlike '^10[.]'").count() == 3


def test_no_row_is_lost_without_ids(spark):
    """Missing, null and repeated ids, and repeated rows."""
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, "b"), (1, "c"), (None, None), (None, None)], "uid long, t string")
    assert sorted(map(str, (tuple(r) for r in corpus.deduplicate(rows, [F.col("t")], [F.col("uid")]).collect()))) == sorted(map(str, [(None, "a"), (1, "b"), (1, "c"), (None, None)]))
    bare = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "source_text string")
    got = corpus.prepare(bare, bare.limit(2)).collect()
    assert sorted(r["source_text"] for r in got) == ["", "x", "y"] and sorted(r["uid"] for r in got) == [0, 1, 2]
    assert corpus.prepare(bare.limit(0)).count() == 0


def test_prepared_corpus(spark):
    classes = spark.createDataFrame([([f"w{k}", "Ana", "x"], [0, 7, 0] if k % 3 else [0, 0, 0]) for k in range(60)], "tokens array<string>, ner_tags array<int>")
    made = corpus.generate(spark, 200)
    rows = corpus.prepare(made, corpus.from_token_classes(classes), made.withColumn("uid", F.col("uid") + 5_000_000)).collect()
    assert sorted(r["uid"] for r in rows) == list(range(len(rows)))
    assert len(rows) == made.select("source_text").distinct().count() + 60
    assert {r["split"] for r in rows} == {"train", "validation", "test"}
    assert all(r["source_text"][m["start"] : m["end"]] == m["value"] for r in rows for m in r["privacy_mask"])
    from lacuna.operators.evaluate import exact_prf, gate, prf

    s = lambda *xs: [{"start": a, "end": b, "type": t} for a, b, t in xs]
    cases = spark.createDataFrame([(s((0, 3, "NAME"), (5, 9, "NAME")), s((0, 3, "NAME"), (6, 9, "NAME"), (20, 22, "ADDRESS")))], "expected array<struct<start:int,end:int,type:string>>, predicted array<struct<start:int,end:int,type:string>>")
    exact = {r["type"]: (r["tp"], r["n_expected"], r["n_predicted"]) for r in exact_prf(cases).collect()}
    assert exact == {"NAME": (1, 2, 2), "ADDRESS": (0, 0, 1), None: (1, 2, 3)}
    assert gate(prf(cases)) and not gate(exact_prf(cases))
    assert spark.range(2).select(corpus.random_timestamp("id").alias("t")).where("t rlike '^2025-.*Z$'").count() == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("-----BEGIN K-----\nx\n-----END K-----\n")
    (tmp_path / "in/b.txt").write_text("a@b.co")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    redact_folder(*args)
    (tmp_path / "in/c.txt").write_text("10.0.0.1")
    redact_folder(*args)
    assert sorted(r["redacted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["[REDACTED - EMAIL]", "[REDACTED - IPv4]", "[REDACTED - PRIVATE_KEY]\n"]
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a@b.co 10.0.0.1"), ("2024-01-01 00:02:00", "c@d.org"), ("2024-01-01 00:21:00", "c@d.org")], "at string, text string")
    counts = counts_by_window(rows.withColumn("at", F.to_timestamp("at")), "at").collect()
    assert sorted((r["type"], r["n"]) for r in counts) == [("EMAIL", 1), ("EMAIL", 2), ("IPv4", 1)]


def test_command_line(tmp_path):
    run = lambda *a, stdin="": subprocess.run([sys.executable, "-m", "lacuna", "redact", *a], input=stdin, capture_output=True, text=True, cwd=ROOT, timeout=180)
    assert run("--disable", "IPv4", stdin="a@b.co 10.0.0.1").stdout == "[REDACTED - EMAIL] 10.0.0.1"
    out = run("--text", "a@b.co", "--dry-run")
    assert json.loads(out.stdout) == {"type": "EMAIL", "start": 0, "end": 6}
    assert run(str(tmp_path / "none")).returncode == 1


def test_without_the_training_data_operators(tmp_path):
    """Everything else imports and works where their folder is not there."""
    import shutil

    shutil.copytree(os.path.join(ROOT, "lacuna"), tmp_path / "lacuna", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'redact_fast' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print('ok')"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120).stdout == "ok\n"
