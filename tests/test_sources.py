"""Files that break, lines with numbers, result files, samples, chosen conversations, a step's figures."""

import gzip
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from siftwright.functions.tokens import chunk_means, step_means
from siftwright.operators import sampling
from siftwright.operators.chat import Selection
from siftwright.operators.evaluation import mode_report
from siftwright.operators.sampling import draw, smallest
from siftwright.sources.jsonl import numbered_lines, read_jsonl, read_results, read_splits, write_jsonl


def test_a_broken_file_costs_no_other_rows(spark, tmp_path):
    for n in range(7):
        (tmp_path / "a").mkdir(exist_ok=True)
        whole = gzip.compress("".join(json.dumps({"i": 100 * n + k}) + "\n" for k in range(50)).encode())
        (tmp_path / "a" / f"{n} part.jsonl.gz").write_bytes(whole[: len(whole) // 2] if n in (2, 5) else whole)
    (tmp_path / "b.jsonl").write_text('{"i": 1}\n\n{"i": \n{"i": 3}\nno json\n', encoding="utf-8")
    rows, warnings = read_splits(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b.jsonl"), "gone": str(tmp_path / "gone")}, "i long")
    got = sorted((r.split, r.file_order, r.i) for r in rows.collect())
    assert got == sorted([("a", n, 100 * n + k) for n in (0, 1, 3, 4, 6) for k in range(50)] + [("b", 0, 1), ("b", 0, 3)])
    said = sorted((r.split, r.kind, r.n, (r.file or "").rsplit("/", 1)[-1]) for r in warnings.collect())
    assert [s[:3] for s in said] == [("a", "file", 1), ("a", "file", 1), ("b", "lines", 2), ("gone", "source", 1)]
    assert said[0][3].startswith("2") and said[1][3].startswith("5")
    none, all_gone = read_splits(spark, {"gone": str(tmp_path / "gone")}, "i long")
    assert none.count() == 0 and all_gone.count() == 1


def test_written_rows_are_counted_and_keep_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 2 else "è") for k in range(5)], "i long, t string")
    assert write_jsonl(rows, str(tmp_path / "x")) == 5
    lines = [x.value for x in spark.read.text(str(tmp_path / "x")).collect()]
    assert all('"t":' in x for x in lines) and read_jsonl(spark, str(tmp_path / "x"), "i long, t string").where("t IS NULL").count() == 2
    assert write_jsonl(rows.limit(0), str(tmp_path / "y")) == 0


@pytest.mark.parametrize("split_bytes", ["97", "134217728"])
def test_lines_have_numbers_in_their_files(spark, tmp_path, split_bytes):
    r = random.Random(1)
    want = {}
    for name in ("x", "y", "empty"):
        lines = [r.choice(["", "  ", "\t", "\x85", " "]) if r.random() < 0.3 else f"{name}{k} " + "z" * r.randrange(30) for k in range(0 if name == "empty" else 120)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
        want[name] = [t for t in lines if t.strip()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = {}
        for row in numbered_lines(spark, str(tmp_path)).collect():
            got.setdefault(row.file.rsplit("/", 1)[-1][:-4], {})[row.line] = row.value
        some = numbered_lines(spark, str(tmp_path), 17).groupBy("file").agg(F.count("line").alias("n"), F.max("line").alias("most")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: dict(enumerate(ts, 1)) for n, ts in want.items() if ts}
    assert sorted((r.n, r.most) for r in some) == [(17, 17), (17, 17)]


def test_result_files(spark, tmp_path):
    def file(name, *records):
        (tmp_path / name).write_text(json.dumps({"results": [dict(zip(("index", "output", "answer", "messages"), r)) for r in records]}, indent=1), encoding="utf-8")

    said = [{"role": "user", "content": "q"}]
    file("custom_openai_big_italic_fast_1.json", (1, "B", "A", said), (2, "B", "B", said))
    file("custom_openai_big_italic_fast_2.json", (1, "A", "A", said), (2, "", "B", said), (1, "C", "A", said))
    file("custom_openai_big_italic_1.json", (1, "Risposta: A", "A", said))
    file("custom_openai_checkpoint-9_italic_fast_1.json", (1, "A", "A", said))
    file("other.json", (1, "A", "A", said))
    rows = read_results(spark, f"{tmp_path}/*.json")
    assert sorted((r.model, r.mode, r["index"], r.output) for r in rows.collect()) == [("big", "fast", 1, "C"), ("big", "fast", 2, ""), ("big", "slow", 1, "Risposta: A")]
    assert {r["mode"]: (r.n, r.official) for r in mode_report(rows).collect()} == {"fast": (2, 0.0), "slow": (1, 1.0)}
    assert read_results(spark, f"{tmp_path}/other.json").count() == 0


@pytest.mark.parametrize("digits", [1, 4])
def test_smallest_keys_are_those_of_sorting(spark, monkeypatch, digits):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    rows = [(k % 500, ["big", "big", "big", "mid", None][k % 5] if k < 600 else "few") for k in range(604)]
    key = lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest()
    table = spark.createDataFrame([(k, g, "own", "own") for k, g in rows], "k long, g string, __key string, n string").repartition(3)
    for n in (1, 40, 10_000):
        want = sorted((str(g), k) for g in {g for _, g in rows} for k in sorted((k for k, h in rows if h == g), key=lambda k: (key(k), k))[:n])
        got = smallest(table, draw(3, F.col("k")), [F.col("k")], n, ["g"])
        assert got.columns == table.columns and sorted((str(r.g), r.k) for r in got.collect()) == want
        all_rows = smallest(table, draw(3, F.col("k")), [F.col("k")], n).collect()
        assert sorted(r.k for r in all_rows) == sorted(sorted((k for k, _ in rows), key=lambda k: (key(k), k))[:n])
    assert smallest(table.limit(0), draw(3, F.col("k")), [], 5, ["g"]).count() == 0


def test_conversations_are_put_together(spark):
    long = "word " * 10
    turns = [(c, t, r, x) for c in range(12) for t, r, x in ((2, "assistant", long), (1, "user", f"Question {c // 2}!"))]
    turns += [(20, 1, "assistant", long), (20, 2, "user", "x"), (21, 1, "user", "x"), (22, 1, "system", long), (22, 2, "assistant", long), (23, 1, "user", None), (23, 2, "assistant", long), (24, 1, "user", "y"), (24, 2, "bot", long), (24, 3, "assistant", long)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    selection = Selection(table, 100, 5)
    got = {r.conv_id: [(t.role, t.content) for t in r.conversation] for r in selection.conversations().collect()}
    assert got == {c: [("user", f"Question {c // 2}!"), ("assistant", long)] for c in range(0, 12, 2)} | {22: [("system", long), ("assistant", long)]}
    assert tuple(selection.counters().first()) == (17, 3, 7, 7, 7)
    few = Selection(table, 3, 5)
    chosen = sorted(got, key=lambda c: hashlib.md5(f"5:{c}".encode()).hexdigest())[:3]
    assert [r.conv_id for r in few.conversations().orderBy("draw").collect()] == chosen and few.counters().first().selected == 3
    assert tuple(Selection(table.limit(0), 3).counters().first()) == (0, 0, 0, 0, 0)


def test_means_are_weighted_by_real_tokens(spark):
    rows = [(1, 2.0, 0.5, True), (1, 4.0, 0.1, True), (1, 99.0, 9.0, False), (2, 1.0, 0.3, True), (3, 5.0, 5.0, False), (3, 5.0, 5.0, None)]
    tokens = spark.createDataFrame(rows, "chunk long, loss double, kl double, real boolean")
    chunks = chunk_means(tokens, "chunk", F.col("real"), loss=F.col("loss"), kl=F.col("kl"))
    assert {r.chunk: (r.n, r.loss, r.kl) for r in chunks.collect()} == {1: (2, 6.0, pytest.approx(0.3)), 2: (1, 1.0, 0.3), 3: (0, 0.0, None)}
    one = step_means(chunks, "kl").first()
    assert (one.tokens, one.loss) == (3, pytest.approx(7 / 3)) and math.isclose(one.kl, 0.3)
    none = step_means(chunks.limit(0), "kl").first()
    assert none.loss is None and none.kl is None
