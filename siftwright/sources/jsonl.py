"""JSON lines in and out, and one-row reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siftwright.sources.shared import Workspace


def read_jsonl(spark: SparkSession, path: str, schema: str, with_file: bool = False) -> DataFrame:
    """Rows of JSON lines, by a stated schema so that no pass infers one; blank lines are none.

    with_file adds the name of each row's file, for run names that only the file says.
    """
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("file", F.input_file_name()) if with_file else rows


def write_jsonl(rows: DataFrame, path: str) -> int:
    """One JSON object for each row, UTF-8, nulls written as such; returns how many rows, counted while they are written."""
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return counted.get["n"]


def run_of(file: str = "file") -> tuple:
    """(tag, mode) of a run, from a path that holds custom_openai_TAG_italic_..., fast or slow."""
    name = F.regexp_extract(file, "custom_openai_.*$", 0)
    return F.regexp_extract(name, "custom_openai_(.*?)_italic_", 1), F.when(F.contains(name, F.lit("_fast_")), "fast").otherwise("slow")


def write_report(row: DataFrame, path: str) -> None:
    """A one-row result as one indented JSON object, nulls and nested values included, in a file of its own."""
    text = F.to_json(F.struct(*row.columns), {"pretty": "true", "ignoreNullFields": "false"})
    row.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


_PAIRS = "array<array<string>>"


def _pairs(options) -> F.Column:
    return F.transform(options, lambda o: F.struct(F.get(o, F.lit(0)).alias("letter"), F.get(o, F.lit(1)).alias("text")))


def _one_key(options) -> F.Column:
    """Options as maps of one letter each, in their order."""
    entries = F.flatten(F.transform(options, F.map_entries))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text")))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Pool rows: question, options as (letter, text), answer, category, source."""
    rows = read_jsonl(spark, path, f"question string, options {_PAIRS}, answer string, category string, source string")
    return rows.withColumn("options", _pairs(F.col("options")))


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows, options as one-letter maps; a missing macro_category is an empty macro."""
    rows = read_jsonl(spark, path, "question string, options array<map<string,string>>, answer string, category string, macro_category string")
    return rows.select("question", _one_key(F.col("options")).alias("options"), "answer", "category", F.coalesce("macro_category", F.lit("")).alias("macro"))


def read_shots(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Few-shot rows as benchmark rows without macro; more than ``most`` are an error, since they go to every prompt."""
    rows = read_bench(spark, path).drop("macro")
    if len(rows.limit(most + 1).collect()) > most:
        raise ValueError(f"{path} has more than {most} shots")
    return rows


def unicode_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of text cut at every line break that Unicode knows; a final break begins no line."""
    cut = F.split(F.regexp_replace(column, r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ])$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    return texts.select(F.explode(cut).alias("line"))


def listed(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files at a path or glob, sorted, each as it is opened and as rows name it; their contents aren't read."""
    return sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "_metadata.file_path").distinct().collect())


_BROKEN = "__broken"


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """All splits in one table, and a table of warnings (split, file, kind, n, message).

    Rows have split, file and file_order, from 0 by sorted names within the split. Sources
    are read, and kept as tables, one by one: a split that isn't there, and a file that
    breaks while it is read, is a warning of kind ``source`` or ``file`` and costs no other
    rows; files of a failing split are halved until the broken ones stand alone. Lines that
    aren't JSON of the schema are left out, and their number is a warning of kind ``lines``.
    """
    work = Workspace(spark, "splits")
    kept: list[str] = []
    faults: list[tuple[str, str | None, str, int, str]] = []
    typed = StructType([*spark.createDataFrame([], schema).schema.fields, StructField(_BROKEN, StringType())])

    def told(fault: Exception) -> str:
        return f"{type(fault).__name__}: {str(fault).strip().splitlines()[0] if str(fault).strip() else ''}"[:200]

    def read(split: str, files: list[tuple[int, tuple[str, str]]]) -> None:
        if not files:
            return
        order = spark.createDataFrame([(named, n) for n, (_, named) in files], "file string, file_order int")
        rows = spark.read.schema(typed).option("columnNameOfCorruptRecord", _BROKEN).json([f for _, (f, _) in files])
        rows = rows.withColumns({"split": F.lit(split), "file": F.col("_metadata.file_path")}).join(F.broadcast(order), "file")
        try:
            name = f"part-{len(kept)}"
            work.write(rows, name)
            kept.append(name)
        except Exception as fault:  # what a task met while it read
            work.drop(name)
            if len(files) == 1:
                faults.append((split, files[0][1][1], "file", 1, told(fault)))
            else:
                half = len(files) // 2
                read(split, files[:half])
                read(split, files[half:])

    for split, path in paths.items():
        try:
            files = list(enumerate(listed(spark, path)))
        except Exception as fault:  # a source that isn't there is left out and said
            faults.append((split, None, "source", 1, told(fault)))
        else:
            read(split, files)
    whole = StructType([*typed.fields, StructField("split", StringType()), StructField("file", StringType()), StructField("file_order", IntegerType())])
    rows = spark.read.schema(whole).parquet(*(work.path(name) for name in kept)) if kept else spark.createDataFrame([], whole)
    broken = rows.where(F.col(_BROKEN).isNotNull()).groupBy("split", "file").agg(F.count(F.lit(1)).alias("n"))
    said = spark.createDataFrame(faults, "split string, file string, kind string, n long, message string")
    lines = broken.select("split", "file", F.lit("lines").alias("kind"), "n", F.lit("not JSON of the schema").alias("message"))
    return rows.where(F.col(_BROKEN).isNull()).drop(_BROKEN), said.unionByName(lines)


def numbered_lines(spark: SparkSession, path: str, scan: int | None = None) -> DataFrame:
    """(file, line, value): non-blank lines of text files with their numbers from 1 within their file, at most ``scan`` of each.

    Tasks number the lines of their own blocks as they read them; the blocks' counts, a row
    for each, are carried forward. No line is sorted or moved.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*where, "value")

    def number(batches):
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            said = pc.fill_null(pc.match_substring_regex(batch.column(2), r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"), False)
            batch = batch.filter(said)
            if not batch.num_rows:
                continue
            # lines of a block follow each other, so a batch has few runs
            file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])]))
            nth = np.arange(1, batch.num_rows + 1)
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
                key = (batch.column(0)[begin].as_py(), int(block[begin]))
                nth[begin:end] += seen.get(key, 0) - begin
                seen[key] = int(nth[end - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=["file", "block", "value", "nth"])

    numbered = lines.mapInArrow(number, "file string, block long, value string, nth long")
    blocks = Workspace(spark, "lines").write(numbered.groupBy("file", "block").agg(F.max("nth").alias("n")), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if scan is not None:
        carried = carried.where(F.col("before") < scan)
    line = F.col("before") + F.col("nth")
    out = numbered.join(carried, ["file", "block"]).select("file", line.alias("line"), "value")
    return out if scan is None else out.where(F.col("line") <= scan)


RESULTS = "results array<struct<index:long,output:string,answer:string,messages:array<struct<role:string,content:string>>>>"


def read_results(spark: SparkSession, path: str, without: str = "checkpoint") -> DataFrame:
    """(model, mode, index, output, answer, messages): evaluation records of whole result files at a path or glob.

    A file is one JSON object with ``results``; model and mode come from its name. Files with
    ``without`` in their name aren't read; of files with the same model and mode the last by
    name counts, and of records with the same index the last one in the file.
    """
    files = spark.createDataFrame([x for x in listed(spark, path) if without not in x[0].rpartition("custom_openai_")[2]], "path string, file string")
    tag, mode = run_of("path")
    runs = files.select("path", "file", tag.alias("model"), mode.alias("mode")).where("model <> ''")
    chosen = runs.groupBy("model", "mode").agg(F.max_by("file", "path").alias("file"), F.max("path").alias("path"))
    names = [r.path for r in chosen.select("path").collect()]
    if not names:
        return spark.createDataFrame([], "model string, mode string, index long, output string, answer string, messages array<struct<role:string,content:string>>")
    rows = spark.read.schema(RESULTS).option("multiLine", True).json(names).select(F.col("_metadata.file_path").alias("file"), F.posexplode("results").alias("at", "r"))
    last = rows.groupBy("file", F.col("r.index").alias("index")).agg(F.max_by(F.struct("r.output", "r.answer", "r.messages"), "at").alias("last"))
    return last.join(F.broadcast(chosen.drop("path")), "file").select("model", "mode", "index", "last.*")


def result_records(rows: DataFrame, model: str, mode: str) -> DataFrame:
    """Rows with an array ``results`` (index, output, answer) as records; of equal indexes the last in the array stays."""
    each = rows.select(F.posexplode("results").alias("at", "r")).select("at", "r.*")
    rest = [c for c in each.columns if c not in ("at", "index")]
    last = each.groupBy("index").agg(F.max_by(F.struct(*rest), "at").alias("last"))
    return last.select(F.lit(model).alias("model"), F.lit(mode).alias("mode"), "index", "last.*")


def newest_steps(names: list[str], keep: int) -> list[str]:
    """Which of step_N go when the newest ``keep`` stay; other names are never listed."""
    steps = sorted((n for n in names if n.startswith("step_") and n[5:].isdigit()), key=lambda n: int(n[5:]))
    return steps[: max(0, len(steps) - keep)]


def with_overrides(config: dict, overrides: list[str]) -> dict:
    """config with key=value strings applied, each value read as the kind that the key has; an unknown key is an error."""
    out = dict(config)
    for item in overrides:
        key, _, value = item.partition("=")
        if key not in out:
            raise KeyError(key)
        kind = type(out[key])
        out[key] = value.lower() in ("1", "true", "yes") if kind is bool else value if out[key] is None else kind(value)
    return out
