"""Evaluation records: (model, mode, index, output, answer, ...) to scores, crosstabs and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.answers import announced_answer, robust_answer
from siftwright.functions.text import first_capital


def last_records(records: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One record for each key, the last in ``order``; an aggregation, so a hot key is shared out."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, "__last.*")


def judged(records: DataFrame) -> DataFrame:
    """With robust (the answer read alike in both modes), official, and whether each is right.

    A fast record's official answer is its first capital, a slow one's the announced letter.
    A null output is read as an empty one.
    """
    output = F.coalesce(F.col("output"), F.lit(""))
    official = F.when(F.col("mode") == "fast", first_capital(output)).otherwise(announced_answer(output))
    return (
        records.withColumns({"output": output, "official": official, "robust": robust_answer(output)})
        .withColumn("official_right", F.coalesce(F.col("official") == F.col("answer"), F.lit(False)))
        .withColumn("robust_right", F.coalesce(F.col("robust") == F.col("answer"), F.lit(False)))
    )


def mode_report(records: DataFrame) -> DataFrame:
    """For each model and mode: n, official and robust accuracy, share of blanks, mean output length."""

    def share(flag: Column) -> Column:
        return F.avg(flag.cast("int"))

    return judged(records).groupBy("model", "mode").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("official_right")).alias("official"),
        share(F.col("robust_right")).alias("robust"),
        share(F.col("robust") == "").alias("blank"),
        F.avg(F.length("output")).alias("avg_len"),
    )


def paired_modes(records: DataFrame) -> DataFrame:
    """Fast and slow records of a model that have the same index, one row for each pair."""
    rows = judged(records)
    fast, slow = (rows.where(F.col("mode") == m) for m in ("fast", "slow"))
    fast = fast.select("model", "index", F.col("robust_right").alias("fast_right"))
    return slow.select("model", "index", "answer", "output", "robust", F.col("robust_right").alias("slow_right")).join(fast, ["model", "index"])


def mode_crosstab(records: DataFrame) -> DataFrame:
    """For each model: how many questions both modes, one of them or none gets right."""
    fast, slow = F.col("fast_right"), F.col("slow_right")
    counts = {"both_right": fast & slow, "broke": fast & ~slow, "fixed": ~fast & slow, "both_wrong": ~fast & ~slow}
    out = paired_modes(records).groupBy("model").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    return out.withColumn("net", F.col("fixed") - F.col("broke"))


def broken_cases(records: DataFrame, model: str, shown: int = 3, chars: int = 400, line: int | None = None) -> DataFrame:
    """The first ``shown`` questions, by index, that reasoning got wrong and a fast answer didn't.

    line: records have ``messages`` (role, content), and the result gets that line, from the
    end, of the last thing the user said, empty if there is none.
    """
    own = records.where(F.col("model") == model)
    found = paired_modes(own).where(F.col("fast_right") & ~F.col("slow_right"))
    first = found.select("index", "answer", F.col("robust").alias("predicted"), F.substring("output", 1, chars).alias("reasoning")).orderBy("index").limit(shown)
    if line is None:
        return first
    asked = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"]
    told = own.where(F.col("mode") == "slow").select("index", F.coalesce(line_from_end(asked, line), F.lit("")).alias("line"))
    return first.join(told, "index")


def line_from_end(text: Column, k: int) -> Column:
    """The k-th line from the end, else null; a final line break begins no line."""
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    return F.get(lines, F.size(lines) - k)


def well_formed(letter: Column, options: Column) -> Column:
    """Whether a letter that was read is one of the row's own options (letter, text); an empty or null one isn't."""
    return F.coalesce(F.exists(options, lambda o: o["letter"] == letter), F.lit(False))


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table on key; a key that table lacks is an error, raised when the row is read."""
    has = table.withColumn("__has", F.lit(True))
    joined = rows.join(has, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("__has", F.coalesce("__has", missing.cast("boolean"))).where("__has").drop("__has")


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean of value by weight, in an aggregation; null if the weights add up to nothing."""
    return F.try_divide(F.sum(value * weight), F.sum(weight).cast("double"))
