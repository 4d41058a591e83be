"""Queries of evaluation runs.

The tables hold no runs, so assistant turns of ``conversations`` stand in for the outputs of
two models: a turn's index is its conversation, odd turns up to the second are fast answers
and later ones slow, and fixed openings announce some of the answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.text import lone_letter
from siftwright.operators.evaluation import broken_cases, last_records, line_from_end, looked_up, mode_crosstab, mode_report, weighted_mean, well_formed
from siftwright.plans.registry import _OPENINGS, _letter_sql, _query, _quoted, _table
from siftwright.functions.answers import ANNOUNCED, NO_ANSWER, PHRASES

_RUNS = f"""turns AS (
  SELECT 'm' || (conv_id % 2) AS model, CASE WHEN turn % 4 = 1 THEN 'fast' ELSE 'slow' END AS mode, conv_id AS index, turn,
    list_extract({list(_OPENINGS)}, 1 + CAST((conv_id + turn) % {len(_OPENINGS)} AS INTEGER)) || text AS said, substr('ABCD', 1 + CAST(conv_id % 4 AS INTEGER), 1) AS answer
  FROM conversations WHERE role = 'assistant'
), runs AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY model, mode, index ORDER BY turn DESC) = 1),
read AS (SELECT *, coalesce({_letter_sql(ANNOUNCED, 's')}, CASE WHEN NOT contains(lower(said), {_quoted(NO_ANSWER)}) THEN coalesce({', '.join(_letter_sql(p, 'is') for p in PHRASES)}) END, '') AS announced,
  regexp_extract(said, '[A-Z]') AS capital FROM runs),
judged AS (SELECT *, CASE WHEN mode = 'fast' THEN capital ELSE announced END AS official, coalesce(nullif(announced, ''), capital) AS robust FROM read)"""


def _runs(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    opening = F.get(F.array(*map(F.lit, _OPENINGS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_OPENINGS))).cast("int"))
    answer = F.get(F.array(*map(F.lit, "ABCD")), F.pmod(F.col("conv_id"), F.lit(4)).cast("int"))
    model = F.concat(F.lit("m"), F.pmod(F.col("conv_id"), F.lit(2)).cast("string"))
    mode = F.when(F.col("turn") % 4 == 1, "fast").otherwise("slow")
    turns = rows.select(model.alias("model"), mode.alias("mode"), F.col("conv_id").alias("index"), "turn", F.concat(opening, F.col("text")).alias("output"), answer.alias("answer"))
    return last_records(turns, ["model", "mode", "index"], F.col("turn"))


@_query(
    f"""WITH {_RUNS} SELECT model, mode, count(*) AS n, avg(CAST(official = answer AS INTEGER)) AS official, avg(CAST(robust = answer AS INTEGER)) AS robust,
  avg(CAST(robust = '' AS INTEGER)) AS blank, avg(length(said)) AS avg_len FROM judged GROUP BY model, mode"""
)
def evaluation_report(spark, sf_dir):
    return mode_report(_runs(spark, sf_dir))


_PAIRED = f"""{_RUNS}, paired AS (
  SELECT model, index, s.answer, s.said, s.robust, f.robust = f.answer AS fast_right, s.robust = s.answer AS slow_right
  FROM (SELECT * FROM judged WHERE mode = 'slow') s JOIN (SELECT * FROM judged WHERE mode = 'fast') f USING (model, index))"""


@_query(
    f"""WITH {_PAIRED} SELECT model, count(*) AS n, count_if(fast_right AND slow_right) AS both_right, count_if(fast_right AND NOT slow_right) AS broke,
  count_if(NOT fast_right AND slow_right) AS fixed, count_if(NOT fast_right AND NOT slow_right) AS both_wrong,
  count_if(NOT fast_right AND slow_right) - count_if(fast_right AND NOT slow_right) AS net FROM paired GROUP BY model"""
)
def evaluation_crosstab(spark, sf_dir):
    return mode_crosstab(_runs(spark, sf_dir))


@_query(f"WITH {_PAIRED} SELECT index, answer, robust AS predicted, substr(said, 1, 400) AS reasoning FROM paired WHERE model = 'm1' AND fast_right AND NOT slow_right ORDER BY index LIMIT 3")
def evaluation_broken_cases(spark, sf_dir):
    return broken_cases(_runs(spark, sf_dir), "m1")


@_query(f"WITH {_RUNS} SELECT model, count(*) AS n, avg(CAST(robust = answer AS INTEGER)) AS accuracy FROM judged GROUP BY model")
def model_comparison(spark, sf_dir):
    from siftwright.operators.evaluation import judged

    return judged(_runs(spark, sf_dir)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("robust_right").cast("int")).alias("accuracy"))


@_query("SELECT source, count(*) AS n, sum(quality * n_chars) / CAST(sum(n_chars) AS DOUBLE) AS quality, avg(n_chars) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY source")
def weighted_quality_by_source(spark, sf_dir):
    rows = looked_up(_table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), weighted_mean(F.col("quality"), F.col("n_chars")).alias("quality"), F.avg("n_chars").alias("mean_chars"))


_LONE = r"regexp_extract(said, '(?:^|[^\p{L}\p{N}_])([A-J])(?:$|[^\p{L}\p{N}_])', 1)"


@_query(f"WITH {_RUNS}, dev AS (SELECT *, {_LONE} AS letter FROM runs WHERE index < 60) SELECT mode, count(*) AS n, avg(CAST(letter = answer AS INTEGER)) AS accuracy, avg(CAST(letter IN ('A', 'B', 'C', 'D') AS INTEGER)) AS format_ok, avg(length(said)) AS mean_len FROM dev GROUP BY mode")
def dev_accuracy(spark, sf_dir):
    dev = _runs(spark, sf_dir).where("index < 60").withColumn("letter", lone_letter(F.col("output")))
    share = lambda c: F.avg(c.cast("int"))
    return dev.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), share(F.col("letter") == F.col("answer")).alias("accuracy"), share(F.col("letter").isin(*"ABCD")).alias("format_ok"), F.avg(F.length("output")).alias("mean_len"))


_OWN = "substr('ABCD', 1, CAST(2 + index % 3 AS INTEGER))"


@_query(f"WITH {_RUNS}, said AS (SELECT *, {_LONE} AS letter FROM runs) SELECT mode, count(*) AS n, avg(CAST(letter = answer AS INTEGER)) AS accuracy, avg(CAST(letter <> '' AND contains({_OWN}, letter) AS INTEGER)) AS format_ok, avg(length(said)) AS mean_len FROM said GROUP BY mode")
def answer_formats(spark, sf_dir):
    """Whether answers are letters of the question's own options; a question has two to four."""
    many = F.pmod(F.col("index"), F.lit(3)).cast("int") + 2
    options = F.transform(F.slice(F.array(*map(F.lit, "ABCD")), F.lit(1), many), lambda c: F.struct(c.alias("letter"), F.lit("").alias("text")))
    rows = _runs(spark, sf_dir).withColumns({"options": options, "letter": lone_letter(F.col("output"))})
    share = lambda c: F.avg(c.cast("int"))
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), share(F.col("letter") == F.col("answer")).alias("accuracy"), share(well_formed(F.col("letter"), F.col("options"))).alias("format_ok"), F.avg(F.length("output")).alias("mean_len"))


@_query(r"SELECT item_id, list_extract(regexp_split_to_array(text || chr(10) || 'a' || chr(10) || 'b', '\n'), -2) AS line FROM benchmark")
def lines_from_end(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", line_from_end(F.concat(F.col("text"), F.lit("\na\nb\n")), 2).alias("line"))
