"""Queries of question sources, of files in and out, and of prompts with shots.

The tables hold no question sources, so documents stand in for them: a text is a question,
its first words are options, and its id decides the answer and what a source leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.prompts import messages, plain_prompt
from siftwright.operators.questions import from_labels, from_letters, from_quiz, from_split
from siftwright.plans.registry import _quoted, _query, _table
from siftwright.sources.jsonl import read_bench, read_pool, read_splits, write_jsonl
from siftwright.sources.shared import Workspace

_WORDS = "string_split(text, ' ')[1:4]"


def _stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _rules_sql(answer: str, category: str, source: str, plain: str = "true") -> str:
    """Rows of documents that a source keeps, as its schema has them."""
    return f"""WITH raw AS (SELECT doc_id, {_stripped_sql('text')} AS question, list_transform({_WORDS}, lambda w: {_stripped_sql('w')}) AS texts, {answer} AS answer, {category} AS category
  FROM documents WHERE {plain})
SELECT question, array_to_string(list_transform(texts, lambda w, i: substr('ABCD', i, 1) || ') ' || w), chr(10)) AS options, answer, category, '{source}' AS source FROM raw
WHERE len(texts) BETWEEN 2 AND 10 AND length(question) BETWEEN 1 AND 1500 AND strpos(substr('ABCD', 1, len(texts)), answer) > 0
  AND list_sum(list_transform(texts, lambda w: length(w))) <= 2000 AND NOT list_contains(texts, '')"""


def _words() -> Column:
    return F.slice(F.split("text", " "), 1, 4)


def _letter(letters: str, n: int) -> Column:
    return F.get(F.array(*map(F.lit, letters)), F.pmod(F.col("doc_id"), F.lit(n)).cast("int"))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(") "), o["text"])), "\n"))


@_query(
    _rules_sql(
        "substr('ABCDE', 1 + CAST(doc_id % 5 AS INTEGER), 1)",
        "CASE WHEN doc_id % 3 = 0 THEN lang || '__' || source WHEN doc_id % 3 = 1 THEN lower('Macro ' || source) ELSE 'quiz' END",
        "pinocchio",
        "doc_id % 7 <> 0 AND doc_id % 11 <> 0",
    )
)
def questions_from_quiz(spark, sf_dir):
    """Sources with images, tables and nested codes; every seventh row has an image, every eleventh an option with one."""
    d = F.col("doc_id")
    letters = F.array(*map(F.lit, "ABCD"))
    options = F.transform(_words(), lambda w, i: F.struct(F.get(letters, i).alias("value"), w.alias("text"), F.when(d % 11 == 0, "i.png").alias("image")))
    code = F.when(d % 3 == 0, F.concat(F.lit("x__"), F.col("lang"), F.lit("__"), F.col("source")))
    macro = F.when(d % 3 == 1, F.concat(F.lit("Macro "), F.col("source"))).otherwise("")
    empty = F.lit(None).cast("string")
    raw = _table(spark, sf_dir, "documents").select(F.col("text").alias("question"), options.alias("options"), _letter("ABCDE", 5).alias("answer"), code.alias("genCode"), macro.alias("macro"), F.when(d % 7 == 0, "i.png").alias("image"), F.lit("").alias("table"), empty.alias("context"))
    return _lines(from_quiz(raw))


_SUBJECT = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Due Parole ' || lang ELSE upper(source) END"
_TOPIC = f"replace(lower(coalesce(nullif({_SUBJECT}, ''), 'conoscenze generali')), ' ', '_')"


def _subject() -> Column:
    kind = F.pmod(F.col("doc_id"), F.lit(4))
    return F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.concat(F.lit("Due Parole "), F.col("lang"))).otherwise(F.upper("source"))


@_query(_rules_sql("substr('ABCDE', 1 + CAST(doc_id % 5 AS INTEGER), 1)", _TOPIC, "mmlu_pro_ita"))
def questions_from_letters(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents").select(F.col("text").alias("question"), _words().alias("options"), _letter("ABCDE", 5).alias("answer"), _subject().alias("category"))
    return _lines(from_letters(raw))


@_query(_rules_sql("CASE WHEN doc_id % 9 > 0 AND doc_id % 6 BETWEEN 1 AND 4 THEN substr('ABCD', CAST(doc_id % 6 AS INTEGER), 1) END", _TOPIC, "mmlu_italian"))
def questions_from_labels(spark, sf_dir):
    """Labels from -1 to 4, every ninth null."""
    d = F.col("doc_id")
    label = F.when(d % 9 > 0, d % 6 - 1).cast("int")
    raw = _table(spark, sf_dir, "documents").select(F.col("text").alias("input_translation"), _words().alias("choices_translation"), label.alias("label"), F.struct(_subject().alias("subject")).alias("metadata"))
    return _lines(from_labels(raw))


@_query(
    f"""SELECT {_stripped_sql('text')} AS question, array_to_string(list_transform({_WORDS}, lambda w, i: substr('ABCDEFGHIJ', i, 1) || ') ' || {_stripped_sql('w')}), chr(10)) AS options,
  CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE '' END AS answer, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'test' END AS category, 'pinocchio_text/test' AS source
FROM documents WHERE {_stripped_sql('text')} <> ''"""
)
def questions_of_split(spark, sf_dir):
    """No rules of length; a category falls back to the macro topic, then to the split."""
    d = F.col("doc_id")
    options = F.transform(_words(), lambda w: F.to_json(F.struct(w.alias("value"))))
    category, macro = F.when(d % 3 == 0, F.col("lang")).when(d % 3 == 1, ""), F.when(d % 3 == 1, F.col("source")).otherwise("")
    raw = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("text").alias("question"), options.alias("options"), F.when(d % 2 == 0, "A").alias("answer"), category.alias("category"), macro.alias("macro"))
    return _lines(from_split(raw, "test"))


_SYSTEM = "Rispondi alle domande."
_SHOTS = (("Quanto fa 1 + 1?\nA) 1\nB) 2", "B"), ("Quanto fa 2 + 2?\nA) 4\nB) 5", "A"))
_BEFORE = "\n\n".join([_SYSTEM, *(x for shot in _SHOTS for x in shot), ""])


@_query(f"SELECT item_id, {_quoted(_BEFORE)} || text || chr(10) AS prompt, 2 + 2 * {len(_SHOTS)} AS n_turns FROM benchmark")
def prompts_with_shots(spark, sf_dir):
    chat = messages(F.lit(_SYSTEM), [(F.lit(q), F.lit(a)) for q, a in _SHOTS], F.col("text"))
    return _table(spark, sf_dir, "benchmark").select("item_id", chat.alias("chat")).select("item_id", plain_prompt(F.col("chat")).alias("prompt"), F.size("chat").alias("n_turns"))


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return Workspace(spark, "files").path("lines")


_LINES_SQL = "array_to_string(list_transform({w}, lambda w, i: substr('ABCD', i, 1) || ') ' || w), chr(10))"


@_query(f"SELECT text AS question, {_LINES_SQL.format(w=_WORDS)} AS options, 'A' AS answer, lang AS category, source FROM documents WHERE text IS NOT NULL")
def pool_through_jsonl(spark, sf_dir):
    """A pool written as JSON lines and read back."""
    pairs = F.transform(_words(), lambda w, i: F.array(F.get(F.array(*map(F.lit, "ABCD")), i), w))
    path = _folder(spark)
    write_jsonl(_table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("text").alias("question"), pairs.alias("options"), F.lit("A").alias("answer"), F.col("lang").alias("category"), "source"), path)
    return _lines(read_pool(spark, path))


@_query(f"SELECT text AS question, {_LINES_SQL.format(w=_WORDS)} AS options, 'B' AS answer, 'c' AS category, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE '' END AS macro FROM benchmark")
def bench_through_jsonl(spark, sf_dir):
    """A benchmark with one-letter maps as options, and a topic that half of its rows lack."""
    maps = F.transform(_words(), lambda w, i: F.create_map(F.get(F.array(*map(F.lit, "ABCD")), i), w))
    path = _folder(spark)
    write_jsonl(_table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), maps.alias("options"), F.lit("B").alias("answer"), F.lit("c").alias("category"), F.when(F.col("item_id") % 2 == 0, "even").alias("macro_category")), path)
    return _lines(read_bench(spark, path))


@_query("SELECT CASE WHEN lang = 'de' THEN 'german' ELSE 'other' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, 1 AS failed FROM documents WHERE lang IS NOT NULL GROUP BY split")
def splits_through_jsonl(spark, sf_dir):
    """All splits of a source; one that isn't there is a warning."""
    docs, path = _table(spark, sf_dir, "documents").select("doc_id", "lang"), _folder(spark)
    write_jsonl(docs.where("lang = 'de'"), f"{path}/german")
    write_jsonl(docs.where("lang <> 'de'"), f"{path}/other")
    rows, warnings = read_splits(spark, {"german": f"{path}/german", "other": f"{path}/other", "gone": f"{path}/gone"}, "doc_id long, lang string")
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    return counts.join(F.broadcast(warnings.agg(F.count(F.lit(1)).cast("int").alias("failed"))))
