"""Question sources with layouts of their own, brought to one schema.

The result has question, options (array of letter, text), answer, category and source.
Rows that break the rules of ``valid_question`` go; a null in any field that a rule reads
breaks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.prompts import lettered

# Limits of a valid question.
MIN_OPTIONS, MAX_OPTIONS, MAX_QUESTION, MAX_OPTION_TEXT = 2, 10, 1500, 2000
NO_TOPIC = "conoscenze generali"
# What a category about the Italian language contains, and what excludes it.
LANGUAGE = "grammat|italiano|lingua|lessic|ortograf|sintass|congiuntiv|coniugaz|pronomi|avverbi|aggettiv|sinonim|contrar|etimolog|fonolog|morfolog|punteggiatur|comprensione|vocabol|analisi_grammaticale"
FOREIGN = "straniera|inglese|francese|tedesco|spagnolo"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def about_language(category: Column) -> Column:
    return category.rlike(LANGUAGE) & ~category.rlike(FOREIGN)


def valid_question(question: Column, options: Column, answer: Column) -> Column:
    texts = F.transform(options, lambda o: o["text"])
    long = F.aggregate(F.transform(texts, F.length), F.lit(0), lambda s, n: s + n)
    rules = F.size(options).between(MIN_OPTIONS, MAX_OPTIONS) & (F.length(question) > 0) & (F.length(question) <= MAX_QUESTION)
    rules &= F.array_contains(F.transform(options, lambda o: o["letter"]), answer) & (long <= MAX_OPTION_TEXT)
    return F.coalesce(rules & ~F.exists(texts, lambda t: stripped(t) == ""), F.lit(False))


def _finish(rows: DataFrame, question: Column, options: Column, answer: Column, category: Column, source: str) -> DataFrame:
    out = rows.select(stripped(question).alias("question"), options.alias("options"), answer.alias("answer"), category.alias("category"), F.lit(source).alias("source"))
    return out.where(valid_question(F.col("question"), F.col("options"), F.col("answer")))


def _said(column: Column) -> Column:
    return F.coalesce(F.length(column) > 0, F.lit(False))


def from_quiz(rows: DataFrame, source: str = "pinocchio") -> DataFrame:
    """Rows question, options (value, text, image), answer, genCode, macro, image, table, context."""
    plain = ~(_said(F.col("image")) | _said(F.col("table")) | _said(F.col("context"))) & ~F.coalesce(F.exists("options", lambda o: _said(o["image"])), F.lit(False))
    options = F.transform("options", lambda o: F.struct(o["value"].alias("letter"), stripped(o["text"]).alias("text")))
    code = F.col("genCode")
    after = F.substring(code, F.instr(code, "__") + 2, F.length(code))
    category = F.when(F.instr(code, "__") > 0, after).otherwise(F.lower(F.coalesce(F.nullif(F.col("macro"), F.lit("")), F.lit("quiz"))))
    return _finish(rows.where(plain), F.col("question"), options, F.col("answer"), category, source)


def _topic(subject: Column) -> Column:
    return F.replace(F.lower(F.coalesce(F.nullif(subject, F.lit("")), F.lit(NO_TOPIC))), F.lit(" "), F.lit("_"))


def _letters(texts: Column) -> Column:
    return F.transform(lettered(texts), lambda o: F.struct(o["letter"].alias("letter"), stripped(o["text"]).alias("text")))


def from_letters(rows: DataFrame, source: str = "mmlu_pro_ita") -> DataFrame:
    """Rows question, options (texts), answer (a letter), category."""
    return _finish(rows, F.col("question"), _letters(F.col("options")), F.col("answer"), _topic(F.col("category")), source)


def from_labels(rows: DataFrame, source: str = "mmlu_italian") -> DataFrame:
    """Rows input_translation, choices_translation (texts), label (a place from 0), metadata (subject)."""
    options, place = _letters(F.col("choices_translation")), F.col("label").cast("int")
    answer = F.when(place >= 0, F.get(options, place)["letter"])
    return _finish(rows, F.col("input_translation"), options, answer, _topic(F.col("metadata.subject")), source)


def normal_options(options: Column) -> Column:
    """Options as strings, each a JSON object with key and value, one of a letter and its text, or the text itself."""
    # The letters of options that have none of their own.
    letters = F.array(*map(F.lit, "ABCDEFGHIJ"))

    def option(o: Column, i: Column) -> Column:
        table = F.from_json(o, "map<string,string>")
        value, key = F.get_json_object(o, "$.value"), F.nullif(F.get_json_object(o, "$.key"), F.lit(""))
        letter = F.when(value.isNotNull(), F.coalesce(key, F.get(letters, i))).when(table.isNotNull(), F.get(F.map_keys(table), F.lit(0))).otherwise(F.get(letters, i))
        text = F.coalesce(value, F.get(F.map_values(table), F.lit(0)), o)
        return F.struct(letter.alias("letter"), stripped(text).alias("text"))

    return F.transform(options, option)


def from_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows question, options (strings, see normal_options), answer, category, macro of one split; rows without question or options go."""
    category = F.coalesce(F.nullif("category", F.lit("")), F.nullif("macro", F.lit("")), F.lit(split))
    question = stripped(F.coalesce("question", F.lit("")))
    out = rows.select(question.alias("question"), normal_options(F.col("options")).alias("options"), F.coalesce("answer", F.lit("")).alias("answer"), category.alias("category"), F.lit(f"pinocchio_text/{split}").alias("source"))
    return out.where((F.col("question") != "") & (F.size("options") > 0))
