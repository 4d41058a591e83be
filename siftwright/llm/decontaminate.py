"""Benchmark decontamination by winnowing, in DataFrame functions only.

A fingerprint is the minimum hash of the eight-word grams of a window of thirteen words.
Two equal windows have the same fingerprint, so a document that shares a window with the
benchmark always shares a fingerprint with it. Documents whose fingerprints join those of
the benchmark are read again, and each hit is extended to its whole window and compared
word for word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace, unused

WINDOW = 13  # words; gram + positions - 1
GRAM = 8
POSITIONS = 6
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a plain expression would be copied instead."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; only A-Z are lower-cased, since elsewhere the neighbours of a letter may decide."""
    return F.array_remove(F.split(F.coalesce(F.translate(text, _UPPER, _LOWER), F.lit("")), _NOT_WORD), "")


def _shifted(x: Column, by: int) -> Column:
    return F.slice(x, by + 1, F.size(x))


def _hash_next(x: Column, by: int) -> Column:
    return F.zip_with(x, _shifted(x, by), lambda a, b: F.xxhash64(a, b))


def _least_next(x: Column, by: int) -> Column:
    return F.zip_with(x, _shifted(x, by), lambda a, b: F.least(a, b))


def window_minima(words: Column) -> Column:
    """For each place where a whole window starts, its fingerprint; words is evaluated once."""

    def minima(w: Column) -> Column:
        grams = _let(_let(_hash_next(w, 1), lambda g2: _hash_next(g2, 2)), lambda g4: _hash_next(g4, 4))
        of_two = _let(grams, lambda g: _least_next(g, 1))
        of_six = _let(of_two, lambda m2: _let(_least_next(m2, 2), lambda m4: F.zip_with(m4, _shifted(m2, 4), lambda a, b: F.least(a, b))))
        return F.when(F.size(w) >= WINDOW, F.slice(of_six, 1, F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))

    return _let(words, minima)


def _joined(words: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def _starts(words: Column, n: int) -> Column:
    """0, 1, ... for the places where n words in a row start; none if there are fewer."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _short_mark(text: Column, n: int) -> Column:
    """The fingerprint of an item of n words, fewer than a window."""
    return F.xxhash64(F.lit(n), text)


def _fingerprints(words: Column, short: list[int]) -> Column:
    def marks(w: Column) -> Column:
        def of_length(n: int) -> Column:
            return F.transform(_starts(w, n), lambda i: _short_mark(_joined(w, i, n), n))  # a lambda's second parameter would be the index

        parts = [window_minima(w), *map(of_length, short)]
        return F.array_distinct(F.concat(*parts))

    return _let(words, marks)


def _hits(words: Column, minima: Column, matched: Column, short: list[int]) -> Column:
    """(start, length, text) of every window whose fingerprint is among the matched ones."""

    def windows(w: Column) -> Column:
        def long(m: Column) -> Column:
            chosen = F.filter(_starts(w, WINDOW), lambda i: F.array_contains(matched, m[i]))
            return F.transform(chosen, lambda i: F.struct(i.alias("start"), F.lit(WINDOW).alias("length"), _joined(w, i, WINDOW).alias("window")))

        def of_length(n: int) -> Column:
            every = F.transform(_starts(w, n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), _joined(w, i, n).alias("window")))
            return F.filter(every, lambda x: F.array_contains(matched, _short_mark(x["window"], n)))

        return F.concat(_let(minima, long), *map(of_length, short))

    return _let(words, windows)


def find_contamination(docs: DataFrame, benchmark: DataFrame, name: str = "decontaminate") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is thirteen consecutive words of a benchmark item, or the whole item if it has
    fewer. A document word inside any occurrence of a window is hit; a document is
    contaminated if at least a twentieth of its words, and at least one, are hit. items_sha256
    is the digest of the sorted, comma-joined ids of the items with occurring windows.

    Defined results: null and empty texts have no words and are clean; items without words
    have no window; items with the same id count once and an item without an id is not
    listed; repeated rows of ``docs`` give a row each; rows that share a doc_id but not the
    text are kept apart by text_hash; empty tables give no rows or no hits. Other columns of
    either table are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, name)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # twelve lengths at most
    whole = F.transform(_starts(F.col("w"), WINDOW), lambda i: _joined(F.col("w"), i, WINDOW))
    windows = items.select("item", F.explode(F.when(F.size("w") >= WINDOW, whole).otherwise(F.array(F.array_join("w", " ")))).alias("window"))
    windows = work.write(windows.groupBy("window").agg(F.collect_set("item").alias("items")), "windows")
    own = F.when(F.size("w") >= WINDOW, window_minima(F.col("w"))).otherwise(F.array(F.xxhash64(F.size("w"), F.array_join("w", " "))))
    marks = work.write(items.select(F.explode(own).alias("mark")).distinct(), "marks").select(F.col("mark").alias("key"), F.lit(True).alias("known"))

    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def first(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.concat(F.array(F.lit(None).cast("bigint")), _fingerprints(w, short)).alias("marks"))

    once = read.select("doc_id", "text_hash", _let(words_of(F.col("text")), first).alias("x"))
    # the row that counts a text has no mark; its key is dealt out evenly, since null keys would all meet
    found = (
        once.select("doc_id", "text_hash", F.col("x.n").alias("n_words"), F.explode("x.marks").alias("mark"))
        .withColumn("key", F.coalesce("mark", F.xxhash64("doc_id", "text_hash")))
        .join(marks, "key", "left")
        .where(F.col("mark").isNull() | F.col("known"))
        .groupBy("doc_id", "text_hash")
        .agg(F.max("n_words").alias("n_words"), F.count_if(F.col("mark").isNull()).alias("copies"), F.collect_set("mark").alias("matched"))
    )
    found = work.write(found, "found")
    candidates = work.write(found.where(F.size("matched") > 0).select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "matched"), "candidates")
    again = read.join(candidates, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash")))
    hits = again.select("doc_id", "text_hash", F.explode(_let(words_of(F.col("text")), lambda w: _hits(w, window_minima(w), F.col("matched"), short))).alias("h"))
    verified = hits.select("doc_id", "text_hash", "h.*").join(windows, "window")
    spans = verified.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def covered(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))

    counted = spans.select(
        F.col("doc_id").alias("s_doc"), F.col("text_hash").alias("s_hash"), F.aggregate("spans", start, covered, lambda acc: acc["n"]).alias("hit"), F.size("ids").cast("long").alias("many"), F.sha2(F.array_join("ids", ","), 256).alias("digest")
    )
    counted = work.write(counted, "counted")
    for name in ("windows", "marks", "candidates"):
        work.drop(name)
    n_hit = F.coalesce(F.col("hit"), F.lit(0).cast("long"))
    return (
        found.join(counted, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("text_hash") == F.col("s_hash")), "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.col("many"), F.lit(0).cast("long")).alias("n_items"),
            F.coalesce(F.col("digest"), F.sha2(F.lit(""), 256)).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that find_contamination doesn't call contaminated, unchanged."""
    doc, mark = unused(docs, "__doc"), unused(docs, "__hash")
    bad = find_contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(mark)).distinct()
    bad = Workspace(docs.sparkSession, "contaminated").write(bad, "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[doc]) & (F.xxhash64(docs["text"]) == bad[mark]), "left_anti")


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
