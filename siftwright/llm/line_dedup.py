"""Line dedup: winnowing over line hashes.

A document is its sequence of lines that aren't blank. A window is the shortest run of
lines that has ``min_words`` words, from some line on or up to some line. Whether a run is
a window depends on its lines alone, so that each of its occurrences is one, and every line
of a longer run lies in a window within the run: in one that begins at the line or before
it, or, beyond the last of these, in the one that ends at the line.

Each window selects its least line hash; equal windows select the same line at the same
place, so a repeated run always shares a fingerprint with its first occurrence. Places of
selected lines are joined by their hash. A place that another one matches is extended both
ways, to all windows that selected it, and a window that occurred before is deleted. So a
passage that goes on differently in each of its copies is followed in every direction, and
what is compared grows with the windows of matched lines, not with the pairs of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace, small, unused

MIN_WORDS = 50

_MARKS = "doc_id long, text_hash long, line long"
_WINDOWS = "doc_id long, text_hash long, key_a long, key_b long, begin int, end int"


def _lines(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """Place, words and digest of each line that isn't blank."""
    at, sizes, hashes = [], [], []
    for i, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            at.append(i)
            sizes.append(n)
            hashes.append(hashlib.blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=16).digest())
    return at, sizes, hashes


def _windows(sizes: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first, one after the last) line of every window."""
    found = set()
    end, total = 0, 0
    for begin in range(len(sizes)):
        while end < len(sizes) and total < min_words:
            total += sizes[end]
            end += 1
        if total < min_words:
            break
        found.add((begin, end))
        total -= sizes[begin]
    begin, total = 0, 0
    for end in range(1, len(sizes) + 1):
        total += sizes[end - 1]
        while total - sizes[begin] >= min_words:
            total -= sizes[begin]
            begin += 1
        if total >= min_words:
            found.add((begin, end))
    # blank lines between two lines that are windows by themselves go only with both
    found.update((k, k + 2) for k in range(len(sizes) - 1) if min(sizes[k], sizes[k + 1]) >= min_words)
    return found


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema.split(", "))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if kind == "int" else pa.int64()) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _fingerprints(min_words: int):
    """The selected lines of each text, a row for each place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, sizes, hashes = _lines(text)
                chosen = set()
                for begin, end in _windows(sizes, min_words):
                    least = min(hashes[begin:end])
                    chosen.add((hashes.index(least, begin, end), least))
                out += [(doc, mark, _number(least)) for _, least in chosen]
            yield _batch(out, _MARKS)

    return emit


def _extended(min_words: int):
    """Every window of each text that selected a matched line; all windows where ``matched`` is null."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, text, matched in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, sizes, hashes = _lines(text)
                known = None if matched is None else set(matched)
                for begin, end in _windows(sizes, min_words):
                    own = hashes[begin:end]
                    if known is None or _number(min(own)) in known:
                        whole = hashlib.blake2b(b"".join(own), digest_size=16).digest()
                        out.append((doc, mark, _number(whole), _number(whole[8:]), at[begin], at[end - 1]))
            yield _batch(out, _WINDOWS)

    return emit


def repeated_lines(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs): for each text with repeats, its line intervals to delete; a written table."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).where(F.col("text") != "")
    places = work.write(read.mapInArrow(_fingerprints(min_words), _MARKS), "places")
    shared = places.groupBy("line").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("line")
    matched = places.join(shared, "line").groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("matched"))
    matched = work.write(matched.withColumnsRenamed({"doc_id": "m_doc", "text_hash": "m_hash"}), "matched")
    # few: the other texts aren't read again; many: windows are fewer bytes than texts, so they all go on
    few = small(matched, 24 + 8 * F.size("matched"))
    if few is not matched:
        read = read.join(few, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_hash") == F.col("m_hash"))).select("doc_id", "text_hash", "text", "matched")
    else:
        read = read.withColumn("matched", F.lit(None).cast("array<bigint>"))
    windows = work.write(read.mapInArrow(_extended(min_words), _WINDOWS), "windows")
    place = F.struct("doc_id", "text_hash", "begin", "end")
    firsts = windows.groupBy("key_a", "key_b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    met = windows.join(firsts.select("key_a", "key_b", "first"), ["key_a", "key_b"])
    same_text = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = met.where(~same_text | (F.col("begin") > F.col("first.begin")))
    # within one text the first occurrence stays, also where a later one overlaps it
    begin = F.when(same_text, F.greatest(F.col("begin"), F.col("first.end") + 1)).otherwise(F.col("begin"))
    runs = later.select("doc_id", "text_hash", F.struct(begin.alias("begin"), F.col("end")).alias("run")).where(F.col("run.begin") <= F.col("run.end"))
    return work.write(runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("run")).alias("runs")), "runs")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, name: str = "line-dedup") -> DataFrame:
    """``docs`` without later repeated runs of lines, and n_lines, n_removed.

    A run of lines with at least ``min_words`` words that occurred before (in a row with a
    smaller doc_id, or earlier in the same text) is deleted, as far as any match reaches;
    blank lines between lines of a deleted run go with them. Lines are compared without white space
    at their ends. Everything else stays as it was, in its order; n_chars, if there is such
    a column, is counted anew for changed texts.

    Defined results: a null text stays null and has no lines; an empty text has one, empty
    line; a text may end up empty, its row stays; ties of doc_id are ordered by a hash of
    the text; rows repeated with equal doc_id and text are one document, none of them is
    deleted for the other; rows without doc_id come before all others; an empty table gives
    no rows; input columns called n_lines or n_removed are replaced.
    """
    base = docs.drop("n_lines", "n_removed")
    doc, mark, runs, kept = (unused(base, n) for n in ("doc", "mark", "runs", "kept"))
    work = Workspace(docs.sparkSession, name)
    found = small(repeated_lines(base, work, min_words), 24 + 16 * F.size("runs")).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(mark), F.col("runs").alias(runs))
    joined = base.join(found, base["doc_id"].cast("long").eqNullSafe(found[doc]) & (F.xxhash64(base["text"]) == found[mark]), "left")
    lines = F.split("text", "\n", -1)
    changed = F.col(runs).isNotNull()
    stays = F.filter(lines, lambda x, i: ~F.exists(F.col(runs), lambda r: (r["begin"] <= i) & (i <= r["end"])))
    out = joined.withColumn(kept, F.when(changed, stays))
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))
    every = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    columns = {c: F.col(c) for c in base.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length(text).cast(base.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(c.alias(n) for n, c in columns.items()), every.alias("n_lines"), F.when(changed, every - F.size(kept)).otherwise(0).cast("long").alias("n_removed"))
