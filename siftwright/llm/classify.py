"""Quality classifier and language identifier: the two uses of the subword model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.subword import Model, Shape, train
from siftwright.llm.workspace import unused

QUALITY_SHAPE = Shape(lower=False)
LANGUAGE_SHAPE = Shape(lower=True, epochs=4)
SAMPLE = 6000  # labelled rows that a model is fitted on, at most
UNDETERMINED = "und"


def fold(doc_id: Column, parts: int = 4) -> Column:
    """crc32(doc_id as text) mod parts; remainder 2 is held out. A null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column, parts: int = 4) -> Column:
    return F.coalesce(fold(doc_id, parts) == 2, F.lit(False))


def _sample(labelled: DataFrame, most: int) -> tuple[pa.Array, list]:
    """At most ``most`` rows (text, label), chosen by a hash of their id, on the driver.

    This is the only place where fitting is bounded; the columns are __id, __text, __label.
    """
    picked = labelled.orderBy(F.xxhash64("__id"), "__id", "__text").limit(most).select("__text", "__label").toArrow()
    return picked.column(0).combine_chunks() if picked.num_rows else pa.array([], pa.string()), picked.column(1).to_pylist()


def _pick(docs: DataFrame, ids: DataFrame, most: int) -> tuple[pa.Array, list]:
    """The sample's texts: ids (__id, __label) are bounded first, so the join is small."""
    few = F.broadcast(ids.orderBy(F.xxhash64("__id"), "__id", "__label").limit(most))
    return _sample(docs.join(few, "__id"), most)


def fit_quality(docs: DataFrame, labels: DataFrame, shape: Shape = QUALITY_SHAPE, sample: int = SAMPLE) -> Model:
    """Learn label 1 against label 0 from rows that are not held out.

    Labels other than 0 and 1, and a document's second label, are not used; a null text
    counts as an empty one.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("__label"))
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return train(*_pick(rows, ids, sample), shape)


def fit_language(docs: DataFrame, shape: Shape = LANGUAGE_SHAPE, sample: int = SAMPLE) -> Model:
    """Learn ``lang`` from the texts of rows that are not held out and have a letter."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    # ids are chosen without reading a text, in two steps, so that the sort carries none
    few = rows.select(F.col("doc_id").alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample).distinct()
    texts = rows.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.col("lang").alias("__label"))
    return train(*_sample(texts.join(F.broadcast(few), "__id"), sample), shape)


def _apply(model: Model, wanted: str, names: list[str]):
    one = model.classes.index(1) if 1 in model.classes else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rest = batch.column(batch.num_columns - 1), [batch.column(i) for i in range(batch.num_columns - 1)]
            chance = model.scores(text)
            if wanted == "quality":
                if one is None:
                    value = np.full(len(chance), 0.5 if model.classes == [None] else 0.0)
                else:
                    value = chance[:, one]
                extra = [pa.array(value)]
            else:
                best = chance.argmax(axis=1)
                value = chance[np.arange(len(best)), best] if len(best) else np.zeros(0)
                extra = [pa.array([model.classes[i] for i in best], pa.string()), pa.array(value), pa.array(value < model.floor)]
            yield pa.RecordBatch.from_arrays([*rest, *extra], names=[*batch.schema.names[:-1], *names])

    return score


def _scored(docs: DataFrame, model: Model, wanted: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """docs' columns ``keep`` with what the model says, and the names of that, which no column of docs has."""
    kinds = {"score": "double"} if wanted == "quality" else {"lang": "string", "score": "double", "rejected": "boolean"}
    names = [unused(docs, f"__{n}") for n in kinds]
    rows = docs.select(*keep, F.col("text").alias(unused(docs, "__text")))
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"`{n}` {k}" for n, k in zip(names, kinds.values()))]
    return rows.mapInArrow(_apply(model, wanted, names), ", ".join(fields)), names


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted (0 or 1).

    keep: the input columns to return, all by default. Defined results: a null or empty
    text is scored by the class shares alone; a model fitted on no labels scores 0.5 and
    one that saw only label 0 scores 0; repeated rows are scored each; an empty table gives
    no rows; texts of any length are read whole; input columns named as the results are
    replaced.
    """
    own = ("held_out", "score", "predicted")
    keep = [c for c in (keep or docs.columns) if c not in own]
    out, (score,) = _scored(docs, model, "quality", list(dict.fromkeys([*keep, "doc_id"])))
    result = {"held_out": held_out(F.col("doc_id")), "score": F.col(score), "predicted": F.when(F.col(score) >= threshold, 1).otherwise(0)}
    return out.select(*keep, *(c.alias(n) for n, c in result.items()))


def identify_language(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and rejected.

    lang_pred is a learned language, or ``und`` with score 0 if the text is null or has no
    letter (or nothing was learned); score is the calibrated probability. rejected marks a
    prediction below the calibrated floor, and every ``und``. Repeated rows, empty tables,
    long texts and clashing column names are treated as in score_quality.
    """
    own = ("held_out", "lang_pred", "score", "rejected")
    keep = [c for c in (keep or docs.columns) if c not in own]
    extra = list(dict.fromkeys([*keep, "doc_id"]))
    letter = unused(docs, "__letter")
    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out, (lang, score, rejected) = _scored(marked, model, "language", [*extra, letter])
    sure = F.col(letter) & F.col(lang).isNotNull()
    result = {
        "held_out": held_out(F.col("doc_id")),
        "lang_pred": F.when(sure, F.col(lang)).otherwise(F.lit(UNDETERMINED)),
        "score": F.when(sure, F.col(score)).otherwise(F.lit(0.0)),
        "rejected": ~sure | F.col(rejected),
    }
    return out.select(*keep, *(c.alias(n) for n, c in result.items()))

