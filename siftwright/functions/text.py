"""Text normalisation, shingles and answer parsing as Column functions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _of_each(text: pa.Array, f: Callable[[str], str]) -> pa.Array:
    return pa.array([None if s is None else f(s) for s in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _fold_unicode(text: pa.Array) -> pa.Array:
    return _of_each(text, lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if c.isalnum() and not unicodedata.combining(c)))


def letters_only(text: Column) -> Column:
    """Lower case without accents, of letters and digits only; Python sees only non-ASCII texts."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.regexp_replace(F.lower(text), "[^0-9a-z]", "")).otherwise(_fold_unicode(F.when(~plain, text)))


def question_hash(text: Column) -> Column:
    return F.md5(letters_only(F.coalesce(text, F.lit(""))).cast("binary"))


def first_capital(output: Column) -> Column:
    """The first letter A-Z anywhere, else an empty string."""
    return F.regexp_extract(output, "[A-Z]", 0)


def lone_letter(output: Column) -> Column:
    """The first letter A-J that is a word of its own, else an empty string."""
    return F.regexp_extract(output, r"(?U)\b([A-J])\b", 1)


def _without_accents(s: str) -> str:
    t = unicodedata.normalize("NFKD", s.lower())
    for mark in filter(unicodedata.combining, set(t)):
        t = t.replace(mark, "")
    return t


@F.arrow_udf(StringType())
def _strip_accents(text: pa.Array) -> pa.Array:
    return _of_each(text, _without_accents)


@F.arrow_udf(StringType())
def unescape_html(text: pa.Array) -> pa.Array:
    return _of_each(text, html.unescape)


def unescaped(text: Column) -> Column:
    """HTML character references resolved once; Python sees only texts that have one."""
    has = F.contains(text, F.lit("&"))
    return F.when(has, unescape_html(F.when(has, text))).otherwise(text)


def resolved(text: Column, references: dict[str, str]) -> Column:
    """These character references resolved once each, as they are written; all others stay, such as unterminated ones.

    One that stands for an ampersand has to come last.
    """
    for reference, meant in references.items():
        text = F.replace(text, F.lit(reference), F.lit(meant))
    return text


def _folded(text: Column) -> Column:
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(text)).otherwise(_strip_accents(F.when(~plain, text)))


def plain_words(text: Column) -> Column:
    """Lower case without accents, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(_folded(text), r"(?U)\s+", " "))


def distinct_pieces(text: Column, cut: str) -> Column:
    """The different pieces of a text between matches of a pattern, each as ``plain_words`` has it, without empty ones."""
    pieces = F.transform(F.split(_folded(text), cut), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


# Words that frame a question and say nothing of its content.
FRAME_WORDS = (
    "il lo la i gli le un uno una di a da in con su per tra fra e o che chi cui quale quali qual come dove quando quanto quanti cosa non si e' è "
    "del della dei delle dal dalla al alla ai alle nel nella sul sé seguenti seguente termini parola verbi verbo tra fra questi queste questo indicati "
    "proposti sinonimo contrario significato individuare esatta corretta frase termine"
).split()


def content_tokens(plain: Column) -> Column:
    """Distinct words of a normalised text, of four letters or more, that don't merely frame a question."""
    words = F.split(plain, " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*dict.fromkeys(FRAME_WORDS))))
