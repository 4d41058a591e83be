"""Reading the answer letter out of a model's output, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.functions.text import first_capital

# The phrases that announce an answer, in the order in which they are tried.
ANNOUNCED = r"Risposta:\s*(.*?)\s*(?:\n[A-Z]\)|\z)"
NO_ANSWER = "nessuna delle opzioni"
PHRASES = (
    r"quindi, la risposta è\s*(.*?)\s*(?:\n[A-Z]\)|\z)",
    r"risposta\s*(?:corretta|giusta|appropriata|esatta|migliore|ottimale|finale|definitiva)?\s*[:è]*\s*(.*?)\s*(?:\n[A-Z]\)|\z)",
    r"risposta\s*più\s*(?:corretta|appropriata)\s*[:è]*\s*(.*?)\s*(?:\n[A-Z]\)|\z)",
    r"(?:soluzione|opzione|scelta|alternativa)\s*(?:corretta)?\s*[:è]*\s*(.*?)\s*(?:\n[A-Z]\)|\z)",
    r"(?:quindi|in\s*conclusione,?)?\s*(?:la\s*)?risposta\s*è\s*(.*?)\s*(?:\n[A-Z]\)|\z)",
    r"(?:la\s*)?(?:risposta|opzione|scelta)\s*(?:corretta|giusta|esatta)\s*è\s*(?:la\s*)?(?:lettera\s*)?([A-Z])",
)


def _letter(output: Column, pattern: str, flags: str) -> Column:
    return F.nullif(first_capital(F.regexp_extract(output, f"(?{flags}){pattern}", 1)), F.lit(""))


def announced_answer(output: Column) -> Column:
    """The letter after the first phrase that gives one, else an empty string; null stays null.

    An output that says none of the options holds has only its explicit announcement.
    """
    said = _letter(output, ANNOUNCED, "sU")
    guessed = F.when(~F.contains(F.lower(output), F.lit(NO_ANSWER)), F.coalesce(*(_letter(output, p, "iusU") for p in PHRASES)))
    return F.when(output.isNotNull(), F.coalesce(said, guessed, F.lit("")))


def robust_answer(output: Column) -> Column:
    """The announced letter, or the first capital anywhere."""
    return F.coalesce(F.nullif(announced_answer(output), F.lit("")), first_capital(output))
