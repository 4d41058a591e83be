"""Rendering multiple-choice questions: options are arrays of (letter, text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two forms of a question, before and after what is filled in.
_ASK = "Rispondi alla seguente domanda a scelta multipla sull'argomento '"
REASONED = ("'. L'ultima riga della tua risposta deve essere nel seguente formato: 'Risposta: LETTERA' (senza virgolette) dove LETTERA è una tra ", ". Ragiona brevemente prima di rispondere.\n\n", "")
DIRECT = ("'. La tua risposta deve essere nel seguente formato: 'LETTERA' (senza virgolette) dove LETTERA è una tra ", ". Scrivi solo la lettera corrispondente alla tua risposta senza spiegazioni.\n\n", "\n\nRisposta:")


def lettered(texts: Column) -> Column:
    """Texts as options A, B, C and so on, trimmed."""
    return F.transform(texts, lambda t, i: F.struct(F.char(i + 65).alias("letter"), F.trim(t).alias("text")))


def option_lines(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(") "), o["text"])), "\n")


def option_letters(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: o["letter"]), "")


def user_query(topic: Column, question: Column, options: Column, direct: bool = True) -> Column:
    letters, asked, end = DIRECT if direct else REASONED
    return F.concat(F.lit(_ASK), topic, F.lit(letters), option_letters(options), F.lit(asked), question, F.lit("\n\n"), option_lines(options), F.lit(end))


def messages(system: Column, shots: list[tuple[Column, Column]], asked: Column) -> Column:
    """The chat: a system turn, a user and an assistant turn for each shot, and the question."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    told = [t for q, a in shots for t in (turn("user", q), turn("assistant", a))]
    return F.array(turn("system", system), *told, turn("user", asked))


def plain_prompt(chat: Column) -> Column:
    """A chat as plain text, for models without a chat template."""
    return F.concat(F.array_join(F.transform(chat, lambda m: m["content"]), "\n\n"), F.lit("\n"))


def asked(row: Column, fast: Column) -> Column:
    """The question of a struct (topic, question, options, answer), in the direct form if fast."""
    form = lambda direct: user_query(row["topic"], row["question"], row["options"], direct)
    return F.when(fast, form(True)).otherwise(form(False))


def few_shot_chat(system: Column, shots: Column, row: Column, fast: Column) -> Column:
    """The chat of a question after an array of shots, all in the same form; a shot's answer is its letter alone."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    told = F.flatten(F.transform(shots, lambda s: F.array(turn("user", asked(s, fast)), turn("assistant", s["answer"]))))
    return F.concat(F.array(turn("system", system)), told, F.array(turn("user", asked(row, fast))))
