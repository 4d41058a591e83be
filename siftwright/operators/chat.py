"""Selection of chat conversations in long form (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.text import letters_only
from siftwright.operators.sampling import draw, smallest
from siftwright.sources.shared import Workspace

ROLES = ("system", "user", "assistant")


def conversation_facts(turns: DataFrame) -> DataFrame:
    """What the rules ask about a conversation, in one aggregation and without its texts."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    said = F.sum(F.when(F.col("role") == "assistant", n).otherwise(0))
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
        said.alias("assistant_chars"),
        F.sum(n).alias("total_chars"),
        F.bool_and(F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).alias("known_roles"),
    )


def _valid(min_assistant: int, max_total: int) -> Column:
    right = (F.col("n_turns") >= 2) & F.col("first_role").isin("system", "user") & (F.col("last_role") == "assistant") & F.col("known_roles")
    return F.coalesce(right & (F.col("assistant_chars") >= min_assistant) & (F.col("total_chars") <= max_total), F.lit(False))


def valid_conversations(turns: DataFrame, min_assistant: int = 20, max_total: int = 7000) -> DataFrame:
    return conversation_facts(turns).where(_valid(min_assistant, max_total))


def first_user_key(text: Column, chars: int = 400) -> Column:
    """A digest of the first letters and digits of what a user says; nothing said is an empty text."""
    return F.md5(F.substring(letters_only(F.coalesce(text, F.lit(""))), 1, chars).cast("binary"))


class Selection:
    """Conversations chosen for training: valid ones, one for each first question, at most a budget of them.

    Facts and keys are decided from one aggregation that carries no text; texts are read
    again for the chosen ones alone. Defined results: a null text has no characters; a
    conversation without a user turn has the key of an empty text; of conversations with a
    key the smallest conv_id stays; turns without conv_id are one conversation like others;
    turns of the same number come in the order of role and text.
    """

    def __init__(self, turns: DataFrame, budget: int, seed: int = 0, min_assistant: int = 20, max_total: int = 7000):
        self.turns, self.budget = turns, budget
        self.work = Workspace(turns.sparkSession, "conversations")
        asks = F.col("role") == "user"
        # the key of each user turn is made where the turn is, so that what moves is a digest
        keyed = turns.select("conv_id", "turn", F.when(asks, first_user_key(F.col("text"))).alias("key"))
        keys = keyed.where("key IS NOT NULL").groupBy("conv_id").agg(F.min_by("key", "turn").alias("key"))
        facts = conversation_facts(turns).select(F.col("conv_id").alias("id"), _valid(min_assistant, max_total).alias("valid"))
        both = facts.join(keys, F.col("id").eqNullSafe(F.col("conv_id")), "left").select("id", "valid", F.coalesce("key", first_user_key(F.lit(""))).alias("key"))
        self.judged = self.work.write(both, "judged")
        firsts = self.judged.where("valid").groupBy("key").agg(F.min("id").alias("id"))
        self.unique = self.work.write(firsts, "unique")
        self.chosen = self.work.write(smallest(self.unique, draw(seed, F.col("id")), [F.col("id")], budget).withColumn("draw", draw(seed, F.col("id"))), "chosen")

    def conversations(self) -> DataFrame:
        """(conv_id, key, draw, conversation): turns in order, as (role, content); in the order of ``draw`` they are shuffled."""
        told = self.turns.join(self.chosen, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
        # a chosen conversation has at most max_total characters
        lists = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
        nested = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
        return lists.join(self.chosen, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", "key", "draw", nested.alias("conversation"))

    def counters(self) -> DataFrame:
        """One row: total, invalid, duplicates, unique, selected."""
        n = self.judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("valid")).alias("invalid"))
        unique = self.unique.agg(F.count(F.lit(1)).alias("unique"))
        selected = F.least(F.col("unique"), F.lit(self.budget).cast("long"))
        return n.join(F.broadcast(unique)).select("total", "invalid", (F.col("total") - F.col("invalid") - F.col("unique")).alias("duplicates"), "unique", selected.alias("selected"))
