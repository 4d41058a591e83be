"""Token sequences of two models that share a base vocabulary, and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.arrays import total

# Size of the shared vocabulary, the ends of a turn in each model, the end of text.
SHARED, TURN_END, OTHER_TURN_END, TEXT_END = 128256, 128256, 128009, 128001
STOPS = (TURN_END, TEXT_END)


def clean_completion(ids: Column, shared: int = SHARED, stops: tuple[int, ...] = STOPS) -> Column:
    """ids up to the first stop, which stays, or up to before the first other id beyond the shared ones."""
    flags = F.transform(ids, lambda t: F.when(t.isin(*stops), 1).when(t >= shared, 2).otherwise(0))
    stop, foreign = (F.array_position(flags, k) for k in (1, 2))
    cut = F.when((stop > 0) & ((foreign == 0) | (stop < foreign)), stop).when(foreign > 0, foreign - 1).otherwise(F.size(ids))
    return F.when(ids.isNotNull(), F.slice(ids, F.lit(1), cut.cast("int")))


def swapped(ids: Column, swaps: dict[int, int] | None = None) -> Column:
    """ids with some replaced, others as they are."""
    table = F.create_map(*(F.lit(x) for pair in (swaps or {TURN_END: OTHER_TURN_END}).items() for x in pair))
    return F.transform(ids, lambda t: F.coalesce(F.element_at(table, t.cast("int")).cast("bigint"), t.cast("bigint")))


def with_begin(ids: Column, begin: int) -> Column:
    """ids with the begin token in front, unless it is there."""
    return F.when(F.get(ids, F.lit(0)) == begin, ids).otherwise(F.array_prepend(ids, F.lit(begin).cast("bigint")))


def learning_rate(step: Column, rate: float, warmup: int, steps: int, schedule: str = "cosine") -> Column:
    """Linear warm-up, then a constant rate or half a cosine down to zero."""
    warm = rate * (step + 1) / max(1, warmup)
    done = F.least((step - warmup) / max(1, steps - warmup), F.lit(1.0))
    late = F.lit(rate) if schedule == "constant" else rate * 0.5 * (1 + F.cos(F.pi() * done))
    return F.when(step < warmup, warm).otherwise(late)


def merged(probabilities: Column, shared: int, into: int, extra: int) -> Column:
    """The first ``shared`` probabilities, that of place ``extra`` added to place ``into``."""
    more = F.get(probabilities, F.lit(extra))
    return F.transform(F.slice(probabilities, 1, shared), lambda p, i: F.when(i == into, p + more).otherwise(p))


def residual(shared: Column) -> Column:
    """The mass that shared probabilities leave out."""
    return 1.0 - total(shared)


def surrogate(log_p: Column, log_q: Column, token: Column) -> Column:
    """What a sampled token adds to the loss: its log-probability times its divergence, which is held constant."""
    return F.get(log_p, token) * sampled_kl(log_p, log_q, token)


def chunk_means(tokens: DataFrame, by: str, real: Column, **stats: Column) -> DataFrame:
    """(by, n, loss, ...): sums of ``loss`` and means of the other stats over the real tokens of each chunk.

    Padding is kept out by ``real``; a chunk without real tokens has none and no means.
    """
    held = {k: F.when(real, v) for k, v in stats.items()}
    sums = [(F.coalesce(F.sum(v), F.lit(0.0)) if k == "loss" else F.avg(v)).alias(k) for k, v in held.items()]
    return tokens.groupBy(by).agg(F.count_if(F.coalesce(real, F.lit(False))).alias("n"), *sums)


def step_means(chunks: DataFrame, *stats: str) -> DataFrame:
    """One row: tokens, the loss by token, and each chunk's means weighted by its tokens."""
    n = F.sum("n").cast("double")
    return chunks.agg(F.sum("n").alias("tokens"), F.try_divide(F.sum("loss"), n).alias("loss"), *(F.try_divide(F.sum(F.col(s) * F.col("n")), n).alias(s) for s in stats))


def sampled_kl(log_p: Column, log_q: Column, token: Column) -> Column:
    return F.get(log_p, token) - F.get(log_q, token)
