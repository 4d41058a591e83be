"""Mixing sources to target weights: temperature mixing, in DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised. The exponent
is bisected to meet a target entropy, and raised again where that would repeat a source
more than allowed. The weights are realised as budgeted block permutations: each pass over
a source (an epoch) takes its blocks in an order of its own, whole blocks while the budget
lasts, and of the block where it ends the documents that still fit.

Blocks are cells of a hash of the id, so a source that holds most rows is as many small
groups; only sums of blocks are ever ordered, and the documents of one block per source.
What the rows are joined with is one row for each source: where its last epoch ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace, small, unused

BLOCKS = 4096  # of each source
EVENNESS = 0.97  # the target entropy, as a share of the entropy of equal weights
MAX_REPEATS = 4.0
HALVINGS = 20
_AT_ONCE = 5  # halvings that one pass over the sources decides

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _block(doc_id: Column, blocks: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % blocks


def _draw(seed: int, epoch: Column, what: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(what.cast("string"), F.lit(""))).cast("binary"))


def _width(source: str) -> Column:
    """Bytes of a row that decides for a source: its name, two draws and three numbers."""
    return 128 + F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0))


def exponent(sources: DataFrame, budget: Column, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for a table of sources with their share ``p`` (over 0) and ``total``.

    The largest one in [0, 1] whose entropy is at least ``evenness`` of the largest
    possible, or the smallest that repeats no source more than ``max_repeats`` times,
    whichever is larger. One pass evaluates 31 exponents and so decides five halvings;
    only its fixed number of sums reaches the driver.
    """

    def first_true(test, lo: float, hi: float) -> float:
        """The smallest exponent for which test holds, given that it does from some on."""
        for _ in range(HALVINGS // _AT_ONCE):
            step = (hi - lo) / (1 << _AT_ONCE)
            grid = [lo + k * step for k in range(1, 1 << _AT_ONCE)]
            held = sources.agg(*(test(a).alias(f"t{k}") for k, a in enumerate(grid))).first()
            at = next((k for k, x in enumerate(held) if x), len(grid))
            lo, hi = lo + at * step, lo + (at + 1) * step
        return hi

    def too_uneven(a: float) -> Column:
        z = F.sum(F.pow("p", F.lit(a)))
        entropy = F.ln(z) - F.sum(a * F.pow("p", F.lit(a)) * F.ln("p")) / z
        return entropy < evenness * F.ln(F.count(F.lit(1)))

    def few_repeats(a: float) -> Column:
        return F.max(F.pow("p", F.lit(a - 1.0))) * F.max(budget) / F.max("total") / F.sum(F.pow("p", F.lit(a))) <= max_repeats

    ends = sources.agg(too_uneven(1.0).alias("uneven"), few_repeats(0.0).alias("few")).first()
    flat = 1.0 if not ends["uneven"] else first_true(too_uneven, 0.0, 1.0)
    least = 0.0 if ends["few"] or ends["few"] is None else first_true(few_repeats, 0.0, 1.0)
    return max(flat, least)


def mix_sources(
    docs: DataFrame, budget: int | None = None, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, seed: int = 1, blocks: int = BLOCKS, tokens: Column | None = None
) -> DataFrame:
    """``docs``, each row as often as its source's weight asks for, with epoch and draw.

    budget: the tokens to hand out, by default as many as there are; at most max_repeats
    times that. epoch counts the passes over a source from 0; (epoch, draw) is an order of
    the rows of a source, epoch by epoch a permutation. tokens: a column of token counts,
    by default the words of ``text``. A source gets at most its budget, and less by less
    than one document.

    Defined results: null is a source like any other; a null or empty text has no tokens
    and takes nothing of a budget; a source without any token has weight 0 and isn't drawn;
    rows with equal doc_id and source are drawn together or not at all; an empty table
    gives no rows; input columns called epoch or draw are replaced.
    """
    work = Workspace(docs.sparkSession, "mixing")
    count = n_words(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    own = docs.drop("epoch", "draw")
    narrow = work.write(own.select(F.col("doc_id"), F.col("source"), _block(F.col("doc_id"), blocks).alias("block"), count.alias("n")), "tokens")
    cells = work.write(narrow.groupBy("source", "block").agg(F.sum("n").alias("n")), "blocks")
    sums = cells.groupBy("source").agg(F.sum("n").alias("n_source")).where(F.col("n_source") > 0)
    total = sums.agg(F.sum("n_source").alias("total"))
    shares = work.write(sums.join(total).withColumn("p", F.col("n_source") / F.col("total")), "shares")
    most = F.floor(F.lit(max_repeats) * F.col("total"))
    spend = F.least(F.lit(budget), most) if budget is not None else F.least(F.col("total"), most)
    a = exponent(shares, spend, evenness, max_repeats)
    norm = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"))
    plan = shares.join(norm).select("source", "n_source", F.floor(F.pow("p", F.lit(a)) / F.col("z") * spend + F.lit(1e-6)).alias("budget"))
    plan = work.write(plan.select("source", F.floor(F.col("budget") / F.col("n_source")).cast("int").alias("whole"), (F.col("budget") % F.col("n_source")).alias("rest")), "plan")

    met = cells.join(plan, cells["source"].eqNullSafe(plan["source"])).select(cells["source"].alias("source"), "block", "n", "whole", "rest")
    met = met.withColumn("turn", _draw(seed, F.col("whole"), F.col("block")))
    in_turn = Window.partitionBy("source").orderBy("turn", "block")
    upto = met.withColumn("upto", F.sum("n").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)))
    # sums never fall along the turns, so a turn and one block say where a source's last epoch ends
    fits = F.col("upto") <= F.col("rest")
    cut = ~fits & (F.col("upto") - F.col("n") <= F.col("rest"))
    ends = upto.groupBy("source").agg(
        F.max("whole").alias("whole"), F.max(F.when(fits, F.col("turn"))).alias("reach"), F.max(F.when(cut, F.col("block"))).alias("edge"), F.max(F.when(cut, F.col("rest") - F.col("upto") + F.col("n"))).alias("left")
    )
    ends = work.write(ends.withColumnRenamed("source", "s"), "ends")
    edge = narrow.join(small(ends, _width("s")), narrow["source"].eqNullSafe(F.col("s")) & (narrow["block"] == F.col("edge"))).withColumn("draw", _draw(seed, F.col("whole"), F.col("doc_id")))
    within = F.sum("n").over(Window.partitionBy("s").orderBy("draw"))  # equal draws stand together
    last = edge.withColumn("sum", within).where(F.col("sum") <= F.col("left")).groupBy(F.col("s").alias("l")).agg(F.max("draw").alias("last"))
    decided = ends.join(last, F.col("s").eqNullSafe(F.col("l")), "left")
    source, whole, reach, edge_at, last_draw, at = (unused(own, f"__{n}") for n in ("source", "whole", "reach", "edge", "last", "at"))
    names = {"s": source, "whole": whole, "reach": reach, "edge": edge_at, "last": last_draw}
    decided = work.write(decided.select(*(F.col(c).alias(n) for c, n in names.items())), "decided")

    rows = own.withColumn(at, _block(F.col("doc_id"), blocks))
    own_source = rows["source"].eqNullSafe(F.col(source))
    few = small(decided, _width(source))
    if few is not decided:
        drawn = rows.join(few, own_source)
    else:  # more sources than may be sent anywhere: a source's rows are dealt by block as well
        cell, block = unused(rows, "__cell"), unused(rows, "__block")
        spread = cells.select(F.col("source").alias(cell), F.col("block").alias(block)).join(decided, F.col(cell).eqNullSafe(F.col(source)))
        drawn = rows.join(spread, own_source & (F.col(at) == F.col(block)))
    by_block, by_row = (_draw(seed, F.col(whole), c) for c in (F.col(at), F.col("doc_id")))
    partly = (by_block <= F.col(reach)) | ((F.col(at) == F.col(edge_at)) & (by_row <= F.col(last_draw)))
    epochs = F.col(whole) + F.when(F.coalesce(partly, F.lit(False)), 1).otherwise(0)
    drawn = drawn.where(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    return drawn.select(*own.columns, "epoch", F.concat(_draw(seed, F.col("epoch"), F.col(at)), _draw(seed, F.col("epoch"), F.col("doc_id"))).alias("draw"))


#: mix_sources over the table ``documents`` with the default parameters.
SQL = f"""
WITH RECURSIVE narrow AS MATERIALIZED (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {BLOCKS} AS block,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents
), cells AS (SELECT source, block, CAST(sum(n) AS BIGINT) AS n FROM narrow GROUP BY 1, 2),
sums AS (SELECT source, CAST(sum(n) AS BIGINT) AS n_source FROM cells GROUP BY 1 HAVING sum(n) > 0),
shares AS (SELECT *, n_source / (SELECT sum(n_source) FROM sums) AS p FROM sums),
lists AS (SELECT list(p ORDER BY p) AS ps, ln(count(*)) * {EVENNESS} AS goal FROM shares),
ends AS (
  SELECT ps, goal, list_min(ps) AS least,
    (-list_sum(list_transform(ps, lambda x: x * ln(x)))) < goal AS uneven,
    1 / list_min(ps) / len(ps) <= {MAX_REPEATS} AS few FROM lists
), search AS (
  SELECT 0 AS k, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT k + 1, CASE WHEN e THEN elo ELSE em END, CASE WHEN e THEN em ELSE ehi END, CASE WHEN r THEN rlo ELSE rm END, CASE WHEN r THEN rm ELSE rhi END
  FROM (
    SELECT *, ln(list_sum(list_transform(ps, lambda x: pow(x, em)))) - em * list_sum(list_transform(ps, lambda x: pow(x, em) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, em))) < goal AS e,
      pow(least, rm - 1) / list_sum(list_transform(ps, lambda x: pow(x, rm))) <= {MAX_REPEATS} AS r
    FROM (SELECT *, (elo + ehi) / 2 AS em, (rlo + rhi) / 2 AS rm FROM search) CROSS JOIN ends WHERE k < {HALVINGS}
  )
), expo AS (
  SELECT greatest(CASE WHEN uneven THEN ehi ELSE 1.0 END, CASE WHEN few THEN 0.0 ELSE rhi END) AS a FROM search CROSS JOIN ends WHERE k = {HALVINGS}
), plan AS (
  SELECT source, CAST(budget // n_source AS INT) AS whole, budget % n_source AS rest FROM (
    SELECT source, n_source, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares CROSS JOIN expo) * (SELECT sum(n_source) FROM sums) + 1e-6) AS BIGINT) AS budget
    FROM shares CROSS JOIN expo
  )
), upto AS (
  SELECT c.*, whole, rest, sum(n) OVER (PARTITION BY c.source ORDER BY md5(concat('1:', whole, ':', block)), block ROWS UNBOUNDED PRECEDING) AS upto
  FROM cells c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source
), edge AS (
  SELECT u.source, u.block, md5(concat('1:', whole, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw, rest - (upto - u.n) AS over,
    sum(d.n) OVER (PARTITION BY u.source ORDER BY md5(concat('1:', whole, ':', coalesce(CAST(doc_id AS VARCHAR), '')))) AS s
  FROM upto u JOIN narrow d ON d.source IS NOT DISTINCT FROM u.source AND d.block = u.block WHERE upto > rest AND upto - u.n <= rest
), ends2 AS (SELECT source, block, max(draw) AS last FROM edge WHERE s <= over GROUP BY 1, 2),
drawn AS (
  SELECT d.doc_id, d.source, d.n, d.block, whole + CASE WHEN upto <= rest OR md5(concat('1:', whole, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) <= last THEN 1 ELSE 0 END AS epochs
  FROM narrow d JOIN upto u ON d.source IS NOT DISTINCT FROM u.source AND d.block = u.block
  LEFT JOIN ends2 e ON e.source IS NOT DISTINCT FROM u.source AND e.block = u.block
)
SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INT) AS epoch,
  md5(concat('1:', epoch, ':', block)) || md5(concat('1:', epoch, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw
FROM (SELECT *, unnest(range(epochs)) AS epoch FROM drawn WHERE epochs > 0)
"""
