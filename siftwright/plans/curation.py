"""Queries of pool building: splits, draws, shares, layouts, token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.arrays import log_softmax
from siftwright.functions.tokens import clean_completion, learning_rate, merged, residual, sampled_kl, swapped, with_begin
from siftwright.functions.text import question_hash
from siftwright.operators.pool import dev_split, without_keys
from siftwright.operators.questions import normal_options
from siftwright.operators.draws import regime_draw
from siftwright.operators.sampling import draw, smallest
from siftwright.plans.registry import _HASH, _query, _table


@_query(f"WITH hashed AS (SELECT doc_id, {_HASH} AS h FROM documents), dev AS (SELECT h FROM hashed ORDER BY h, doc_id LIMIT 500) SELECT doc_id FROM hashed WHERE h NOT IN (SELECT h FROM dev)")
def train_rows(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", question_hash(F.col("text")).alias("h"))
    return without_keys(docs, F.col("h"), dev_split(docs, F.col("h"), [F.col("doc_id")], 500), F.col("h")).select("doc_id")


@_query("SELECT doc_id, source FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 300")
def budget_sample_300(spark, sf_dir):
    return smallest(_table(spark, sf_dir, "documents").select("doc_id", "source"), draw(11, F.col("doc_id")), [F.col("doc_id")], 300)


@_query("SELECT doc_id, md5('5:' || doc_id) AS draw FROM documents ORDER BY draw, doc_id")
def seeded_shuffle(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", draw(5, F.col("doc_id")).alias("draw")).orderBy("draw", "doc_id")


@_query("SELECT doc_id, substr(text, 1, 150) AS opening FROM documents ORDER BY doc_id LIMIT 12")
def prefix_samples_12(spark, sf_dir):
    return _table(spark, sf_dir, "documents").orderBy("doc_id").limit(12).select("doc_id", F.substring("text", 1, 150).alias("opening"))


@_query(
    """WITH r AS (SELECT lang, coalesce(quality, 0) = 1 AS kept FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, count_if(kept) AS kept, 100.0::DOUBLE * count_if(kept) / count(*) AS kept_pct, count_if(kept) / (SELECT count_if(kept) FROM r)::DOUBLE AS share FROM r GROUP BY lang"""
)
def kept_shares(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("one")), "doc_id", "left")
    out = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("kept"))
    whole = out.agg(F.sum("kept").cast("double").alias("all_kept"))
    return out.crossJoin(F.broadcast(whole)).select("lang", "n", "kept", F.try_divide(100.0 * F.col("kept"), F.col("n")).alias("kept_pct"), F.try_divide(F.col("kept"), F.col("all_kept")).alias("share"))


@_query("SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE lang = 'de' UNION ALL SELECT source FROM documents WHERE lang <> 'de' UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY source")
def pool_union(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "lang")
    bench = _table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"))
    return docs.where("lang = 'de'").select("source").unionByName(docs.where("lang <> 'de'").select("source")).unionByName(bench).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _vocab(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias(name))


_VOCAB = "SELECT token, count(*) AS id FROM (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark WHERE item_id % 2 = {}) GROUP BY token"


@_query(f"WITH a AS ({_VOCAB.format(0)}), b AS ({_VOCAB.format(1)}) SELECT token, coalesce(a.id, 0) AS left_id, coalesce(b.id, 0) AS right_id FROM a FULL JOIN b USING (token) WHERE a.id IS DISTINCT FROM b.id")
def vocabulary_difference(spark, sf_dir):
    bench = _table(spark, sf_dir, "benchmark")
    both = _vocab(bench.where("item_id % 2 = 0"), "left_id").join(_vocab(bench.where("item_id % 2 = 1"), "right_id"), "token", "full")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id"))).fillna(0, ["left_id", "right_id"])


_IDS = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: 128200 + CAST(floor(abs(x) * 10000) AS BIGINT) % 58)"
_CUT = "list_position(list_transform(ids, lambda t: t >= 128256), true)"


@_query(
    f"""WITH raw AS (SELECT vec_id, {_IDS} AS ids FROM embeddings), cut AS (SELECT *, coalesce({_CUT}, 0) AS cut_at FROM raw),
clean AS (SELECT vec_id, CASE WHEN cut_at = 0 THEN ids WHEN ids[cut_at] = 128256 THEN ids[:cut_at] ELSE ids[:cut_at - 1] END AS ids FROM cut)
SELECT vec_id, len(ids) > 0 AS said, array_to_string(ids, ' ') AS ids, array_to_string(list_transform(ids, lambda t: CASE WHEN t = 128256 THEN 128009 ELSE t END), ' ') AS other,
  len(ids) + CASE WHEN len(ids) > 0 AND ids[1] = 128200 THEN 0 ELSE 1 END AS with_begin FROM clean"""
)
def completions_cleaned(spark, sf_dir):
    ids = F.transform(F.col("embedding").cast("array<double>"), lambda x: 128200 + F.floor(F.abs(x) * 10000) % 58)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("raw")).select("vec_id", clean_completion(F.col("raw")).alias("ids"))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select("vec_id", (F.size("ids") > 0).alias("said"), text(F.col("ids")).alias("ids"), text(swapped(F.col("ids"))).alias("other"), F.size(with_begin(F.col("ids"), 128200)).cast("long").alias("with_begin"))


@_query("SELECT doc_id, CASE WHEN doc_id < 50 THEN 0.001::DOUBLE * (doc_id + 1) / 50 ELSE 0.001::DOUBLE * 0.5 * (1 + cos(pi() * least((doc_id - 50) / 850.0::DOUBLE, 1.0))) END AS rate FROM documents")
def learning_rates(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", learning_rate(F.col("doc_id"), 0.001, 50, 900).alias("rate"))


@_query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), z AS (SELECT *, list_sum(list_transform(x, lambda y: exp(y))) AS mass FROM v),
p AS (SELECT vec_id, len(x) AS n, list_transform(x, lambda y: exp(y) / mass) AS p FROM z),
m AS (SELECT vec_id, n, list_transform(p[:n - 2], lambda q, i: q + CASE WHEN i = 4 THEN p[n] ELSE 0 END) AS m FROM p)
SELECT vec_id, round(1 - list_sum(m), 6) AS residual, round(ln(m[1 + vec_id % 8]) + ln(n - 2), 6) AS sampled_kl FROM m"""
)
def sampled_divergence(spark, sf_dir):
    n = F.size("embedding")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", n.alias("n"), F.transform(log_softmax(F.col("embedding")), F.exp).alias("p"))
    rows = rows.withColumn("m", merged(F.col("p"), F.col("n") - 2, 3, F.col("n") - 1))
    uniform = F.transform("m", lambda _: -F.ln(F.col("n") - 2))
    return rows.select("vec_id", F.round(residual(F.col("m")), 6).alias("residual"), F.round(sampled_kl(F.transform("m", F.ln), uniform, (F.col("vec_id") % 8).cast("int")), 6).alias("sampled_kl"))


_FOUR = "string_split(text, ' ')[1:4]"


@_query(f"SELECT item_id, array_to_string(list_transform({_FOUR}, lambda w, i: substr('ABCDEFGHIJ', i, 1) || ') ' || trim(w)), chr(10)) AS options FROM benchmark WHERE len({_FOUR}) > 0 AND text <> ''")
def option_layouts(spark, sf_dir):
    words = F.slice(F.split("text", " "), 1, 4)
    letter = lambda i: F.get(F.array(*map(F.lit, "ABCDEFGHIJ")), i)
    keyed = F.transform(words, lambda w, i: F.to_json(F.struct(letter(i).alias("key"), w.alias("value"))))
    mapped = F.transform(words, lambda w, i: F.to_json(F.create_map(letter(i), w)))
    layout = F.when(F.col("item_id") % 3 == 0, keyed).when(F.col("item_id") % 3 == 1, mapped).otherwise(words)
    rows = _table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", normal_options(layout).alias("o"))
    return rows.select("item_id", F.array_join(F.transform("o", lambda o: F.concat(o["letter"], F.lit(") "), o["text"])), "\n").alias("options"))


def _uniform_sql(name: str) -> str:
    return f"CAST('0x' || substr(md5('3:{name}:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@_query(
    f"""WITH u AS (SELECT doc_id, {_uniform_sql('regime')} AS u, {_uniform_sql('shots')} AS k, {_uniform_sql('form')} AS f FROM documents)
SELECT doc_id, CASE WHEN u < 0.5 THEN 'official' WHEN u < 0.75 THEN 'pool' ELSE 'zero' END AS regime,
  CAST(CASE WHEN u < 0.5 THEN 5 WHEN u < 0.75 THEN 1 + floor(k * 5) ELSE 0 END AS INTEGER) AS shots, f >= 0.25 AS fast FROM u"""
)
def regimes_drawn(spark, sf_dir):
    return regime_draw(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=3, reasoned=0.25)
