"""Every registered query of the curation engine, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.answers import ANNOUNCED, NO_ANSWER, PHRASES, announced_answer, robust_answer
from siftwright.functions.arrays import log_softmax, reverse_kl
from siftwright.functions.prompts import DIRECT, lettered, user_query
from siftwright.functions.text import FRAME_WORDS, content_tokens, distinct_pieces, first_capital, letters_only, lone_letter, plain_words, question_hash
from siftwright.operators.chat import valid_conversations
from siftwright.operators.nearest import nearest
from siftwright.operators.lsh import verified_candidates
from siftwright.operators.overlap import best_match, contained, shared, shingles
from siftwright.operators.pool import dev_split, keep_first, upweight, with_keys, without_keys
from siftwright.operators.questions import FOREIGN, LANGUAGE, about_language
from siftwright.operators.sampling import draw, smallest
from siftwright.operators.reports import accuracy, cumulative_counts, gains_by, running_accuracy, with_position

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_HASH = r"md5(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]', '', 'g'))"
_POOL = f"""hashed AS (SELECT *, {_HASH} AS h FROM documents),
firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY source, doc_id) = 1),
pool AS (SELECT * FROM firsts WHERE h NOT IN (SELECT {_HASH} FROM benchmark))"""
EDGES = (0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99, 1.01)  # fixed values: the bands of a similarity


def _query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", question_hash(F.col("text")).alias("h"))
    firsts = keep_first(docs, F.col("h"), [F.col("source"), F.col("doc_id")])
    return without_keys(firsts, F.col("h"), _table(spark, sf_dir, "benchmark"), question_hash(F.col("text")))


@_query(f"WITH {_POOL} SELECT doc_id, source, lang, h AS question_hash FROM pool")
def pool_exact_dedup(spark, sf_dir):
    return _pool(spark, sf_dir).withColumnRenamed("h", "question_hash")


@_query(f"WITH {_POOL} SELECT source, count(*) AS n FROM pool GROUP BY source")
def pool_counts_by_source(spark, sf_dir):
    return _pool(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT count(*) AS leaked FROM documents WHERE {_HASH} IN (SELECT {_HASH} FROM benchmark)")
def exact_leak_count(spark, sf_dir):
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return with_keys(docs, question_hash(F.col("text")), bench, question_hash(F.col("text"))).agg(F.count(F.lit(1)).alias("leaked"))


@_query(f"WITH hashed AS (SELECT doc_id, {_HASH} AS h FROM documents) SELECT doc_id FROM hashed ORDER BY h, doc_id LIMIT 500")
def dev_split_500(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", question_hash(F.col("text")).alias("h"))
    return dev_split(docs, F.col("h"), [F.col("doc_id")], 500).select("doc_id")


@_query("SELECT d.source, count(*) AS n, sum(quality) AS correct, avg(quality) AS accuracy FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source")
def teacher_accuracy_by_source(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("correct"), F.avg("quality").alias("accuracy"))


@_query("SELECT doc_id, lang, unnest(range(1, CASE WHEN lang = 'de' THEN 5 ELSE 2 END)) AS copy FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def teacher_filter_upweight(spark, sf_dir):
    right = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return upweight(_table(spark, sf_dir, "documents").select("doc_id", "lang").join(right, "doc_id"), F.col("lang") == "de", 4)


_FACTS = """facts AS (
  SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS assistant_chars, CAST(sum(length(text)) AS BIGINT) AS total_chars,
    bool_and(role IN ('system', 'user', 'assistant')) AS known_roles FROM conversations GROUP BY conv_id
)"""


@_query(f"WITH {_FACTS} SELECT * FROM facts WHERE n_turns >= 2 AND first_role IN ('system', 'user') AND last_role = 'assistant' AND known_roles AND assistant_chars >= 20 AND total_chars <= 7000")
def conversations_valid(spark, sf_dir):
    return valid_conversations(_table(spark, sf_dir, "conversations"))


@_query(r"""SELECT conv_id, turn, regexp_extract(text, '[A-Z]') AS first_capital, regexp_extract(text, '(?:^|[^\p{L}\p{N}_])([A-J])(?:$|[^\p{L}\p{N}_])', 1) AS lone_letter FROM conversations WHERE role = 'assistant'""")
def answers_parsed(spark, sf_dir):
    said = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", first_capital(F.col("text")).alias("first_capital"), lone_letter(F.col("text")).alias("lone_letter"))


@_query("WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels) SELECT doc_id FROM n WHERE pos % greatest(1, n // 100) = 0 AND pos // greatest(1, n // 100) < 100")
def stride_sample_100(spark, sf_dir):
    step, at = F.greatest(F.lit(1), F.floor(F.col("n") / 100)), F.col("position")
    return with_position(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", of="n").where((at % step == 0) & (F.floor(at / step) < 100)).select("doc_id")


@_query("SELECT count_if(quality = 1 AND toxic = 0) AS both_right, count_if(quality = 1 AND toxic = 1) AS broken, count_if(quality = 0 AND toxic = 0) AS fixed, count_if(quality = 0 AND toxic = 1) AS both_wrong FROM labels")
def paired_breakdown(spark, sf_dir):
    def n(q: int, t: int, name: str):
        return F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(name)

    return _table(spark, sf_dir, "labels").agg(n(1, 0, "both_right"), n(1, 1, "broken"), n(0, 0, "fixed"), n(0, 1, "both_wrong"))


_SIMS = """sims AS (
  SELECT p.vec_id, b.vec_id AS bench_id, list_dot_product(p.v, b.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0) p,
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0) b
), best AS (SELECT vec_id, arg_max(bench_id, sim) AS bench_id, max(sim) AS sim FROM sims GROUP BY vec_id)"""


def _best(spark, sf_dir) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 5 <> 0"), vectors.where("vec_id % 5 = 0"))


@_query(f"WITH {_SIMS} SELECT vec_id, bench_id, round(sim, 6) AS sim FROM best WHERE sim < 0.4")
def semantic_decontaminate(spark, sf_dir):
    return _best(spark, sf_dir).where("sim < 0.4").withColumn("sim", F.round("sim", 6))


@_query(
    f"""WITH {_SIMS}, edges AS (SELECT unnest({list(EDGES[:-1])}) AS lo, unnest({list(EDGES[1:])}) AS hi)
SELECT CAST(lo AS DOUBLE) AS lo, count(*) AS n FROM best JOIN edges ON sim >= lo AND sim < hi GROUP BY lo"""
)
def coverage_histogram(spark, sf_dir):
    band = F.lit(None).cast("double")
    for lo, hi in zip(EDGES, EDGES[1:]):
        band = F.when((F.col("sim") >= lo) & (F.col("sim") < hi), F.lit(lo)).otherwise(band)
    return _best(spark, sf_dir).select(band.alias("lo")).where("lo IS NOT NULL").groupBy("lo").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"""WITH groups AS (SELECT {_HASH} AS h, count(*) AS n FROM documents GROUP BY h),
kept AS (SELECT *, h IN (SELECT {_HASH} FROM benchmark) AS overlap FROM groups)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (overlap), 0) AS BIGINT) AS overlap,
  CAST(coalesce(sum(n - 1) FILTER (NOT overlap), 0) AS BIGINT) AS duplicates, count(*) FILTER (NOT overlap) AS kept FROM kept"""
)
def pool_drop_counters(spark, sf_dir):
    groups = _table(spark, sf_dir, "documents").groupBy(question_hash(F.col("text")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    bench = _table(spark, sf_dir, "benchmark").select(question_hash(F.col("text")).alias("h"), F.lit(True).alias("hit")).distinct()
    hit, n = F.col("hit").isNotNull(), F.col("n")
    sums = [F.sum(n).alias("total"), F.sum(F.when(hit, n).otherwise(0)).alias("overlap"), F.sum(F.when(hit, 0).otherwise(n - 1)).alias("duplicates"), F.count_if(~hit).alias("kept")]
    return groups.join(bench, "h", "left").agg(*sums)


_KEY = r"md5(substr(regexp_replace(lower(strip_accents(coalesce(said, ''))), '[^\p{L}\p{N}]', '', 'g'), 1, 400))"


@_query(
    f"""WITH {_FACTS}, valid AS (SELECT conv_id FROM facts WHERE n_turns >= 2 AND first_role IN ('system', 'user') AND last_role = 'assistant' AND known_roles AND assistant_chars >= 20 AND total_chars <= 7000),
asked AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS said FROM conversations WHERE conv_id IN (SELECT conv_id FROM valid) GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, {_KEY} AS first_user_key, count(*) AS copies FROM asked GROUP BY first_user_key"""
)
def chat_first_user_dedup(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    key = F.md5(F.substring(letters_only(F.coalesce("said", F.lit(""))), 1, 400).cast("binary"))
    rows = valid_conversations(turns).select("conv_id").join(asked, "conv_id", "left").select("conv_id", key.alias("first_user_key"))
    return rows.groupBy("first_user_key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))


_PLAIN = r"trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))"
_LINES = r"list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda t: trim(regexp_replace(lower(strip_accents(t)), '\s+', ' ', 'g'))), lambda t: t <> ''))"


def _runs_sql(table: str, key: str, k: int = 4) -> str:
    later = ", ".join(f"lead(t, {j}) OVER o" for j in range(1, k))
    return f"""SELECT DISTINCT {key}, item FROM (
  SELECT {key}, pos, n, concat_ws(' ', t, {later}) AS item FROM (
    SELECT {key}, unnest(w) AS t, generate_subscripts(w, 1) AS pos, len(w) AS n FROM (SELECT {key}, string_split({_PLAIN}, ' ') AS w FROM {table})
  ) WINDOW o AS (PARTITION BY {key} ORDER BY pos)
) WHERE pos <= greatest(n - {k - 1}, 1) AND item <> ''"""


def _lines_sql(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, unnest({_LINES}) AS item FROM {table}"


def _pairs_sql(items: Callable[[str, str], str]) -> str:
    return f"""d AS ({items("documents", "doc_id")}), b AS ({items("benchmark", "item_id")}),
dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), bn AS (SELECT item_id, count(*) AS m FROM b GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS inter FROM d JOIN b USING (item) GROUP BY doc_id, item_id),
pairs AS (SELECT doc_id, item_id, inter, n + m - inter AS n_union FROM met JOIN dn USING (doc_id) JOIN bn USING (item_id))"""


def _shingles(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.select(key, plain_words(F.col("text")).alias("plain")).select(key, shingles(F.col("plain"), k).alias("items"))


def _shingled(spark, sf_dir, k: int = 4) -> tuple[DataFrame, DataFrame]:
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return _shingles(docs, "doc_id", k), _shingles(bench, "item_id", k)


@_query(f"WITH {_pairs_sql(_runs_sql)} SELECT * FROM pairs")
def shingle_overlap_pairs(spark, sf_dir):
    docs, bench = _shingled(spark, sf_dir)
    return shared(docs, "doc_id", bench, "item_id")


@_query(f"WITH {_pairs_sql(_runs_sql)} SELECT doc_id, item_id, inter, inter / m AS containment FROM met JOIN bn USING (item_id) WHERE inter / m >= 0.8")
def shingle_containment(spark, sf_dir):
    """Documents that hold most of a benchmark item's shingles, however long they are."""
    docs, bench = _shingled(spark, sf_dir)
    return contained(docs, "doc_id", bench, "item_id", 0.8)


SWEEP = (1.0, 0.9, 0.8, 0.7, 0.1)  # fixed values: the thresholds of a sweep, and one that this small data reaches


@_query(
    f"""WITH {_pairs_sql(_runs_sql)}, t AS (SELECT CAST(unnest({list(SWEEP)}) AS DOUBLE) AS threshold)
SELECT threshold, count(DISTINCT doc_id) AS leaked_rows, count(DISTINCT item_id) AS contaminated FROM t LEFT JOIN pairs ON inter / n_union >= threshold GROUP BY threshold"""
)
def shingle_leak_sweep(spark, sf_dir):
    docs, bench = _shingled(spark, sf_dir)
    sim = F.col("inter") / F.col("n_union")
    reached = F.filter(F.array(*map(F.lit, SWEEP)), lambda t: sim >= t)
    hits = shared(docs, "doc_id", bench, "item_id").select("doc_id", "item_id", F.explode(reached).alias("threshold"))
    every = spark.createDataFrame([(t,) for t in SWEEP], "threshold double")
    return F.broadcast(every).join(hits, "threshold", "left").groupBy("threshold").agg(F.countDistinct("doc_id").alias("leaked_rows"), F.countDistinct("item_id").alias("contaminated"))


SURE = 0.1  # of the similarities that this small data reaches


@_query(f"WITH {_pairs_sql(_runs_sql)} SELECT doc_id, item_id, inter / n_union AS jaccard FROM pairs WHERE inter / n_union >= {SURE}")
def minhash_candidates(spark, sf_dir):
    """Pairs that meet in a band of one slot among 128, verified by their exact similarity.

    At a similarity of 0.1 a pair is missed with a chance of 0.9 ** 128, about 1.4e-6.
    """
    docs, bench = _shingled(spark, sf_dir)
    return verified_candidates(docs, "doc_id", bench, "item_id", SURE)


def _options(spark, sf_dir, table: str, key: str) -> DataFrame:
    """Pieces of a text as options; a filter on them would have them cut twice."""
    return _table(spark, sf_dir, table).select(key, distinct_pieces(F.col("text"), r"[.\n]").alias("items"))


@_query(f"WITH {_pairs_sql(_lines_sql)} SELECT item_id, doc_id, inter, n_union FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY inter / n_union DESC, doc_id) = 1")
def option_best_match(spark, sf_dir):
    return best_match(shared(_options(spark, sf_dir, "documents", "doc_id"), "doc_id", _options(spark, sf_dir, "benchmark", "item_id"), "item_id"), "doc_id", "item_id")


_ASKED = ("Rispondi alla seguente domanda a scelta multipla sull'argomento '" + "prova" + DIRECT[0], DIRECT[1], DIRECT[2])
_WORDS = r"string_split(text, ' ')[1:4]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@_query(
    f"""SELECT item_id, {_quoted(_ASKED[0])} || substr('ABCD', 1, len({_WORDS})) || {_quoted(_ASKED[1])} || text || chr(10) || chr(10)
  || array_to_string(list_transform({_WORDS}, lambda w, i: substr('ABCD', i, 1) || ') ' || trim(w)), chr(10)) || {_quoted(_ASKED[2])} AS prompt FROM benchmark"""
)
def prompts_rendered(spark, sf_dir):
    options = lettered(F.slice(F.split("text", " "), 1, 4))
    return _table(spark, sf_dir, "benchmark").select("item_id", user_query(F.lit("prova"), F.col("text"), options).alias("prompt"))


_OPENINGS = ("Risposta: ", "Quindi, la risposta è ", "la risposta corretta è la lettera ", "Nessuna delle opzioni. Soluzione: ", "Opzione corretta: ", "")
_SAID = f"list_extract({list(_OPENINGS)}, 1 + CAST((conv_id + turn) % {len(_OPENINGS)} AS INTEGER)) || text"


def _letter_sql(pattern: str, flags: str) -> str:
    return f"nullif(regexp_extract(regexp_extract(said, {_quoted(f'(?{flags}){pattern}')}, 1), '[A-Z]'), '')"


_READ = f"""said AS (SELECT conv_id, turn, {_SAID} AS said FROM conversations WHERE role = 'assistant'),
read AS (SELECT *, coalesce({_letter_sql(ANNOUNCED, 's')}, CASE WHEN NOT contains(lower(said), {_quoted(NO_ANSWER)}) THEN coalesce({', '.join(_letter_sql(p, 'is') for p in PHRASES)}) END, '') AS official FROM said)"""


@_query(f"WITH {_READ} SELECT conv_id, turn, official, coalesce(nullif(official, ''), regexp_extract(said, '[A-Z]')) AS robust FROM read")
def answers_announced(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    opening = F.get(F.array(*map(F.lit, _OPENINGS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_OPENINGS))).cast("int"))
    said = F.concat(opening, F.col("text"))
    return rows.select("conv_id", "turn", announced_answer(said).alias("official"), robust_answer(said).alias("robust"))


def _judged(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(_table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT source, lang, count(*) AS n, count_if(quality = 1) AS n_right, avg(quality) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)")
def accuracy_rollup(spark, sf_dir):
    return accuracy(_judged(spark, sf_dir), F.col("quality") == 1, "source", "lang")


@_query(
    """SELECT lang, count(*) AS n, count_if(quality = 0 AND toxic = 0) AS fixed, count_if(quality = 1 AND toxic = 1) AS broke,
  100.0::DOUBLE * (count_if(quality = 0 AND toxic = 0) - count_if(quality = 1 AND toxic = 1)) / count(*) AS net_percent FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
)
def gains_by_domain(spark, sf_dir):
    return gains_by(_judged(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 0, "lang")


@_query("SELECT doc_id, count(*) OVER w AS seen, CAST(sum(quality) OVER w AS BIGINT) AS n_right FROM labels WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def accuracy_running(spark, sf_dir):
    return running_accuracy(_table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)


# Edges of cumulative coverage, after two that this small data reaches.
_REACHED = (0.3, 0.4, 0.85, 0.9, 0.95)


@_query(f"WITH {_SIMS}, e AS (SELECT CAST(unnest({list(_REACHED)}) AS DOUBLE) AS edge) SELECT edge, count(sim) AS n FROM e LEFT JOIN best ON sim >= edge GROUP BY edge")
def coverage_cumulative(spark, sf_dir):
    return cumulative_counts(_best(spark, sf_dir), "sim", _REACHED)


@_query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) <= 20")
def sample_per_source_20(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id")
    return smallest(docs, draw(7, F.col("doc_id")), [F.col("doc_id")], 20, ["source"])


@_query(f"SELECT doc_id, regexp_matches(text, {_quoted(LANGUAGE)}) AND NOT regexp_matches(text, {_quoted(FOREIGN)}) AS about_language FROM documents")
def language_rows(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", about_language(F.col("text")).alias("about_language"))


@_query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split({_PLAIN}, ' '), lambda w: length(w) >= 4 AND NOT list_contains([{', '.join(map(_quoted, FRAME_WORDS))}], w)))), ' ') AS tokens FROM benchmark")
def benchmark_content_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(content_tokens(plain_words(F.col("text")))), " ").alias("tokens"))


@_query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), z AS (SELECT *, ln(list_sum(list_transform(x, lambda y: exp(y)))) AS mass FROM v)
SELECT vec_id, round(list_sum(list_transform(x, lambda y: exp(y - mass) * (y - mass + ln(len(x))))), 6) AS kl FROM z"""
)
def kl_from_uniform(spark, sf_dir):
    log_p = log_softmax(F.col("embedding"))
    log_q = F.transform("embedding", lambda _: -F.ln(F.size("embedding")))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(reverse_kl(log_p, log_q), 6).alias("kl"))
