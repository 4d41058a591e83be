"""Queries of conversations chosen for training, of sources in files, and of a training step's figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions.arrays import log_softmax, reverse_kl
from siftwright.functions.tokens import chunk_means, merged, residual, sampled_kl, step_means, surrogate
from siftwright.operators.chat import Selection
from siftwright.operators.evaluation import broken_cases, mode_report
from siftwright.operators.sampling import draw, smallest
from siftwright.plans.registry import _FACTS, _KEY, _OPENINGS, _letter_sql, _query, _quoted, _table
from siftwright.functions.answers import ANNOUNCED, NO_ANSWER, PHRASES
from siftwright.sources.jsonl import numbered_lines, read_results, read_splits
from siftwright.sources.shared import Workspace

BUDGET, SEED = 30, 17
_RULES = "n_turns >= 2 AND first_role IN ('system', 'user') AND last_role = 'assistant' AND known_roles AND assistant_chars >= 20 AND total_chars <= 7000"
_UNIQUE = f"""{_FACTS}, valid AS (SELECT conv_id FROM facts WHERE {_RULES}),
asked AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS said FROM conversations WHERE conv_id IN (SELECT conv_id FROM valid) GROUP BY conv_id),
uniq AS (SELECT {_KEY} AS key, min(conv_id) AS conv_id FROM asked GROUP BY key)"""


@_query(
    f"""WITH {_UNIQUE}, chosen AS (SELECT * FROM uniq ORDER BY md5('{SEED}:' || conv_id), conv_id LIMIT {BUDGET})
SELECT conv_id, key, CAST(count(*) AS INTEGER) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS conversation FROM chosen JOIN conversations USING (conv_id) GROUP BY conv_id, key"""
)
def conversations_selected(spark, sf_dir):
    """Valid conversations, one for each first question, a budget of them drawn; their turns put together in order."""
    chosen = Selection(_table(spark, sf_dir, "conversations"), BUDGET, SEED).conversations()
    text = F.array_join(F.transform("conversation", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return chosen.select("conv_id", "key", F.size("conversation").alias("n_turns"), text.alias("conversation"))


@_query(
    f"""WITH {_UNIQUE}, n AS (SELECT count(DISTINCT conv_id) AS total, (SELECT count(*) FROM valid) AS good, (SELECT count(*) FROM uniq) AS uniq FROM conversations)
SELECT total, total - good AS invalid, good - uniq AS duplicates, uniq AS "unique", least(uniq, {BUDGET}) AS selected FROM n"""
)
def conversation_counters(spark, sf_dir):
    return Selection(_table(spark, sf_dir, "conversations"), BUDGET, SEED).counters()


_LINE = "CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 11 = 0 THEN '  ' ELSE 'row ' || doc_id END"
SCAN, CAP = 40, 15


@_query(
    f"""WITH lines AS (SELECT lang, doc_id, {_LINE} AS value FROM documents WHERE lang IS NOT NULL),
said AS (SELECT lang, value, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line FROM lines WHERE trim(value) <> '')
SELECT lang, line, value FROM said WHERE line <= {SCAN} AND line % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || value), value) <= {CAP}"""
)
def lines_sampled(spark, sf_dir):
    """A sample of each file's valid lines among its first non-blank ones; one file for each language, blank lines in between."""
    value = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.concat(F.lit("row "), F.col("doc_id").cast("string")))
    rows = _table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "doc_id", value.alias("value"))
    path = Workspace(spark, "line-files").path("lines")
    rows.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    lines = numbered_lines(spark, f"{path}/*/*.txt", SCAN).withColumn("lang", F.regexp_extract("file", "lang=([^/]*)", 1))
    valid = lines.where(F.col("line") % 7 != 0)
    return smallest(valid, draw(5, F.col("value")), [F.col("value")], CAP, ["lang"]).select("lang", "line", "value")


_PARTS = "CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE 'rest' END"


@_query(
    f"""WITH d AS (SELECT {_PARTS} AS split, doc_id FROM documents WHERE lang IS NOT NULL)
SELECT split, count(*) FILTER (doc_id % 13 <> 0) AS n, CAST(coalesce(sum(doc_id) FILTER (doc_id % 13 <> 0), 0) AS BIGINT) AS ids, count(*) FILTER (doc_id % 13 = 0) AS broken_lines, 0 AS broken_files FROM d GROUP BY split
UNION ALL SELECT 'gone', 0, 0, 0, 1"""
)
def sources_with_faults(spark, sf_dir):
    """Splits of JSON lines of which some are cut off, and one that isn't there: the rows of the others and a count of what was wrong."""
    split = F.when(F.col("doc_id") % 3 == 0, "third").otherwise("rest")
    line = F.to_json(F.struct("doc_id", "lang"))
    cut = F.when(F.col("doc_id") % 13 == 0, F.substring(line, 1, 9)).otherwise(line)
    path = Workspace(spark, "faulty").path("splits")
    _table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(split.alias("split"), cut.alias("value")).write.partitionBy("split").text(path)
    rows, warnings = read_splits(spark, {"third": f"{path}/split=third", "rest": f"{path}/split=rest", "gone": f"{path}/split=gone"}, "doc_id long, lang string")
    good = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    kinds = warnings.groupBy("split").agg(F.sum(F.when(F.col("kind") == "lines", F.col("n"))).alias("broken_lines"), F.count_if(F.col("kind") != "lines").cast("int").alias("broken_files"))
    none = F.lit(0).cast("long")
    return good.join(kinds, "split", "full").select("split", *(F.coalesce(c, none).alias(c) for c in ("n", "ids", "broken_lines")), F.coalesce("broken_files", F.lit(0)).alias("broken_files"))


# a model for each two hundred conversations, so that a file stays small however many there are
_MODEL, _MODE = "'m' || (conv_id // 200)", "CASE WHEN turn % 4 = 1 THEN 'fast' ELSE 'slow' END"
_SAID = f"list_extract({list(_OPENINGS)}, 1 + CAST((conv_id + turn) % {len(_OPENINGS)} AS INTEGER)) || text"
_RUNS = f"""runs AS (SELECT {_MODEL} AS model, {_MODE} AS mode, conv_id AS index, {_SAID} AS said, substr('ABCD', 1 + CAST(conv_id % 4 AS INTEGER), 1) AS answer FROM conversations
  WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY model, mode, index ORDER BY turn DESC) = 1),
read AS (SELECT *, coalesce({_letter_sql(ANNOUNCED, 's')}, CASE WHEN NOT contains(lower(said), {_quoted(NO_ANSWER)}) THEN coalesce({', '.join(_letter_sql(p, 'is') for p in PHRASES)}) END, '') AS announced,
  regexp_extract(said, '[A-Z]') AS capital FROM runs),
judged AS (SELECT *, CASE WHEN mode = 'fast' THEN capital ELSE announced END AS official, coalesce(nullif(announced, ''), capital) AS robust FROM read)"""


def _result_files(spark, sf_dir) -> str:
    """Result files of all runs, with records that are said twice, and files that names leave out."""
    model = F.concat(F.lit("m"), F.floor(F.col("conv_id") / 200).cast("string"))
    mode = F.when(F.col("turn") % 4 == 1, "fast").otherwise("slow")
    opening = F.get(F.array(*map(F.lit, _OPENINGS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_OPENINGS))).cast("int"))
    answer = F.get(F.array(*map(F.lit, "ABCD")), F.pmod(F.col("conv_id"), F.lit(4)).cast("int"))
    question = F.concat(F.lit("Question "), F.col("conv_id").cast("string"), F.lit("\n\nA) x\nB) y\nC) z\nD) w\n\nRisposta:"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = _table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        model.alias("model"), mode.alias("mode"), "turn", F.col("conv_id").alias("index"), F.concat(opening, F.col("text")).alias("output"), answer.alias("answer"),
        F.array(turn("system", F.lit("s")), turn("user", question)).alias("messages"),
    )
    records = F.transform(F.array_sort(F.collect_list(F.struct("turn", "index", "output", "answer", "messages"))), lambda r: F.struct(*(r[c].alias(c) for c in ("index", "output", "answer", "messages"))))
    files = said.groupBy("model", "mode").agg(records.alias("results"))
    name = F.concat(F.lit("custom_openai_"), F.col("model"), F.lit("_italic_"), F.when(F.col("mode") == "fast", "fast_").otherwise(""), F.lit("x"))
    path = Workspace(spark, "results").path("files")
    whole = files.select(name.alias("run"), F.to_json(F.struct("results")).alias("value"))
    spoiled = files.select(F.concat(name, F.lit("_checkpoint_7")).alias("run"), F.lit("{").alias("value"))
    whole.unionByName(spoiled).write.partitionBy("run").text(path)
    return f"{path}/*/*.txt"


@_query(
    f"""WITH {_RUNS} SELECT model, mode, count(*) AS n, avg(CAST(official = answer AS INTEGER)) AS official, avg(CAST(robust = answer AS INTEGER)) AS robust,
  avg(CAST(robust = '' AS INTEGER)) AS blank, avg(length(said)) AS avg_len FROM judged GROUP BY model, mode"""
)
def results_report(spark, sf_dir):
    """Evaluation from result files: a model and a mode for each file name, the last record of an index, checkpoints left out."""
    return mode_report(read_results(spark, _result_files(spark, sf_dir)))


@_query(
    f"""WITH {_RUNS}, paired AS (SELECT s.model, index, s.answer, s.said, s.robust FROM (SELECT * FROM judged WHERE mode = 'slow') s JOIN (SELECT * FROM judged WHERE mode = 'fast') f USING (model, index)
  WHERE f.robust = f.answer AND s.robust <> s.answer)
SELECT index, answer, robust AS predicted, 'A) x' AS line, substr(said, 1, 400) AS reasoning FROM paired WHERE model = 'm0' ORDER BY index LIMIT 3"""
)
def results_broken_cases(spark, sf_dir):
    """The first cases that reasoning spoiled, each with the sixth line from the end of its question."""
    return broken_cases(read_results(spark, _result_files(spark, sf_dir)), "m0", line=6)


@_query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), z AS (SELECT *, list_sum(list_transform(x, lambda y: exp(y))) AS mass FROM v),
p AS (SELECT vec_id, len(x) AS n, list_transform(x, lambda y: exp(y) / mass) AS p FROM z),
m AS (SELECT vec_id, n, list_transform(p[:n - 2], lambda q, i: q + CASE WHEN i = 4 THEN p[n] ELSE 0 END) AS m FROM p),
t AS (SELECT vec_id, ln(m[1 + vec_id % 8]) AS lp, ln(m[1 + vec_id % 8]) + ln(n - 2) AS kl, list_sum(list_transform(m, lambda q: q * (ln(q) + ln(n - 2)))) AS whole, 1 - list_sum(m) AS rest FROM m WHERE vec_id % 3 <> 0),
c AS (SELECT vec_id // 16 AS chunk, count(*) AS n, sum(lp * kl) AS loss, avg(whole) AS kl, avg(kl) AS sampled_kl, avg(rest) AS residual_mass FROM t GROUP BY chunk)
SELECT CAST(sum(n) AS BIGINT) AS tokens, round(sum(loss) / sum(n), 6) AS loss, round(sum(kl * n) / sum(n), 6) AS kl, round(sum(sampled_kl * n) / sum(n), 6) AS sampled_kl, round(sum(residual_mass * n) / sum(n), 6) AS residual_mass FROM c"""
)
def surrogate_loss(spark, sf_dir):
    """A step's surrogate loss and means: vectors stand in for a token's logits, sixteen of them are a chunk, every third is padding."""
    n, token = F.size("embedding"), (F.col("vec_id") % 8).cast("int")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", n.alias("many"), F.transform(log_softmax(F.col("embedding")), F.exp).alias("p"))
    rows = rows.withColumn("m", merged(F.col("p"), F.col("many") - 2, 3, F.col("many") - 1))
    told = rows.select(F.floor(F.col("vec_id") / 16).alias("chunk"), "vec_id", "m", F.transform("m", F.ln).alias("lp"), F.transform("m", lambda _: -F.ln(F.col("many") - 2)).alias("lq"))
    lp, lq = F.col("lp"), F.col("lq")
    chunks = chunk_means(told, "chunk", F.col("vec_id") % 3 != 0, loss=surrogate(lp, lq, token), kl=reverse_kl(lp, lq), sampled_kl=sampled_kl(lp, lq, token), residual_mass=residual(F.col("m")))
    means = step_means(chunks, "kl", "sampled_kl", "residual_mass")
    return means.select("tokens", *(F.round(c, 6).alias(c) for c in ("loss", "kl", "sampled_kl", "residual_mass")))
