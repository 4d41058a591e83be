"""Queries of prompts whose shots are drawn.

Documents stand in for a pool of questions (a text is a question, its first four words are
options, its id decides the answer), the first five benchmark items for official shots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.prompts import DIRECT, REASONED, few_shot_chat, lettered, plain_prompt
from siftwright.operators.draws import regime_draw, with_drawn_shots
from siftwright.plans.curation import _uniform_sql
from siftwright.plans.registry import _ASKED, _query, _quoted, _table
from siftwright.sources.jsonl import read_shots, write_jsonl
from siftwright.sources.shared import Workspace

_SYSTEM = "Rispondi alle domande."
_SEED, _MOST = 3, 5
_OPENING = _ASKED[0].removesuffix("prova" + DIRECT[0])
_WORDS = "string_split({t}, ' ')[1:4]"


def _asked_sql(topic: str, text: str, fast: str) -> str:
    words = _WORDS.format(t=text)
    letters, lines = f"substr('ABCD', 1, len({words}))", f"array_to_string(list_transform({words}, lambda w, i: substr('ABCD', i, 1) || ') ' || trim(w)), chr(10))"

    def form(parts: tuple[str, str, str]) -> str:
        return f"{_quoted(_OPENING)} || {topic} || {_quoted(parts[0])} || {letters} || {_quoted(parts[1])} || {text} || chr(10) || chr(10) || {lines} || {_quoted(parts[2])}"

    return f"CASE WHEN {fast} THEN {form(DIRECT)} ELSE {form(REASONED)} END"


def _place_sql(i: int) -> str:
    u = f"CAST('0x' || substr(md5('{_SEED}:shot:{i}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
    return f"CAST(floor({u} * (n - m + {i + 1})) AS BIGINT)"


def _floyd_sql() -> str:
    """Tables s0, s1, ... that each add one place to the list."""
    steps = [f"s0 AS (SELECT *, [{_place_sql(0)}] AS s FROM m)"]
    for i in range(1, _MOST + 1):
        added = f"list_append(s, CASE WHEN list_contains(s, {_place_sql(i)}) THEN n - m + {i} ELSE {_place_sql(i)} END)"
        steps.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN m > {i} THEN {added} ELSE s END AS s) FROM s{i - 1})")
    return ", ".join(steps)


_ANSWER = "substr('ABCD', 1 + CAST({i} % 4 AS INTEGER), 1)"
_DRAWN = f"""d AS (
  SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n, {_uniform_sql('regime')} AS u, {_uniform_sql('shots')} AS k, {_uniform_sql('form')} >= 0.25 AS fast FROM documents
  WHERE text IS NOT NULL AND lang IS NOT NULL
), r AS (SELECT *, CASE WHEN u < 0.5 THEN 'official' WHEN u < 0.75 THEN 'pool' ELSE 'zero' END AS regime, CAST(1 + floor(k * {_MOST}) AS BIGINT) AS many FROM d),
m AS (SELECT doc_id, fast, pos, n, many, least(many + 1, n) AS m FROM r WHERE regime = 'pool'), {_floyd_sql()},
drawn AS (SELECT doc_id, fast, list_filter(s, lambda p: p <> pos)[1:many] AS places FROM s{_MOST}),
each AS (SELECT doc_id, fast, unnest(places) AS pos, generate_subscripts(places, 1) AS nth FROM drawn)"""


def _pool(spark, sf_dir) -> DataFrame:
    answer = F.get(F.array(*map(F.lit, "ABCD")), F.pmod(F.col("doc_id"), F.lit(4)).cast("int"))
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    return docs.select("doc_id", F.col("lang").alias("topic"), F.col("text").alias("question"), lettered(F.slice(F.split("text", " "), 1, 4)).alias("options"), answer.alias("answer"))


def _drawn(spark, sf_dir) -> DataFrame:
    rows = regime_draw(_pool(spark, sf_dir), "doc_id", seed=_SEED, reasoned=0.25, most=_MOST)
    return with_drawn_shots(rows, "doc_id", F.when(F.col("regime") == "pool", F.col("shots")), ["doc_id", "topic", "question", "options", "answer"], _SEED)


@_query(f"WITH {_DRAWN} SELECT each.doc_id, CAST(nth AS INTEGER) AS nth, d.doc_id AS shot_id FROM each JOIN d ON each.pos = d.pos")
def shots_drawn(spark, sf_dir):
    """Which rows a few-shot prompt of the pool regime shows, in order; places are drawn, no pool is carried around."""
    each = _drawn(spark, sf_dir).select("doc_id", F.posexplode("drawn").alias("at", "shot"))
    return each.select("doc_id", (F.col("at") + 1).alias("nth"), F.col("shot.doc_id").alias("shot_id"))


def _official(spark, sf_dir) -> Column:
    """Five shots, written and read in the layout of official ones, as one constant."""
    maps = F.transform(F.slice(F.split("text", " "), 1, 4), lambda w, i: F.create_map(F.get(F.array(*map(F.lit, "ABCD")), i), F.trim(w)))
    five = _table(spark, sf_dir, "benchmark").where("text IS NOT NULL").orderBy("item_id").limit(5)
    path = Workspace(spark, "official-shots").path("5_shots.jsonl")
    write_jsonl(five.coalesce(1).select(F.col("text").alias("question"), maps.alias("options"), F.get(F.array(*map(F.lit, "ABCD")), F.pmod(F.col("item_id"), F.lit(4)).cast("int")).alias("answer"), F.lit("prova").alias("category")), path)
    shots = read_shots(spark, path).select(F.col("category").alias("topic"), "question", "options", "answer").collect()

    def constant(s) -> Column:
        options = [F.struct(F.lit(o["letter"]).alias("letter"), F.lit(o["text"]).alias("text")) for o in s["options"]]
        return F.struct(F.lit(s["topic"]).alias("topic"), F.lit(s["question"]).alias("question"), F.array(*options).alias("options"), F.lit(s["answer"]).alias("answer"))

    return F.array(*map(constant, shots))


_NEXT = "chr(10) || chr(10)"


@_query(
    f"""WITH {_DRAWN}, five AS (SELECT item_id, text FROM benchmark WHERE text IS NOT NULL ORDER BY item_id LIMIT 5),
official AS (
  SELECT f AS fast, string_agg({_asked_sql("'prova'", "text", "f")} || {_NEXT} || {_ANSWER.format(i="item_id")}, {_NEXT} ORDER BY item_id) AS shots FROM five, (SELECT unnest([true, false]) AS f) GROUP BY f
), pooled AS (
  SELECT each.doc_id, string_agg({_asked_sql("x.lang", "x.text", "each.fast")} || {_NEXT} || {_ANSWER.format(i="x.doc_id")}, {_NEXT} ORDER BY nth) AS shots, count(*) AS many FROM each JOIN d x ON each.pos = x.pos GROUP BY each.doc_id
), said AS (
  SELECT r.doc_id, r.regime, r.fast, CAST(2 + 2 * CASE r.regime WHEN 'official' THEN 5 WHEN 'pool' THEN coalesce(p.many, 0) ELSE 0 END AS INTEGER) AS n_turns,
    CASE r.regime WHEN 'official' THEN o.shots WHEN 'pool' THEN p.shots END AS shots, {_asked_sql("r.lang", "r.text", "r.fast")} AS question
  FROM r JOIN official o ON o.fast = r.fast LEFT JOIN pooled p USING (doc_id)
) SELECT doc_id, regime, fast, n_turns, md5({_quoted(_SYSTEM)} || {_NEXT} || coalesce(shots || {_NEXT}, '') || question || chr(10)) AS prompt_md5 FROM said"""
)
def prompts_drawn(spark, sf_dir):
    """Whole prompts of all regimes in both forms, told by a digest: official shots from a file, drawn ones, none."""
    rows, official = _drawn(spark, sf_dir), _official(spark, sf_dir)
    plain = F.transform("drawn", lambda s: F.struct(s["topic"].alias("topic"), s["question"].alias("question"), s["options"].alias("options"), s["answer"].alias("answer")))
    shots = F.when(F.col("regime") == "official", official).otherwise(plain)
    chat = few_shot_chat(F.lit(_SYSTEM), shots, F.struct("topic", "question", "options", "answer"), F.col("fast"))
    out = rows.select("doc_id", "regime", "fast", chat.alias("chat"))
    return out.select("doc_id", "regime", "fast", F.size("chat").alias("n_turns"), F.md5(plain_prompt(F.col("chat")).cast("binary")).alias("prompt_md5"))
