"""N-gram Jaccard join: prefix filters under two global orders, intersected, then verification.

Sets that are similar enough share a token among the first few of each under any order of
all tokens. Two orders are used and only pairs that meet under both are verified. Both put
rare tokens first: a sample of the tokens, chosen by hash and larger than a prefix, is
counted and leads each order by its document frequency, exactly in one and by powers of two
in the other; a set needs no list at all once its prefix is filled by tokens of its own.

A token in few prefixes pairs its sets out. Where a token crowds, its sets go to tiles, and
tiles that share crowded tokens under both orders are compared in blocks, whose pairs never
become rows. All that a comparison returns is a spanning forest of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.components import connected_components
from siftwright.llm.hashing import column_bytes, mix, pair, slices, words
from siftwright.llm.workspace import Workspace, small, unused

ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344)  # what makes each order of the tokens
CROWD = 32  # sets that have a token in their prefix; beyond, they are compared in tiles
HOT = 4096  # tokens in more rows than the total divided by this come last in both orders
HOT_LEAST = 16  # rows of an Arrow batch that have a token, for it to be counted as one
TILE = 512  # sets in a tile
TILE_TOKENS = 1 << 20  # tokens of all sets in a tile, about
PAIRS = 500  # pairs verified by a task at once
_SAMPLED, _LATE, _DOC = 0, 1, 3  # kinds of rows; _LATE + order


def shingle_sets(column: pa.Array, size: int = 3) -> Iterator[np.ndarray]:
    """Each text's distinct word shingles as sorted hashes; fewer words make one shingle."""
    data, offsets = column_bytes(column)
    hashes, _, _, counts = words(data, offsets)
    grams = hashes
    for k in range(1, size):
        grams = pair(grams[: len(hashes) - k], hashes[k:]) if len(hashes) > k else grams[:0]
    at = 0
    for n in counts.tolist():
        if n >= size:
            yield np.unique(grams[at : at + n - size + 1])
        elif n:
            whole = hashes[at : at + 1]
            for k in range(1, n):
                whole = pair(whole, hashes[at + k : at + k + 1])
            yield mix(whole ^ np.uint64(n))
        else:
            yield hashes[:0]
        at += n


def _identity(tokens: np.ndarray, half: int = 0) -> int:
    """Half of 128 bits that, with its size, tell a set from others."""
    return int(mix(tokens ^ np.uint64((0x452821E638D01377, 0xA4093822299F31D0)[half])).sum(dtype=np.uint64).astype(np.int64)) if len(tokens) else 0


def prefix_length(n: int, percent: int) -> int:
    """How many tokens two sets must look at to meet if their Jaccard is enough."""
    return n - -(-percent * n // 100) + 1


def _sampled(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Which tokens are counted: twice the share that a prefix has."""
    return mix(tokens ^ np.uint64(ORDERS[0])) < np.uint64(min(2**64 - 1, 2 * (100 - percent) * 2**64 // 100))


def _frequent(percent: int, size: int):
    """(tok, rows) of tokens that many of the task's rows have; tok is null for the number of rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [tokens[_sampled(tokens, percent)] for part in slices(batch, 0) for tokens in shingle_sets(part.column(0), size)]
            tok, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(HOT_LEAST, batch.num_rows // HOT)
            yield pa.RecordBatch.from_arrays([pa.array([None, *tok[often].astype(np.int64).tolist()], pa.int64()), pa.array(np.append(batch.num_rows, times[often]))], names=["tok", "times"])

    return emit


def _postings(percent: int, size: int, hot):
    """Rows (kind, tok, owner, mark, extra): each sampled token of a set, what a prefix may need beyond them, and a row for the document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value
        for whole in batches:
            seen: set[tuple[int, int]] = set()
            for batch in slices(whole, 1):
                kind, tok, owner, mark, extra = [], [], [], [], []

                def add(k: int, tokens: np.ndarray, own: int, n: int, more: int = 0) -> None:
                    kind.append((k, len(tokens)))
                    tok.append(tokens.astype(np.int64))
                    owner.append((own, len(tokens)))
                    mark.append((n, len(tokens)))
                    extra.append((more, len(tokens)))

                for doc, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                    n, own, rest = len(tokens), _identity(tokens), _identity(tokens, 1)
                    add(_DOC, np.array([doc], np.int64), own, n, rest)
                    if not n or (own, rest) in seen:
                        continue
                    seen.add((own, rest))
                    first = _sampled(tokens, percent)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens
                        first &= ~late
                    else:
                        late = np.zeros(n, bool)
                    many = int(first.sum())
                    add(_SAMPLED, tokens[first], own, n << 32 | many)
                    if (wanting := prefix_length(n, percent) - many) > 0:
                        for k, order in enumerate(ORDERS):
                            keys = mix(tokens ^ np.uint64(order))
                            at = np.lexsort((keys, late))
                            add(_LATE + k, tokens[at[~first[at]][:wanting]], own, n << 32)
                spread = lambda pairs, kind: np.repeat(np.array([x for x, _ in pairs], kind), [m for _, m in pairs])
                columns = [spread(kind, np.int8), np.concatenate(tok), *(spread(x, np.int64) for x in (owner, mark, extra))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "tok", "owner", "mark", "extra"])

    return emit


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _met(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared elements between the sets of two lists."""
    every = [*left, *right]
    m = len(left)
    out = np.zeros((m, len(right)), np.float32)
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    _, column = np.unique(column[order], return_inverse=True)
    owner = owner[order]
    wide = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        dense = np.zeros((len(every), wide), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        out += dense[:m] @ dense[m:].T
    return out


def _forest(pairs: Iterator[tuple]) -> list[tuple]:
    """Those pairs that join two trees: as connected as all of them, and fewer than nodes."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _compare(percent: int, size: int):
    """Links among the sets of a block: of its pairs, or between the two sides of a pair of tiles."""

    def links(docs: pd.DataFrame, pairs: pd.DataFrame) -> Iterator[tuple[bytes, bytes]]:
        sets, at, rows = [], {}, []
        texts = pa.array(docs["text"], pa.large_string())
        for i, (tokens, owner, more) in enumerate(zip(shingle_sets(texts, size), docs["owner"], docs["more"], strict=True)):
            # a doc_id may stand for several texts, and half an identity for several sets
            node = owner.to_bytes(8, "big", signed=True) + more.to_bytes(8, "big", signed=True)
            if _identity(tokens) == owner and _identity(tokens, 1) == more and (key := (node, docs["side"].iat[i])) not in at:
                at[key] = len(sets)
                sets.append(tokens)
                rows.append((i, node))
        if docs["side"].iat[0] < 0:
            by_owner: dict[int, list[int]] = {}
            for j, (i, _) in enumerate(rows):
                by_owner.setdefault(int(docs["owner"].iat[i]), []).append(j)
            for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
                for x in by_owner.get(a, ()):
                    for y in by_owner.get(b, ()):
                        if rows[x][1] != rows[y][1] and _similar(sets[x], sets[y], percent):
                            yield rows[x][1], rows[y][1]
            return
        side = np.array([docs["side"].iat[i] for i, _ in rows])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a tile against itself
        if not len(left) or not len(right):
            return
        sizes = np.array([len(x) for x in sets])
        n, m = sizes[left][:, None], sizes[right][None, :]
        near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        for name in ("crowd0", "crowd1"):  # a shared token under each order
            crowds = [np.asarray(docs[name].iat[i], np.int64) for i, _ in rows]
            near &= _met([crowds[j] for j in left], [crowds[j] for j in right]) > 0
        left, right, near = (left[k := near.any(axis=1)], right[q := near.any(axis=0)], near[np.ix_(near.any(axis=1), near.any(axis=0))])
        if not len(left):
            return
        n, m = sizes[left][:, None], sizes[right][None, :]
        both = _met([sets[j] for j in left], [sets[j] for j in right])
        for x, y in zip(*np.nonzero(near & (100 * both >= percent * (n + m - both))), strict=True):
            if rows[left[x]][1] != rows[right[y]][1]:
                yield rows[left[x]][1], rows[right[y]][1]

    def compare(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        found = _forest(links(docs, pairs)) if len(docs) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"])

    return compare


def _tile_pairs(crowded: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(owner, place): each crowded set in every pair of tiles that it takes part in.

    A tile holds sets of like size that have the same most crowded token. Two tiles are
    compared if sets of each have a crowded token in common, under each order.
    """
    level = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    rows = work.write(crowded.select("owner", "n", "crowd0", "crowd1", "home", level.alias("level")), "crowded")
    parts = rows.groupBy("home", "level").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_TOKENS)).cast("int").alias("parts"))
    rows = rows.join(parts, ["home", "level"]).withColumn("tile", F.xxhash64("home", "level", F.pmod(F.xxhash64("owner"), F.col("parts"))))
    rows = work.write(rows.select("owner", "crowd0", "crowd1", "level", "tile"), "tiled")

    def meeting(crowd: str) -> DataFrame:
        has = rows.select("tile", "level", F.explode(crowd).alias("tok")).distinct()
        other = has.select(F.col("tile").alias("tile2"), F.col("level").alias("level2"), "tok")
        near = (F.col("tile") <= F.col("tile2")) & (F.abs(F.col("level") - F.col("level2")) <= 1)
        return has.join(other, "tok").where(near).select("tile", "tile2").distinct()

    met = work.write(meeting("crowd0").join(meeting("crowd1"), ["tile", "tile2"]), "tile-pairs")
    block = F.xxhash64("tile", "tile2")

    def place(tile: str, side: int) -> DataFrame:
        own = met.where("tile = tile2" if side == 2 else "tile < tile2")
        return own.select(F.col(tile).alias("tile"), F.struct(F.lit(False).alias("paired"), block.alias("block"), F.lit(side).alias("side")).alias("place"))

    return rows.join(place("tile", 2).unionByName(place("tile", 0)).unionByName(place("tile2", 1)), "tile").select("owner", "place")


def _prefixes(postings: DataFrame, percent: int) -> DataFrame:
    """(ord, tok, owner, n): what is in each set's prefix under each order and in another set as well."""
    n = F.shiftright("mark", 32)
    counted = postings.where(F.col("kind") == _SAMPLED).withColumn("n", n)
    own = Window.partitionBy("owner", "mark")
    length = F.expr(f"n - ceil({percent} * n / 100D) + 1")
    # tokens that no other set has come first, and are known by their number alone
    left = length - (F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF)) - F.count(F.lit(1)).over(own))
    nth = [F.row_number().over(own.orderBy(*by)) for by in ((F.col("times"), F.xxhash64("tok")), (F.floor(F.log2("times")), F.xxhash64("tok", F.lit(2))))]
    chosen = counted.select("owner", "n", "tok", left.alias("left"), nth[0].alias("nth0"), nth[1].alias("nth1"))
    orders = F.filter(F.array(F.when(F.col("nth0") <= F.col("left"), 0), F.when(F.col("nth1") <= F.col("left"), 1)), lambda x: x.isNotNull())
    early = chosen.select(F.explode(orders).alias("ord"), "tok", "owner", "n")
    late = postings.where(F.col("kind").isin(_LATE, _LATE + 1)).select((F.col("kind") - _LATE).cast("int").alias("ord"), "tok", "owner", n.alias("n"))
    return early.unionByName(late)


def _sets(docs: DataFrame, percent: int, size: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, owner, more, n) of each row, and the postings (kind, tok, owner, mark, times) worth a look."""
    spark = docs.sparkSession
    often = docs.select("text").mapInArrow(_frequent(percent, size), "tok long, times long").groupBy("tok").agg(F.sum("times").alias("times"))
    often = work.write(often, "frequent")
    rows = often.where(F.col("tok").isNull()).agg(F.coalesce(F.max("times"), F.lit(0))).first()[0]
    # at most HOT times the sampled tokens of a text of average length
    hot = often.where(F.col("tok").isNotNull() & (F.col("times") >= max(HOT_LEAST, rows // HOT))).select("tok").toArrow().column(0).to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(hot.astype(np.uint64)))
    made = docs.mapInArrow(_postings(percent, size, hot), "kind byte, tok long, owner long, mark long, extra long")
    # a counted token's rows meet, and are few; all others are dealt out evenly
    deal = F.when(F.col("kind") == _SAMPLED, F.col("tok")).otherwise(F.xxhash64("kind", "tok", "owner"))
    dealt = made.withColumn("deal", deal).repartition("deal")
    once = dealt.where(F.col("kind") != _DOC).groupBy("deal", "kind", "tok", "owner", "mark").agg(F.max("extra").alias("extra"))
    times = F.count(F.lit(1)).over(Window.partitionBy("deal", "kind"))
    lists = once.withColumn("times", times).where((F.col("kind") != _SAMPLED) | (F.col("times") > 1))
    both = work.write(lists.unionByName(dealt.where(F.col("kind") == _DOC).withColumn("times", F.lit(0).cast("long"))).drop("deal"), "postings")
    own = both.where(F.col("kind") == _DOC).select(F.col("tok").alias("doc_id"), "owner", F.col("extra").alias("more"), F.col("mark").alias("n"))
    return own, both.where(F.col("kind") != _DOC)


def _node(owner: str = "owner", more: str = "more") -> Column:
    return F.concat(*(F.unhex(F.lpad(F.hex(F.col(c)), 16, "0")) for c in (owner, more)))


def set_links(read: DataFrame, percent: int, size: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows of ``read`` (doc_id, text) as sets, and links (a, b) that connect similar sets."""
    own, postings = _sets(read, percent, size, work)
    firsts = work.write(own.where("n > 0").groupBy("owner", "more", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "sets")
    prefixes = work.write(_prefixes(postings, percent), "prefixes")
    lengths = prefixes.groupBy("ord", "tok").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    prefixes = work.write(prefixes.join(lengths, ["ord", "tok"]), "lists")

    few = prefixes.where(F.col("many") <= CROWD).select("ord", "tok", "owner", "n")
    other = few.select("ord", "tok", F.col("owner").alias("b"), F.col("n").alias("m"))
    near = (F.col("owner") < F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    met = few.join(other, ["ord", "tok"]).where(near).groupBy(F.col("owner").alias("a"), "b")
    pairs = work.write(met.agg(F.bit_or(F.col("ord") + 1).alias("orders"), F.min("tok").alias("tok")), "pairs")
    crowd = [F.collect_set(F.when(F.col("ord") == k, F.col("tok"))).alias(f"crowd{k}") for k in (0, 1)]
    home = F.max(F.when(F.col("ord") == 0, F.struct("many", "tok"))).alias("home")
    crowds = work.write(prefixes.where(F.col("many") > CROWD).groupBy("owner", "n").agg(*crowd, home), "crowds")
    # a pair that met under one order may meet at a crowded token under the other
    half = pairs.where("orders < 3")
    for end in ("a", "b"):
        half = half.join(crowds.select(F.col("owner").alias(end), *(F.col(f"crowd{k}").alias(f"{end}{k}") for k in (0, 1))), end)
    half = half.where(F.when(F.col("orders") == 1, F.arrays_overlap("a1", "b1")).otherwise(F.arrays_overlap("a0", "b0")))
    # half an identity may stand for several sets
    same = firsts.groupBy("owner").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(F.col("owner").alias("a"), F.col("owner").alias("b"), F.col("owner").alias("tok"))
    chosen = pairs.where("orders = 3").select("a", "b", "tok").unionByName(half.select("a", "b", "tok")).unionByName(same)
    chosen = work.write(chosen, "candidates")
    bins = max(1, -(-chosen.count() // PAIRS))
    # pairs of a group of similar sets met at the same token, mostly
    chosen = chosen.select("a", "b", F.lit(True).alias("paired"), F.pmod(F.xxhash64("tok"), F.lit(bins)).alias("block"))

    in_pairs = chosen.select(F.explode(F.array("a", "b")).alias("owner"), F.struct("paired", "block", F.lit(-1).alias("side")).alias("place")).distinct()
    crowded = crowds.where((F.size("crowd0") > 0) & (F.size("crowd1") > 0)).withColumn("home", F.col("home.tok"))
    places = in_pairs.unionByName(_tile_pairs(crowded, percent, work)).groupBy("owner").agg(F.collect_list("place").alias("places"))
    known = firsts.select("owner", "more", F.col("first").alias("doc_id")).join(places, "owner").join(crowded.select("owner", "crowd0", "crowd1"), "owner", "left")
    known = work.write(known, "wanted")
    size_of = 40 + 16 * F.size("places") + 8 * (F.coalesce(F.size("crowd0"), F.lit(0)) + F.coalesce(F.size("crowd1"), F.lit(0)))
    texts = read.join(small(known, size_of), "doc_id").select("owner", "more", "text", "crowd0", "crowd1", F.explode("places").alias("place"))
    placed = texts.select("owner", "more", "text", "crowd0", "crowd1", "place.*")
    links = placed.groupBy("paired", "block").cogroup(chosen.groupBy("paired", "block")).applyInPandas(_compare(percent, size), "a binary, b binary")
    linked = connected_components(links, work, "links")
    return own, firsts.join(linked, _node() == F.col("node"), "left").drop("node")


def jaccard_components(docs: DataFrame, percent: int = 90, size: int = 3, name: str = "ngram-join") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document's set is its
    distinct ``size``-word shingles, or its whole sequence if it has fewer words. Documents
    link when 100 * |intersection| >= percent * |union|; component_id is the smallest doc_id
    reachable by links. Shingles are compared by 64 bits, whole sets by 128.

    Defined results: a null text, an empty one or one of white space has an empty set and
    links with nothing; a row without doc_id links with nothing and has a null component_id;
    repeated rows come back as often as they were given; rows that share a doc_id but not
    the text link by text, each under that doc_id; an empty table gives no rows. Only doc_id
    and text are read.
    """
    work = Workspace(docs.sparkSession, name)
    read = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own, sets = set_links(read, percent, size, work)
    lowest = sets.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("least"))
    grouped = sets.where((F.col("copies") > 1) | F.col("component").isNotNull()).join(lowest, "component", "left")
    grouped = work.write(grouped.select("owner", "more", F.col("n").alias("size"), F.coalesce("least", "first").alias("component_id")), "grouped")
    same = (own["owner"] == grouped["owner"]) & (own["more"] == grouped["more"]) & (own["n"] == grouped["size"])
    out = own.join(small(grouped, F.lit(40)), same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select(F.col("text").cast("string").alias("text"))
    sizes = nameless.mapInArrow(_sizes(size), "n_shingles long")
    return out.unionByName(sizes.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in shingle_sets(batch.column(0), size)], pa.int64())], names=["n_shingles"])

    return emit


#: The same rows in DuckDB.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1),
sc AS (SELECT * FROM s SEMI JOIN common USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sc a JOIN sc b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM link) UNION SELECT r.doc_id, link.b FROM r JOIN link ON r.other = link.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY 1) c USING (doc_id)
"""


def keep_one_of_each(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """``docs`` without near duplicates: of documents tied by links, the smallest doc_id.

    Defined results: as in jaccard_components; rows that link with nothing stay, also those
    without doc_id; of rows with equal doc_id and text one stays; rows that share a doc_id
    but not the text stay if one of them is to stay.
    """
    work = Workspace(docs.sparkSession, "near-duplicate-ids")
    found = jaccard_components(docs.select("doc_id", "text"), percent, size, "near-duplicates").where(F.col("doc_id").isNotNull())
    stays = F.bool_or(F.col("doc_id") == F.col("component_id"))
    id, nth = unused(docs, "__id"), unused(docs, "__nth")
    ids = work.write(found.groupBy(F.col("doc_id").alias(id)).agg(stays.alias("stays"), F.count(F.lit(1)).alias("many")).where(~F.col("stays") | (F.col("many") > 1)), "ids")
    key = docs["doc_id"].cast("long") == F.col(id)
    once = docs.join(small(ids.select(id), F.lit(16)), key, "left_anti")
    # texts meet only where an id is repeated
    repeated = docs.join(small(work.write(ids.where(F.col("stays")).select(id), "repeated"), F.lit(16)), key, "left_semi")
    same = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.xxhash64(*docs.columns))
    return once.unionByName(repeated.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).drop(nth))
