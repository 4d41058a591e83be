"""Embedding near-dedup: tiles of vectors compared in the order of principal components.

Equal vectors of a label are one class first, so copies are never compared with each other.
Classes are rotated to their principal components and put into tiles of nearby vectors. Two
tiles are compared only if their boxes are close enough. A comparison adds up the leading
components, bounds the rest by the product of the suffix norms, and stops for all pairs
that cannot reach the threshold; what is left is decided by the cosine of the vectors as
they are. A comparison returns how many links each class has and a spanning forest of
them, never the pairs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.components import connected_components
from siftwright.llm.workspace import Workspace, small

THRESHOLD = 0.98
TILE = 1024  # classes
CELL_BITS = 12  # leading components whose sides of zero tell a class's cell, at most
_STEPS = (8, 16, 32, 64, 128, 256, 512)  # components after which a comparison stops early
_SLACK = 1e-9  # above what rounding in the bounds can lose
_PAIRS = 1 << 16  # cosines computed at once
HOT = 1 << 20  # rows of a class that are never brought to one task
MEET = 256  # tiles of a part whose boxes are held against those of another in one task, about
_NEIGHBOURS = 8  # tasks that share the comparisons of one tile
_CLASS = ["__k1", "__k2"]
_WORLD = "__label long, __dim int"


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column of one length as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of outer products of a task's unit vectors, one row for each length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims):
            x = _units(_vectors(batch.column(1).filter(pa.array(dims == d))))
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=["__dim", "m"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """The axes of each vector length by falling variance, over all classes.

    Tasks send d x d sums, which are added up by position before the driver sees them.
    """
    parts = classes.select("__dim", "__v").mapInArrow(_moments, "__dim int, m array<double>")
    sums = parts.select("__dim", F.posexplode("m")).groupBy("__dim", "pos").agg(F.sum("col").alias("m")).toPandas()
    axes = {}
    for dim, rows in sums.groupby("__dim"):
        square = np.zeros(dim * dim)
        square[rows["pos"].to_numpy()] = rows["m"].to_numpy()
        axes[int(dim)] = np.linalg.eigh(square.reshape(dim, dim))[1][:, ::-1].copy()
    return axes


def _rotate(axes: dict[int, np.ndarray]):
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("__dim").to_numpy()
            cell = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                lead = _units(_vectors(batch.column("__v").take(pa.array(own)))) @ axes[int(d)][:, :CELL_BITS]
                cell[own] = (lead > 0) @ (1 << np.arange(lead.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "__cell"])

    return rotate


def _store_tile(folder: str, axes: dict[int, np.ndarray]):
    def store_tile(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors = _vectors(table.column("__v").combine_chunks())
        rotated = _units(vectors) @ axes[int(key[1].as_py())]
        order = np.argsort(-rotated[:, 0], kind="stable")
        held = BytesIO()
        np.savez(held, id=table.column("__id").to_numpy()[order], key=table.column("__key").to_numpy()[order], many=table.column("__many").to_numpy()[order], vectors=vectors[order], rotated=rotated[order])
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # a task that runs again stores another file
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(held.getbuffer())
        lead = rotated[:, :CELL_BITS]
        return pa.table({"__label": [key[0].as_py()], "__dim": [key[1].as_py()], "tile": [name], "lo": [lead.min(axis=0)], "hi": [lead.max(axis=0)]}, schema=pa.schema([("__label", pa.int64()), ("__dim", pa.int32()), ("tile", pa.string()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

    return store_tile


def candidates(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rotated unit rows whose product may reach the threshold."""
    d = a.shape[1]
    steps = [s for s in _STEPS if s < d] + [d]
    dot = a[:, : steps[0]] @ b[:, : steps[0]].T
    i = j = None
    for n, upto in enumerate(steps):
        rest_a, rest_b = (np.sqrt((x[:, upto:] ** 2).sum(axis=1)) for x in (a, b))
        if n == 0:
            i, j = np.nonzero(dot + np.outer(rest_a, rest_b) >= threshold - _SLACK)
            value = dot[i, j]
        else:
            lo = steps[n - 1]
            for at in range(0, len(i), _PAIRS):
                cut = slice(at, at + _PAIRS)
                value[cut] += np.einsum("ij,ij->i", a[i[cut], lo:upto], b[j[cut], lo:upto])
            live = value + rest_a[i] * rest_b[j] >= threshold - _SLACK
            i, j, value = i[live], j[live], value[live]
        if not len(i):
            break
    return i, j


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    sa, sb = (x / np.abs(x).max(axis=1, keepdims=True) if np.abs(x).max(initial=1) > 1e100 or np.abs(x).max(axis=1, initial=1).min(initial=1) < 1e-100 else x for x in (a, b))
    na, nb = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (sa, sb))
    for at in range(0, len(i), _PAIRS):
        p, q = i[at : at + _PAIRS], j[at : at + _PAIRS]
        out[at : at + _PAIRS] = np.einsum("ij,ij->i", sa[p], sb[q]) / (na[p] * nb[q])
    return out


def _forest(edges_a: np.ndarray, edges_b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of a graph of n nodes, as (node, least node of its component)."""
    from_root = np.arange(n)
    while True:
        least = from_root.copy()
        np.minimum.at(least, edges_a, from_root[edges_b])
        np.minimum.at(least, edges_b, from_root[edges_a])
        least = least[least]
        if (least == from_root).all():
            break
        from_root = least
    return [(int(x), int(from_root[x])) for x in np.flatnonzero(from_root != np.arange(n))]


def _compare(folder: str, threshold: float):
    """Rows (id, key, links, other): links counted for a class, or an edge to another id."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)

        def load(name: str) -> dict[str, np.ndarray]:
            with store.open_input_file(f"{root}/{name}") as f, np.load(BytesIO(f.read())) as z:
                return {k: z[k] for k in z.files}

        last, one = None, {}
        for batch in batches:
            for name, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != last:
                    last, one = name, load(name)
                two = one if other == name else load(other)
                i, j = candidates(one["rotated"], two["rotated"], threshold)
                if other == name:
                    i, j = i[i < j], j[i < j]
                sure = cosines(one["vectors"], two["vectors"], i, j) >= threshold
                i, j = i[sure], j[sure]
                ids, keys, links, to = [], [], [], []
                if len(i):
                    for side, mine, theirs, at in ((one, i, j, two), (two, j, i, one)):
                        n = np.zeros(len(side["id"]), np.int64)
                        np.add.at(n, mine, at["many"][theirs])
                        hit = np.flatnonzero(n)
                        ids.append(side["id"][hit])
                        keys.append(side["key"][hit])
                        links.append(n[hit])
                        to.append(np.zeros(len(hit), np.int64))
                    shift = 0 if other == name else len(one["id"])
                    both = one["id"] if other == name else np.concatenate([one["id"], two["id"]])
                    edges = np.array(_forest(i, j + shift, len(both)), np.int64).reshape(-1, 2)
                    ids.append(both[edges[:, 0]])
                    keys.append(np.zeros(len(edges), np.int64))
                    links.append(np.zeros(len(edges), np.int64))
                    to.append(both[edges[:, 1]])
                columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (ids, keys, links, to)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["id", "key", "links", "other"])

    return compare


def _of_each_row(rows: DataFrame, result: DataFrame) -> DataFrame:
    """rows with the columns of their class in result, null where it isn't listed.

    Classes of many rows are few, so they go to the rows; the rest are joined by a shuffle,
    from which rows without a class are kept out.
    """
    every = small(result, F.lit(48))
    if every is not result:
        return rows.join(every, _CLASS, "left")
    hot = small(result.where(F.col("many") >= HOT), F.lit(48))
    rest = rows.where(F.col("__k1").isNotNull()).join(hot, _CLASS, "left_anti").join(result.where(F.col("many") < HOT), _CLASS, "left")
    none = rows.where(F.col("__k1").isNull())
    for f in (f for f in result.schema.fields if f.name not in _CLASS):
        none = none.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rest.unionByName(rows.join(hot, _CLASS)).unionByName(none)


def _comparable(vector: Column) -> Column:
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows link when their labels are equal and their cosine in double precision is at least
    threshold. Defined results: a null label, a null vector, one without components, one of
    zeros only, and one with a null or non-finite component link with nothing, and neither
    does a row without vec_id; vectors of different lengths don't link; labels that aren't whole
    numbers are told apart by a 64-bit hash. Rows that share a
    vec_id are rows of their own for n_links and one node for component_id. kept is whether
    component_id is the row's own id (true for null). An empty table gives no rows; other
    columns aren't read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embedding-dedup")
    folder = work.path("tiles")
    folder = folder if ":" in folder.split("/")[0] else os.path.abspath(folder)
    v = F.col("embedding").cast("array<double>")
    number = vectors.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if number else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("__label"), v.alias("__v"))
    able = F.col("vec_id").isNotNull() & F.col("__label").isNotNull() & _comparable(F.col("__v"))
    # adding zero makes a negative zero an ordinary one
    whole = whole.withColumn("__v", F.when(able, F.transform("__v", lambda x: x + F.lit(0.0))))
    # a class is told by 128 bits, and numbered once it is written
    whole = whole.withColumn("__k1", F.when(able, F.xxhash64("__label", "__v"))).withColumn("__k2", F.when(able, F.xxhash64(F.lit(1), "__label", "__v")))
    per_class = whole.where(able).groupBy(*_CLASS).agg(F.min("vec_id").alias("__id"), F.count(F.lit(1)).alias("__many"), F.first("__label").alias("__label"), F.first("__v").alias("__v"))
    classes = work.write(per_class.withColumn("__key", F.monotonically_increasing_id()).withColumn("__dim", F.size("__v")), "classes")
    axes = principal_axes(classes)
    names = "__key long, __id long, __many long, __label long, __v array<double>, __dim int"
    placed = work.write(classes.select("__key", "__id", "__many", "__label", "__v", "__dim").mapInArrow(_rotate(axes), f"{names}, __cell int"), "placed")
    # a label has about as many cells as it fills tiles, so that few classes are one tile
    per_label = placed.groupBy("__label", "__dim").agg(F.floor(F.greatest(F.lit(0.0), F.log2(F.count(F.lit(1)) / tile))).cast("int").alias("__bits"))
    placed = placed.join(per_label, ["__label", "__dim"]).withColumn("__cell", F.col("__cell").bitwiseAND(F.expr("shiftleft(1, least(__bits, %d)) - 1" % CELL_BITS))).drop("__bits")
    sizes = placed.groupBy("__label", "__dim", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    # a cell of many classes is as many tiles as it takes
    dealt = placed.join(sizes, ["__label", "__dim", "__cell"]).withColumn("__part", F.pmod(F.col("__key"), F.ceil(F.col("__n") / tile)).cast("int"))
    dealt = dealt.select("__key", "__id", "__many", "__label", "__v", "__dim", "__cell", "__part")
    stored = dealt.groupBy("__label", "__dim", "__cell", "__part").applyInArrow(_store_tile(folder, axes), f"{_WORLD}, tile string, lo array<double>, hi array<double>")
    tiles = work.write(stored, "tile-list")
    # a label's tiles are cut into parts, and each two parts meet under a key of their own
    parts = work.write(tiles.groupBy("__label", "__dim").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts")), "parts")
    own = tiles.join(small(parts, F.lit(12)), ["__label", "__dim"]).withColumn("part", F.pmod(F.xxhash64("tile"), F.col("parts")).cast("int"))
    each = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"p": F.least("part", "with"), "q": F.greatest("part", "with")})
    each = each.select("__label", "__dim", "p", "q", "part", "tile", "lo", "hi")
    other = each.withColumnsRenamed({"part": "part2", "tile": "tile2", "lo": "lo2", "hi": "hi2"})
    once = (F.col("tile") <= F.col("tile2")) & ((F.col("p") == F.col("q")) | (F.col("part") != F.col("part2")))
    gaps = F.transform(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda x: F.greatest(x["lo"] - x["hi2"], x["lo2"] - x["hi"], F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    near = each.join(other, ["__label", "__dim", "p", "q"]).where(once & (apart <= 2 - 2 * threshold + _SLACK))
    n_tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a task reads a tile once for all its comparisons
    dealt = near.select("tile", "tile2").repartition(n_tasks, "tile", F.pmod(F.xxhash64("tile2"), F.lit(_NEIGHBOURS))).sortWithinPartitions("tile")
    found = work.write(dealt.mapInArrow(_compare(folder, threshold), "id long, key long, links long, other long"), "found")
    links = found.where(F.col("links") > 0).groupBy(F.col("key").alias("__key")).agg(F.sum("links").alias("__links"))
    edges = found.where(F.col("links") == 0).select(F.col("id").alias("a"), F.col("other").alias("b"))
    parts = connected_components(edges, work)
    known = classes.join(links, "__key", "left").join(parts, classes["__id"] == parts["node"], "left")
    known = known.where((F.col("__many") > 1) | F.col("__links").isNotNull() | F.col("component").isNotNull())
    links_of = (F.coalesce("__links", F.lit(0)) + F.col("__many") - 1).alias("n_links")
    result = work.write(known.select(*_CLASS, F.col("__many").alias("many"), links_of, F.coalesce("component", "__id").alias("component")), "result")
    out = _of_each_row(whole.select("vec_id", *_CLASS), result)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: near_duplicates over the table ``embeddings``; linked classes by a recursive walk.
SQL = f"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {THRESHOLD}
), walk AS (
  SELECT DISTINCT x AS node, x AS here FROM links
  UNION
  SELECT w.node, l.y FROM walk w JOIN links l ON w.here = l.x
), least AS (SELECT node, min(here) AS component_id FROM walk GROUP BY 1),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = node LEFT JOIN counts ON e.vec_id = x
"""
