"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are one class with a weight. k-means (fitted on a bounded, documented
sample, ``max_fit`` classes) gives every class a home cell, and cells are cut into blocks: one row
a block, which holds its vectors end to end. For x at home in cell a and y at home in cell c, the plane of
equal products with both centres parts x from y, so the angles of x and y to that plane add up to no more than
the angle between x and y. A pair of blocks is multiplied where the smallest of these angles leave room for a link,
and of each vector only with those that its own angle leaves, so every link is found once, in any number of dimensions.
``sigmas`` is a narrower search for those who accept lost links: of x and y one must lie within the plane's reach,
where directions not aimed at c stay within ``sigmas`` times |a - c| sqrt((1 - s^2) / (d - 1)) / s, which
vectors that vary along few directions do not keep to.

Blocks meet in a Cartesian product of a table of few wide rows, which reads the blocks of the other side again and shuffles
none; links are counted inside a product, and only counts and a spanning forest come out. Vectors of many
directions cluster badly: most pairs of blocks are multiplied there, so time grows with the square, memory and disk do not.

Products are taken in single precision; where its rounding could decide, in double.

Vectors of one length have cells of their own; those of different lengths are never compared.

Defined results: a vector that is null, zero, or holds null or non-finite components
links with nothing and is its own component; vec_id may repeat
(rows of their own) and be null. An empty table gives no rows. Labels and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.graph import components
from tickloom.llm.skew import lookup
from tickloom.llm.store import prepare, stored
from tickloom.llm.words import column

CELL = 2_000  # classes a cell should hold
BLOCK = 4_096  # classes a block should hold, and bytes of their vectors
BLOCK_BYTES = 4 << 20
BLOCKS_A_FILE = 8
TILE = 256
MAX_FIT = 50_000
MAX_CELLS = 4_096
TURNS = 5
# Angles are compared with this much to spare, far beyond their rounding.
SPARE = 1e-6


def matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    """Rows of packed components, all of one length and none null."""
    data = b"".join(x.as_buffer() for x in vectors)
    return np.frombuffer(data, kind).reshape(len(vectors), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of float64 scaled to length one."""
    m = scaled(m)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def scaled(m: np.ndarray) -> np.ndarray:
    """Scaling to the largest component keeps the square sum of tiny or huge ones in range."""
    m = m.astype(float)
    return m / np.abs(m).max(axis=1, keepdims=True) + 0.0


def packed_vectors(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """``vec_id, key, vec`` and the kind of number in ``vec``: packed components and the digest of the scaled ones.

    Both are null where the vector links with nothing.
    """
    single = isinstance(rows.schema[embedding].dataType, T.ArrayType) and isinstance(rows.schema[embedding].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    source = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(embedding) if single else F.col(embedding).cast("array<double>")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = column(batch, "e")
            known = e.is_valid().to_numpy(zero_copy_only=False)
            offsets, values = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False).astype(kind)  # null: NaN
            size = np.where(known, np.diff(offsets), 0)
            keys: list[bytes | None] = [None] * len(e)
            vecs: list[bytes | None] = [None] * len(e)
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                m = values[offsets[at][:, None] + np.arange(n)]
                good = np.isfinite(m).all(1) & m.any(1)
                at, m = at[good], m[good]
                if len(at):
                    for i, raw, s in zip(at, m, scaled(m)):
                        keys[i], vecs[i] = hashlib.sha256(s.astype("<f8").tobytes()).digest(), raw.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    return source.mapInArrow(run, "vec_id long, key binary, vec binary"), kind


def fit_centres(sample: DataFrame, kind: str, k: int, turns: int = TURNS) -> np.ndarray:
    """Spherical k-means by Lloyd's steps over the sample; the sums of each task combine in Spark."""
    start = [bytes(r["vec"]) for r in sample.orderBy(F.xxhash64("vec", F.lit(2))).limit(k).collect()]
    centres = unit(matrix(pa.array(start, pa.binary()), kind))
    for _ in range(turns):
        sent = sample.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            total = np.zeros_like(c)
            for batch in batches:
                if batch.num_rows:
                    m = unit(matrix(column(batch, "vec"), kind))
                    np.add.at(total, (m @ c.T).argmax(1), m)
            used = np.flatnonzero(np.abs(total).sum(1))
            cell, dim = np.repeat(used, c.shape[1]), np.tile(np.arange(c.shape[1]), len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(total[used].ravel())], names=["cell", "dim", "x"]
            )

        moved = sample.mapInArrow(sums, "cell int, dim int, x double").groupBy("cell", "dim").agg(F.sum("x").alias("x")).toPandas()
        fresh = np.zeros_like(centres)
        fresh[moved.cell, moved.dim] = moved.x
        norm = np.linalg.norm(fresh, axis=1, keepdims=True)
        centres = np.where(norm > 0, fresh / np.where(norm > 0, norm, 1), centres)
        sent.destroy()
    return centres


@dataclass(frozen=True)
class Cells:
    """The cells of the vectors of one length: the number of the first, their centres (None: one cell), and blocks of each."""

    first: int
    centres: np.ndarray | None
    blocks: np.ndarray

    def home(self, m: np.ndarray) -> np.ndarray:
        return np.zeros(len(m), np.int64) if self.centres is None else (unit(m) @ self.centres.T).argmax(1)

    def normals(self, cell: int, others: slice | int = slice(None)) -> np.ndarray:
        """Unit normals of the planes between the cell and the others, towards the cell; zero where centres are equal."""
        apart = self.centres[cell] - self.centres[others]
        norm = np.linalg.norm(apart, axis=-1, keepdims=True)
        return apart / np.where(norm > 0, norm, 1)


def all_cells(packed: DataFrame, kind: str, cell: int, max_fit: int = MAX_FIT) -> dict[int, Cells]:
    """The cells of each length of vectors; lengths of few classes are one cell, without centres."""
    width = np.dtype(kind).itemsize
    known = packed.where(F.col("key").isNotNull()).withColumn("size", (F.octet_length("vec") / width).cast("int"))
    out, first = {}, 0
    # One row for each length of vector.
    for size, n in sorted((r["size"], r["n"]) for r in known.groupBy("size").agg(F.count("*").alias("n")).collect()):
        block = max(1, min(BLOCK, BLOCK_BYTES // (size * width)))
        centres, counts = None, np.array([n])
        if n > cell:
            share = min(1.0, max_fit / n)
            chosen = known.where((F.col("size") == size) & (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) <= int(share * (1 << 30))))
            sample = stored(chosen.groupBy("key").agg(F.first("vec").alias("vec")).select("vec"), "fit-sample")
            classes = math.ceil(sample.count() / share)
            counts = np.array([classes])
            if classes > cell:
                centres = fit_centres(sample, kind, min(MAX_CELLS, -(-classes // cell)))
                counts = _homes(sample, kind, centres) / share
        out[size] = Cells(first, centres, np.maximum(1, np.ceil(counts / block)).astype(np.int64))
        first += len(counts)
    return out


def _homes(sample: DataFrame, kind: str, centres: np.ndarray) -> np.ndarray:
    cells = Cells(0, centres, np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, n = np.unique(cells.home(matrix(column(batch, "vec"), kind)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(n, pa.int64())], names=["home", "n"])

    out = np.zeros(len(centres))
    for r in sample.mapInArrow(run, "home long, n long").groupBy("home").agg(F.sum("n").alias("n")).collect():
        out[r["home"]] = r["n"]
    return out


def _merged(table: pa.Table, total: str | None) -> tuple[pa.Table, pa.Array]:
    """Rows of one ``key`` as one (``key, weight, lowest``), and the place of a row of each."""
    table = table.append_column("place", pa.array(np.arange(table.num_rows)))
    if total is None:
        table, total = table.append_column("weight", pa.array(np.ones(table.num_rows, np.int64))), "weight"
    out = table.group_by("key", use_threads=False).aggregate([(total, "sum"), ("lowest", "min"), ("place", "min")])
    facts = out.select(["key", f"{total}_sum", "lowest_min"]).rename_columns(["key", "weight", "lowest"]).combine_chunks()
    return facts, out["place_min"].combine_chunks()


def dealt(packed: DataFrame, kind: str, cells: Broadcast) -> DataFrame:
    """``cell, block, size, key, weight, lowest, vec``: equal vectors of a batch are one row."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            facts, place = _merged(pa.table({"key": column(batch, "key"), "lowest": column(batch, "vec_id")}), None)
            vecs = column(batch, "vec").take(place)
            keys = np.frombuffer(b"".join(x.as_buffer()[:8] for x in facts["key"].combine_chunks()), "<u8")
            size = np.array([len(x.as_buffer()) // width for x in vecs])
            cell, block = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size):
                own, at = cells.value[int(n)], np.flatnonzero(size == n)
                home = own.home(matrix(vecs.take(pa.array(at)), kind))
                cell[at], block[at] = home + own.first, keys[at] % own.blocks[home].astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(block), pa.array(size.astype(np.int64)), *(facts[c].combine_chunks() for c in ("key", "weight", "lowest")), vecs],
                names=["cell", "block", "size", "key", "weight", "lowest", "vec"],
            )

    known = packed.where(F.col("key").isNotNull())
    return known.mapInArrow(run, "cell long, block long, size long, key binary, weight long, lowest long, vec binary")


def in_blocks(rows: DataFrame, kind: str, cells: Broadcast) -> DataFrame:
    """One row a block: ``id, cell, first, size, near, vecs, weights, keys, lowest``.

    ``near`` has the smallest angle of its vectors to the plane between their cell and each cell of their length.
    """

    def run(table: pa.Table) -> pa.Table:
        cell, block, size = (table[c][0].as_py() for c in ("cell", "block", "size"))
        facts, place = _merged(table.select(["key", "weight", "lowest"]).combine_chunks(), "weight")
        m = matrix(table["vec"].combine_chunks().take(place), kind)
        own = cells.value[size]
        near = [0.0] if own.centres is None else _angles(unit(m), own.normals(cell - own.first)).min(0).tolist()
        row = {"id": cell << 20 | block, "cell": cell, "first": own.first, "size": size, "near": near, "vecs": m.tobytes()}
        row |= {"weights": facts["weight"].to_numpy(), "keys": facts["key"].to_pylist(), "lowest": facts["lowest"].to_pylist()}
        return pa.Table.from_pydict({c: [v] for c, v in row.items()}, schema)

    lists = {"weights": pa.int64(), "keys": pa.binary(), "lowest": pa.int64()}
    schema = pa.schema(
        [("id", pa.int64()), ("cell", pa.int64()), ("first", pa.int64()), ("size", pa.int64()), ("near", pa.list_(pa.float64())), ("vecs", pa.binary())]
        + [(c, pa.list_(kind)) for c, kind in lists.items()]
    )
    shape = "id long, cell long, first long, size long, near array<double>, vecs binary, weights array<long>, keys array<binary>, lowest array<long>"
    # Small files, each some blocks: what a task of the product reads at once.
    files = -(-sum(int(own.blocks.sum()) for own in cells.value.values()) // BLOCKS_A_FILE)
    return rows.repartition(files, "cell", "block").groupBy("cell", "block").applyInArrow(run, shape)


def _angles(units: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Angles of rows to planes, negative beyond them."""
    return np.arcsin(np.clip(units @ normals.T, -1, 1))


def linked(blocks: DataFrame, kind: str, cells: Broadcast, threshold: float, sigmas: float | None) -> DataFrame:
    """``cls, degree, root``: the weight of linked classes found in one product, and the class's root there."""
    widest = math.acos(min(1.0, max(-1.0, threshold))) + SPARE

    def product(left: dict, right: dict) -> pa.Table | None:
        own = cells.value[left["size"]]
        a, b = left["unit"], right["unit"]
        one, ax, ay = left["cell"] == right["cell"], np.zeros(len(a)), np.zeros(len(b))
        if not one:
            normal = own.normals(left["cell"] - own.first, right["cell"] - own.first)
            ax, ay = _angles(a, normal), _angles(b, -normal)
        rows, columns = np.argsort(ax, kind="stable"), np.argsort(ay, kind="stable")
        rows = rows[ax[rows] <= widest - ay.min()]
        columns = columns[ay[columns] <= widest - ax.min()]
        ay_sorted = ay[columns]
        reach = math.inf
        if sigmas is not None and not one:
            half = math.sqrt(max(0.0, 1 - threshold) / 2)
            reach = math.asin(min(1.0, half, sigmas * math.sqrt(max(0.0, 1 - threshold**2) / max(1, a.shape[1] - 1)) / threshold)) + SPARE
        a32, b32 = a[rows].astype(np.float32), b[columns].astype(np.float32)
        # Beyond what single precision can round away in a product of unit vectors.
        unsure = (a.shape[1] + 8) * 2.0**-23
        near = None
        for t in range(0, len(rows), TILE):
            some = rows[t : t + TILE]
            upto = int(np.searchsorted(ay_sorted, widest - ax[some[0]], side="right"))
            s = a32[t : t + TILE] @ b32[:upto].T
            hit = s >= threshold - unsure
            if not hit.any():
                continue
            doubt = hit & (s <= threshold + unsure)
            if doubt.any():
                r, c = np.flatnonzero(doubt.any(1)), np.flatnonzero(doubt.any(0))
                exact = a[some[r]] @ b[columns[c]].T >= threshold
                cut = np.ix_(r, c)
                hit[cut] &= ~doubt[cut] | exact
            if math.isfinite(reach):
                hit &= (ax[some] <= reach)[:, None] | (ay_sorted[:upto] <= reach)[None, :]
            if near is None:
                near = np.zeros((len(rows), len(columns)), bool)
            near[t : t + TILE, :upto] = hit
        same = left["id"] == right["id"]
        if near is None:
            return None
        if same:
            near &= rows[:, None] != columns[None, :]
        found, met = near.any(1), near.any(0)
        if not found.any():
            return None
        near, rows, columns = near[found][:, met], rows[found], columns[met]
        first = 0 if same else len(a)
        cls = np.concatenate([left["id"] << 20 | np.arange(len(a)), [] if same else right["id"] << 20 | np.arange(len(b))]).astype(np.int64)
        degree = np.zeros(len(cls), np.int64)
        cuts = range(0, len(rows), TILE)
        degree[rows] = np.concatenate([near[t : t + TILE] @ right["weights"][columns] for t in cuts])
        if not same:
            degree[columns + first] = sum(left["weights"][rows[t : t + TILE]] @ near[t : t + TILE] for t in cuts)
        # Smallest position reachable inside this product.
        top, x, y = np.arange(len(cls)), rows, columns + first
        least = lambda part, value: np.where(part, value, len(cls))
        while True:
            low = np.minimum(top[x], np.concatenate([least(near[t : t + TILE], top[y][None, :]).min(1) for t in cuts]))
            high = np.minimum.reduce([top[y], *(least(near[t : t + TILE], low[t : t + TILE, None]).min(0) for t in cuts)])
            if (low == top[x]).all() and (high == top[y]).all():
                break
            top[x], top[y] = low, high
        used = np.union1d(x, y)
        return pa.table({"cls": cls[used], "degree": degree[used], "root": cls[top[used]]})

    def block(batch: pa.RecordBatch, i: int, side: str) -> dict:
        out = {c: column(batch, side + c)[i].as_py() for c in ("id", "cell", "size")}
        out["weights"] = column(batch, f"{side}weights")[i].values.to_numpy()
        out["unit"] = unit(np.frombuffer(column(batch, f"{side}vecs")[i].as_buffer(), kind).reshape(len(out["weights"]), -1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for i in range(batch.num_rows):
                if left is None or left["id"] != column(batch, "id")[i].as_py():
                    left = block(batch, i, "")
                found = product(left, left if left["id"] == column(batch, "other_id")[i].as_py() else block(batch, i, "other_"))
                if found is not None:
                    yield from found.to_batches()

    side = ["id", "cell", "first", "size", "near", "vecs", "weights"]
    other = blocks.select(*(F.col(c).alias(f"other_{c}") for c in side))
    room = F.get("near", F.col("other_cell") - F.col("other_first")) + F.get("other_near", F.col("cell") - F.col("first"))
    meet = (F.col("id") <= F.col("other_id")) & (F.col("first") - F.col("other_first") == 0) & ((F.col("cell") - F.col("other_cell") == 0) | (room <= widest))
    pairs = blocks.select(*side).join(other.hint("shuffle_replicate_nl"), meet).drop("first", "near", "other_first", "other_near")
    return pairs.mapInArrow(run, "cls long, degree long, root long")


def near_vectors(
    rows: DataFrame,
    threshold: float = 0.9,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    sigmas: float | None = None,
    cell: int = CELL,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = prepare(rows.sparkSession)
    packed, kind = packed_vectors(rows, vec_id, embedding)
    packed = stored(packed, "vectors")
    plan = all_cells(packed, kind, cell)
    if not plan:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = spark.sparkContext.broadcast(plan)
    blocks = stored(in_blocks(dealt(packed, kind, cells), kind, cells), "blocks")
    found = stored(linked(blocks, kind, cells, threshold, sigmas), "found")
    degree = found.groupBy("cls").agg(F.sum("degree").alias("degree"))
    label = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    classes = blocks.select("id", F.posexplode(F.arrays_zip("keys", "weights", "lowest")).alias("place", "class")).select(
        F.col("class.keys").alias("key"), F.shiftleft("id", 20).bitwiseOR(F.col("place")).alias("cls"), F.col("class.weights").alias("weight"), F.col("class.lowest").alias("lowest")
    )
    # A class without links is not in ``label``.
    lowest = label.join(classes.select(F.col("cls").alias("node"), "lowest"), "node").groupBy("label").agg(F.min("lowest").alias("component_id"))
    joined = lookup(label, lowest, "label", F.col("node")).select(F.col("node").alias("cls"), "component_id").join(degree, "cls")
    facts = classes.join(joined, "cls", "left").select(
        "key", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("degree").isNull(), F.col("lowest")).otherwise(F.col("component_id")).alias("component_id")
    )
    # Copies of one vector halfway between two centres may be at home in both: linked, and so equal here.
    facts = facts.groupBy("key").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = lookup(packed.where(F.col("key").isNotNull()).select("vec_id", "key"), facts, "key", F.col("vec_id")).select("vec_id", "n_links", "component_id")
    alone = packed.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
