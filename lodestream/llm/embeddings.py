"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so the cosine threshold is a radius, epsilon. Vectors are projected on their leading principal axes and sorted by
the cells, epsilon wide, of a grid on them. Stretches of that order are blocks with bounding boxes; two blocks meet unless their boxes are further than epsilon apart, which the
projections of the vectors would then be too. Within a pair the join goes on recursively over halves of the sequences, down to products of small matrices in double precision.

Blocks meet in tasks that hold SPAN_BYTES of consecutive blocks twice, so a block is sent once to each stretch of blocks near it, not once to each block.

Equal vectors are one class and one row of the join. A pair of blocks returns, for each vector, the number of its partners and a spanning forest of its links, never the pairs.

Cases: null and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different lengths, nor rows without an id, which have no component and aren't kept.
Repeated ids count as one vector of each row; all rows are returned. An empty table gives an empty result. Extra columns, the label among them, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestream.llm.components import components
from lodestream.llm.shared import small_batches, stored

#: Vectors that a block holds, and that the recursion multiplies at once.
BLOCK_ROWS, LEAF_ROWS = 4096, 512
#: Bytes of consecutive blocks that a task holds on either side.
SPAN_BYTES = 8 << 20
#: Principal axes of the grid and of the boxes, found on a bounded sample; the order affects speed alone.
AXES, SAMPLE_ROWS = 8, 5_000


def _packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (vec_id, size, raw): the components as bytes of doubles, null for vectors that link with nothing."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size, raw = [], []
            flat = column.flatten()
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            long = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(long)
            for n, end in zip(long.tolist(), ends.tolist(), strict=True):
                own = value[end - n : end]
                good = n and not holes[end - n : end].any() and np.isfinite(own).all() and own.any()
                size.append(n)
                raw.append((own + 0.0).tobytes() if good else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "size", "raw"])

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, size int, raw binary")


def unit(raw: list[bytes]) -> np.ndarray:
    """The vectors as rows of length one; scaling first keeps the squares of very large or small components finite."""
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes for each length of vector in the sample."""
    by_size: dict[int, list[bytes]] = {}
    for r in classes.orderBy(F.xxhash64("raw"), "rep").limit(SAMPLE_ROWS).select("size", "raw").collect():
        by_size.setdefault(r["size"], []).append(bytes(r["raw"]))
    found = {}
    for size, raw in by_size.items():
        u = unit(raw)
        _, axes = np.linalg.eigh(np.cov(u.T) if len(u) > 1 and size > 1 else np.eye(size))
        found[size] = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    return found


def _projected(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    own = axes.get(u.shape[1])
    p = u @ own if own is not None else u[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _blocks(classes: DataFrame, axes, epsilon: float) -> DataFrame:
    """Rows (block, size, ids, weights, raw, low, high) in epsilon grid order."""
    count = classes.count()
    cells = [f"c{i}" for i in range(AXES)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            cell = np.zeros((len(raw), AXES), np.int32)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                cell[at] = np.floor(_projected(unit([raw[i] for i in at]), axes.value) / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cell[:, i]) for i in range(AXES)]], names=["size", "raw", "rep", "n", *cells])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal first
            p = _projected(unit([r[1] for r in rows]), axes.value)
            made = [[first], [rows[0][0]], [np.array([r[2] for r in rows], np.int64).tobytes()], [np.array([r[3] for r in rows], np.int64).tobytes()], [b"".join(r[1] for r in rows)], [p.min(axis=0).tolist()], [p.max(axis=0).tolist()]]
            first += 1
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=["block", "size", "ids", "weights", "raw", "low", "high"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and (row[0] != held[0][0] or len(held) >= BLOCK_ROWS):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    schema = "size int, raw binary, rep long, n long, " + ", ".join(f"{c} int" for c in cells)
    placed = classes.select("size", "raw", "rep", "n").mapInArrow(place, schema).withColumn("spread", F.xxhash64("rep"))
    parts = max(1, -(-count // BLOCK_ROWS))
    order = ["size", *cells, "spread"]
    sorted_rows = placed.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(cut, "block long, size int, ids binary, weights binary, raw binary, low array<double>, high array<double>")


def _pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of stretches with blocks whose boxes are at most epsilon apart; they meet on cells of the first axis."""
    meta = blocks.select("stretch", "block", "size", "low", "high")
    cell = lambda c, more: F.floor(F.element_at(c, 1) / epsilon).cast("int") + more
    left = meta.select(F.col("block").alias("i"), F.col("stretch").alias("a"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), "size", F.explode(F.sequence(cell("low", -1), cell("high", 1))).alias("cell"))
    right = meta.select(F.col("block").alias("j"), F.col("stretch").alias("b"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), "size", F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("cell"))
    gap = F.expr("aggregate(zip_with(zip_with(low_i, high_j, (a, b) -> a - b), zip_with(low_j, high_i, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D)), 0D, (s, g) -> s + g * g)")
    near = left.join(right, ["size", "cell"]).filter((F.col("i") <= F.col("j")) & (gap <= _reach(epsilon)))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _reach(epsilon: float) -> float:
    """The square of epsilon, and what rounding may take."""
    return epsilon * epsilon * (1 + 1e-9)


def _leaf_labels(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label reachable over the hits, for the rows and the columns."""
    big = np.iinfo(np.int64).max
    while True:
        low_b = np.minimum(b, np.where(hit, a[:, None], big).min(axis=0))
        low_a = np.minimum(a, np.where(hit, low_b[None, :], big).min(axis=1))
        if (low_a == a).all() and (low_b == b).all():
            return a, b
        a, b = low_a, low_b


def join_blocks(u: np.ndarray, v: np.ndarray, pu: np.ndarray, pv: np.ndarray, wu: np.ndarray, wv: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted numbers of partners for both blocks, and links that keep what is joined; v's rows count from len(u) on unless it is the same block."""
    epsilon2 = (2 - 2 * least) * (1 + 1e-9)
    links_u, links_v = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
    shift = 0 if same else len(u)
    label = np.arange(len(u) + (0 if same else len(v)))
    edges: list[tuple[int, int]] = []

    def visit(a: int, b: int, c: int, d: int) -> None:
        if same and a > c:
            return  # the mirror image of an interval pair that is visited
        gap = np.maximum(0, np.maximum(pu[a:b].min(axis=0) - pv[c:d].max(axis=0), pv[c:d].min(axis=0) - pu[a:b].max(axis=0)))
        if (gap * gap).sum() > epsilon2:
            return
        if b - a > LEAF_ROWS or d - c > LEAF_ROWS:
            first = [(a, b)] if b - a <= LEAF_ROWS else _halves(a, b)
            second = [(c, d)] if d - c <= LEAF_ROWS else _halves(c, d)
            for x in first:
                for y in second:
                    visit(*x, *y)
            return
        hit = u[a:b] @ v[c:d].T >= least
        if same and a == c:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        links_u[a:b] += hit @ wv[c:d]
        if not (same and a == c):
            links_v[c:d] += hit.T @ wu[a:b]
        rows, cols = np.arange(a, b), np.arange(c, d) + shift
        low_a, low_b = _leaf_labels(hit, rows, cols)
        edges.extend(zip(rows[low_a != rows].tolist(), low_a[low_a != rows].tolist(), strict=True))
        edges.extend(zip(cols[low_b != cols].tolist(), low_b[low_b != cols].tolist(), strict=True))

    visit(0, len(u), 0, len(v))
    parent = label.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in edges:
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return links_u, links_v, kept


def _halves(a: int, b: int) -> list[tuple[int, int]]:
    """Halves on multiples of the leaf, so that one block's intervals are the same on both sides."""
    leaves = -(-(b - a) // LEAF_ROWS)
    middle = a + (leaves + 1) // 2 * LEAF_ROWS
    return [(a, middle), (middle, b)]


def _joined(pairs: DataFrame, blocks: DataFrame, axes, least: float) -> DataFrame:
    """Rows (node, links, other): links of two blocks of a pair of stretches; other is the node's neighbour in the forest, or null."""
    epsilon = math.sqrt(2 - 2 * least)
    columns = ["a", "b", "stretch", "block", "size", "ids", "weights", "raw", "low", "high"]
    one = pairs.join(blocks.withColumnRenamed("stretch", "a").withColumn("stretch", F.col("a")), "a").select(*columns)
    two = pairs.filter("a <> b").join(blocks.withColumnRenamed("stretch", "b").withColumn("stretch", F.col("b")), "b").select(*columns)
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        names = ["node", "links", "other"]

        def found() -> Iterator[pa.RecordBatch]:
            first, second = held[0]["a"], held[0]["b"]
            unpacked: dict[int, tuple] = {}

            def vectors(x: dict) -> tuple:
                if x["block"] not in unpacked:
                    u = unit([x["raw"][k : k + 8 * x["size"]] for k in range(0, len(x["raw"]), 8 * x["size"])])
                    unpacked[x["block"]] = u, _projected(u, axes.value), np.frombuffer(x["ids"], np.int64), np.frombuffer(x["weights"], np.int64)
                return unpacked[x["block"]]

            for x in held:
                for y in held:
                    if x["stretch"] != first or y["stretch"] != second or x["block"] > y["block"] or x["size"] != y["size"]:
                        continue
                    gap = np.maximum(0, np.maximum(np.subtract(x["low"], y["high"]), np.subtract(y["low"], x["high"])))
                    if (gap * gap).sum() > _reach(epsilon):
                        continue
                    same = x["block"] == y["block"]
                    (u, pu, ids_u, wu), (v, pv, ids_v, wv) = vectors(x), vectors(y)
                    links_u, links_v, kept = join_blocks(u, v, pu, pv, wu, wv, least, same)
                    every = ids_u if same else np.concatenate([ids_u, ids_v])
                    total = links_u + links_v if same else np.concatenate([links_u, links_v])
                    at = np.flatnonzero(total)
                    a, b = np.array([x for x, _ in kept], np.int64), np.array([y for _, y in kept], np.int64)
                    node = np.concatenate([every[at], every[a]])
                    if len(node):
                        other = pa.array(np.concatenate([np.zeros(len(at), np.int64), every[b]]), mask=np.arange(len(node)) < len(at))
                        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([total[at], np.zeros(len(a), np.int64)])), other], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["a"], row["b"]) != (held[0]["a"], held[0]["b"]):
                    yield from found()
                    held = []
                held.append(row)
        if held:
            yield from found()

    return one.unionByName(two).repartition(parts, "a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(run, "node long, links long, other long")


def near(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): links are pairs of cosine ``least`` or more."""
    spark = vectors.sparkSession
    epsilon = math.sqrt(2 - 2 * least)
    rows = stored(_packed(vectors, key, vector))
    classes = stored(rows.filter("raw IS NOT NULL AND vec_id IS NOT NULL").groupBy("size", "raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    axes = spark.sparkContext.broadcast(_axes(classes))
    spread = F.shiftright("block", 32)  # the partition of the sorted rows, which holds about BLOCK_ROWS
    width = 8 * F.greatest(F.lit(1), F.max("size")) * BLOCK_ROWS
    blocks = stored(_blocks(classes, axes, epsilon))
    each = max(1, SPAN_BYTES // int(blocks.agg(F.coalesce(width, F.lit(SPAN_BYTES))).first()[0]))
    blocks = blocks.withColumn("stretch", F.floor(spread / each).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds a block
    found = stored(_joined(stored(_pairs(blocks, epsilon)), blocks, axes, least))
    small_batches(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = components(found.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = classes.join(links, classes["rep"] == links["node"], "left").drop("node").join(of, classes["rep"] == of["node"], "left").drop("node")
    per_class = stored(joined.select("size", "raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(per_class, ["size", "raw"], "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce(F.when(known, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
