"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are one class.  The classes' unit vectors are turned by the
principal axes of all of them, which keeps cosines and puts most of their
length in the leading coordinates.  They are dealt to blocks, neighbours by
their leading coordinates, and a tile compares two blocks: products of the
leading coordinates first, bounded above by adding the product of the suffix
norms; pairs that can't reach the threshold stop there, the others go on by
further coordinates, and what is left is decided on the vectors themselves in
double precision.  Tiles whose blocks' boxes can't reach the threshold are left
out.  A tile returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.operators.graph import connected_components
from pixeloom.plans.shared import bound_batches, written

#: Vectors of one side of a tile, and blocks at most: beyond that, blocks are cut into parts of about BLOCK vectors.
BLOCK, MOST_BLOCKS = 4096, 512
#: Leading coordinates that are compared first, and further ones at a time.
LEAD, STEP = 24, 20
#: Rows of the sample that the blocks' borders are laid by.
SAMPLE = 20_000
#: Rows and columns of a tile that are compared at once, and pairs looked at in one go.
SUB, PAIRS = 1024, 1 << 18


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key): the vector as bytes of doubles, scaled by a power of two; key is null where it is null, zero or not finite."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            size = np.diff(at) * lists.is_valid().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(size > 0)
            good, most = np.zeros(len(batch), bool), np.zeros(len(batch))
            if len(some):
                # a null list may still have values behind it, which no row's own range holds
                inside = np.zeros(len(values) + 1, np.int64)
                np.add.at(inside, at[:-1][some], 1)
                np.add.at(inside, at[1:][some], -1)
                values = values[np.cumsum(inside[:-1]) > 0]
                start = np.cumsum(size[some]) - size[some]
                most[some] = np.maximum.reduceat(np.abs(values), start)
                good[some] = np.isfinite(most[some]) & (most[some] > 0)
                # by the power of two of its largest component, exactly: no square over- or underflows, cosines stay as they are
                step = np.zeros(len(batch), np.int64)
                step[good] = np.frexp(most[good])[1]
                values = np.ldexp(values, -np.repeat(step[some], size[some]).astype(np.int32))
                raw, edges = values.tobytes(), np.zeros(len(batch) + 1, np.int64)
                edges[1:] = np.cumsum(size) * 8
            keys = [raw[edges[i] : edges[i + 1]] if good[i] else None for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["id", "key"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary")


def matrix(keys: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Axes of the unit vectors by falling variance; what is gathered are ``dim`` squared sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            u = unit(matrix(batch.column(0), dim))
            total[:dim] += u.T @ u
            total[dim] += u.sum(0)
            n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), float(n)))], ["at", "sum"])

    sums = classes.select("key").mapInArrow(run, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).orderBy("at").toPandas()["sum"].to_numpy()
    n, moments = max(1.0, sums[-1]), sums[:-1].reshape(dim + 1, dim)
    mean = moments[dim] / n
    return np.linalg.eigh(moments[:dim] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def borders(sample: np.ndarray, blocks: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts at medians: nodes (coordinate, value, below, above); children under 0 are blocks -1, -2, ..."""
    tree: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal made
        if want <= 1 or len(rows) < 2:
            made += 1
            return -made
        axis = int(np.argmax(rows.max(0) - rows.min(0)))
        low = want // 2
        value = float(np.quantile(rows[:, axis], low / want))
        at = len(tree)
        tree.append((axis, value, 0, 0))
        below = rows[:, axis] < value
        tree[at] = (axis, value, grow(rows[below], low), grow(rows[~below], want - low))
        return at

    root = grow(sample, blocks)
    return tree if root == 0 and tree else []


def block_of(lead: np.ndarray, tree: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(lead), np.int64)
    if not tree:
        return at
    axis, value, below, above = (np.array(c) for c in zip(*tree, strict=True))
    going = np.arange(len(lead))
    while len(going):
        node = at[going]
        at[going] = np.where(lead[going, axis[node]] < value[node], below[node], above[node])
        going = going[at[going] >= 0]
    return -at - 1


def tiles(boxes: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of blocks (with lows, highs and largest suffix norm in each row) that may hold a pair over the threshold."""
    m = (boxes.shape[1] - 1) // 2
    out = []
    for i in range(len(boxes)):
        low, high, rest = boxes[i, :m], boxes[i, m : 2 * m], boxes[i, -1]
        others = boxes[i:]
        most = np.maximum(np.maximum(low * others[:, :m], low * others[:, m : 2 * m]), np.maximum(high * others[:, :m], high * others[:, m : 2 * m])).sum(1) + rest * others[:, -1]
        out += [(i, i + int(j)) for j in np.flatnonzero(most >= threshold - 1e-6)]
    return out


def pairs_over(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of turned unit vectors with cosine >= threshold (i < j where both sides are the same)."""
    dim = a.shape[1]
    norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (raw_a, raw_b))
    ends = [*range(min(LEAD, dim), dim, STEP), dim]
    tail = lambda x: np.sqrt(np.maximum(0, np.stack([(x[:, e:] ** 2).sum(1) for e in ends], 1)))
    tail_a, tail_b = tail(a), tail(b)
    lead_a, lead_b = a[:, : ends[0]].astype(np.float32), b[:, : ends[0]].astype(np.float32)
    slack = np.float32(threshold - 1e-4)
    for r in range(0, len(a), SUB):
        for c in range(r - r % SUB if same else 0, len(b), SUB):
            bound = lead_a[r : r + SUB] @ lead_b[c : c + SUB].T
            bound += np.outer(tail_a[r : r + SUB, 0].astype(np.float32), tail_b[c : c + SUB, 0].astype(np.float32))
            i, j = np.nonzero(bound >= slack)
            i, j = i + r, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), PAIRS):
                x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                got, done = np.einsum("ij,ij->i", a[x, : ends[0]], b[y, : ends[0]]), ends[0]
                for e, end in enumerate(ends[1:], 1):
                    alive = got + tail_a[x, e - 1] * tail_b[y, e - 1] >= threshold - 1e-9
                    x, y, got = x[alive], y[alive], got[alive]
                    got = got + np.einsum("ij,ij->i", a[x, done:end], b[y, done:end])
                    done = end
                near = got >= threshold - 1e-9
                x, y = x[near], y[near]
                exact = np.einsum("ij,ij->i", raw_a[x], raw_b[y]) / (norm_a[x] * norm_b[y])
                yield x[exact >= threshold], y[exact >= threshold]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that the pairs connect each one with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare_tile(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, raw: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile: linked weight of each row, and its root (the row's own id where it has none)."""
    order = np.argsort(ids, kind="stable")
    turned = unit(raw) @ axes
    left, right = order[side[order] == 0], order[side[order] == 1]
    same = not len(right)
    right = left if same else right
    links, first, second = np.zeros(len(ids), np.int64), [], []
    pending = 0
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    for x, y in pairs_over(turned[left], turned[right], raw[left], raw[right], threshold, same):
        x, y = left[x], right[y]
        links += np.bincount(x, weight[y], len(ids)).astype(np.int64) + np.bincount(y, weight[x], len(ids)).astype(np.int64)
        first.append(place[x])
        second.append(place[y])
        pending += len(x)
        if pending > 2_000_000:  # only the forest of what was found is kept
            label = forest(len(ids), np.concatenate(first), np.concatenate(second))
            other = np.flatnonzero(label != np.arange(len(ids)))
            first, second, pending = [other], [label[other]], len(other)
    label = forest(len(ids), np.concatenate(first), np.concatenate(second)) if first else np.arange(len(ids))
    return links, ids[order][label[place]], order


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors with cosine >= ``threshold`` in double precision are linked; vectors that are null, empty, zero or not
    finite link with nothing, and vectors of different dimensions never link.
    Vectors are scaled by powers of two first, so very large and very small ones are compared as well.
    Equal vectors are linked whatever their ids; repeated rows count as vectors of their own.  An empty table gives
    an empty result; other columns of any name are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    bound_batches(vectors.sparkSession)
    rows = written(valid_vectors(vectors, id_col, vector_col), "vectors")
    classes = written(rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.length("key") / 8), "vector-classes")
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "rep long, links long, root long")
    # vectors of one table have one dimension, or a few
    for dim, n in ((int(r["dim"]), r["count"]) for r in classes.groupBy("dim").count().collect()):
        links = links.unionByName(_links(classes.where(F.col("dim") == dim), dim, n, threshold))
    links = written(links, "vector-links")
    components = connected_components(links.where("root != rep").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = classes.select("key", "rep", "weight").join(total, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(whole, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("id") == component).alias("kept"))


def _links(classes: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """(rep, links, root) of every tile's rows that have links."""
    spark = classes.sparkSession
    axes = principal_axes(classes, dim)
    lead = min(LEAD, dim)
    blocks = min(MOST_BLOCKS, -(-n // BLOCK))
    parts = -(-n // (blocks * BLOCK))
    # a bounded sample only lays borders: whatever they are, every row is in one block and every pair in one tile
    some = classes.select("key").sample(min(1.0, SAMPLE / n), 5).limit(2 * SAMPLE).toArrow() if blocks > 1 else None
    tree = borders((unit(matrix(some.column(0).combine_chunks(), dim)) @ axes)[:, :lead], blocks) if some is not None and some.num_rows else []
    shared = spark.sparkContext.broadcast((axes, tree))  # bounded by the dimension and MOST_BLOCKS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, tree = shared.value
        for batch in batches:
            u = unit(matrix(batch.column(0), dim)) @ axes
            box = np.column_stack([u[:, :lead], np.sqrt((u[:, lead:] ** 2).sum(1))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_of(u[:, :lead], tree)), pa.ListArray.from_arrays(pa.array(np.arange(0, box.size + 1, lead + 1, dtype=np.int32)), pa.array(box.ravel()))], ["key", "rep", "weight", "block", "box"])

    dealt = classes.select("key", "rep", "weight").mapInArrow(deal, "key binary, rep long, weight long, block long, box array<double>")
    edges = dealt.groupBy("block").agg(*[f(F.col("box")[k]).alias(f"{name}{k}") for name, f in (("l", F.min), ("h", F.max)) for k in range(lead)], F.max(F.col("box")[lead]).alias("rest")).orderBy("block").toPandas()
    if not len(edges):
        return spark.createDataFrame([], "rep long, links long, root long")
    # at most MOST_BLOCKS boxes, so at most MOST_BLOCKS ** 2 / 2 tiles on the driver and in the broadcast
    names = edges.pop("block").tolist()
    plan = [(names[i], t, 0 if names[i] == names[x] else 1, x == y) for t, (x, y) in enumerate(tiles(edges.to_numpy(), threshold)) for i in {x, y}]
    seats = spark.createDataFrame(plan, "block long, tile long, side int, same boolean").groupBy("block").agg(F.collect_list(F.struct("tile", "side", "same")).alias("seats"))
    sent = dealt.select("key", "rep", "weight", "block").join(F.broadcast(seats), "block").select("key", "rep", "weight", F.explode("seats").alias("s")).select("key", "rep", "weight", "s.tile", "s.side", "s.same")
    # every part of a block meets every part of the other one, in a tile of its own
    own = F.pmod(F.xxhash64("rep"), F.lit(parts))
    sent = sent.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    i = F.when(F.col("same"), low).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    j = F.when(F.col("same"), high).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(F.col("same"), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    sent = sent.select("key", "rep", "weight", "tile", i.alias("i"), j.alias("j"), side.alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        ids, weight, side = (table.column(c).to_numpy() for c in ("rep", "weight", "side"))
        links, root, _ = compare_tile(ids, weight, side, matrix(table.column("key").combine_chunks(), dim), shared.value[0], threshold)
        has = np.flatnonzero(links)
        return pa.table({"rep": ids[has], "links": links[has], "root": root[has]})

    return sent.groupBy("tile", "i", "j").applyInArrow(compare, "rep long, links long, root long")
