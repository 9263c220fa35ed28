"""Assignment of pixels to the nearest cluster whose window covers them.

Pixels and windows meet in buckets as wide as a window: a cluster is filed under
the at most four buckets its window touches, and each bucket's clusters are one
array.  A pixel looks its bucket up once and takes the least packed key (distance,
row, number) of the array, so the band join multiplies no rows and needs no
aggregation over pixels.  Where the clusters are few enough to go to every task,
pixels are not shuffled and numpy compares a batch of them at a time; else pixels
and buckets meet in a join, which compares them by an expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeloom.config import MANHATTAN, Config
from pixeloom.operators.spatial import spatial_distance, spatial_weight
from pixeloom.sources.rasters import is_sampled

#: Clusters up to which they go to every task; beyond, their buckets are joined by shuffle.
BROADCAST_CLUSTERS = 200_000
#: Pairs of pixel and cluster that a task compares at a time (one pixel's are compared together).
PAIRS = 1 << 18


def cluster_buckets(clusters: DataFrame) -> DataFrame:
    """(image_id, by, bx, near): the clusters whose windows touch each bucket of side 2s + 1."""
    side, s = 2 * F.col("s") + 1, F.col("s")
    span = lambda c: F.sequence(F.floor((F.col(c) - s) / side).cast("int"), F.floor((F.col(c) + s) / side).cast("int"))
    filed = clusters.withColumn("by", F.explode(span("cy"))).withColumn("bx", F.explode(span("cx"))).where("by >= 0 and bx >= 0")
    return filed.groupBy("image_id", "by", "bx").agg(F.collect_list(F.struct("cy", "cx", "l", "a", "b", "k")).alias("near"))


def packed_distance(c: Column, config: Config) -> Column:
    """distance << 32 | cy << 16 | number of a cluster struct for the pixel, or null outside its window."""
    s = F.col("s")
    row = F.greatest(c["cy"], s) if config.top_clip else c["cy"]
    dx, dy = F.abs(F.col("x") - c["cx"]), F.abs(F.col("y") - row)
    color = F.abs(F.col("l") - c["l"]) + F.abs(F.col("a") - c["a"]) + F.abs(F.col("b") - c["b"])
    d = color + spatial_distance(dx, dy, spatial_weight(s, config.compactness), config.distance_metric)
    inside = (dx <= s) & (F.abs(F.col("y") - c["cy"]) <= s)
    return F.when(inside, F.shiftleft(d.cast("long"), 32).bitwiseOR(F.shiftleft(c["cy"].cast("long"), 16)).bitwiseOR(c["k"].cast("long")))


class Buckets:
    """:func:`cluster_buckets` as arrays: a bucket's clusters are members[begin : begin + count], buckets are in order of their codes."""

    def __init__(self, image: np.ndarray, clusters: dict[str, np.ndarray]):
        self.clusters = clusters
        self.images, own = np.unique(image, return_inverse=True)
        s, side = clusters["s"], 2 * clusters["s"] + 1
        # a window touches one or two buckets in either direction
        spans = [[(clusters[c] - s) // side, (clusters[c] + s) // side] for c in ("cy", "cx")]
        filed = []
        for low, by in enumerate(spans[0]):
            for left, bx in enumerate(spans[1]):
                again = (low and by == spans[0][0]) | (left and bx == spans[1][0])
                at = np.flatnonzero((by >= 0) & (bx >= 0) & ~np.asarray(again, bool))
                filed.append(np.column_stack([own[at], by[at], bx[at], at]))
        filed = np.concatenate(filed)
        self.rows, self.columns = (int(filed[:, c].max(initial=-1)) + 1 for c in (1, 2))
        code = self.code(*filed[:, :3].T)
        order = np.argsort(code, kind="stable")
        self.members = filed[order, 3]
        self.codes, self.begin, self.count = np.unique(code[order], return_index=True, return_counts=True)

    def code(self, image: np.ndarray, by: np.ndarray, bx: np.ndarray) -> np.ndarray:
        return (image * self.rows + by) * self.columns + bx

    def of(self, image: np.ndarray, y: np.ndarray, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pixel's clusters begin in ``members``, and how many they are."""
        if not len(self.codes):
            return np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        by, bx = y // (2 * s + 1), x // (2 * s + 1)
        own = np.minimum(np.searchsorted(self.images, image), len(self.images) - 1)
        code = self.code(own, by, bx)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        met = (self.images[own] == image) & (by < self.rows) & (bx < self.columns) & (self.codes[at] == code)
        return self.begin[at], np.where(met, self.count[at], 0)


def nearest(buckets: Buckets, config: Config, pixels: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least :func:`packed_distance` of each pixel, and whether a window covers it; the same arithmetic on arrays."""
    begin, count = buckets.of(*(pixels[n] for n in ("image_id", "y", "x", "s")))
    key, covered = np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
    size = pixels["s"].astype(np.float32)
    with np.errstate(divide="ignore"):
        weight = np.where(size > 0, np.float32(1) / (size / np.float32(config.compactness)) * np.float32(2), np.float32(0))
    upto, low = np.cumsum(count), 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
        n = count[low:high]
        pixel = np.repeat(np.arange(low, high), n)
        near = buckets.members[np.arange(len(pixel)) + np.repeat(begin[low:high] - np.cumsum(n) + n, n)]
        low = high
        s = pixels["s"][pixel]
        dx = np.abs(pixels["x"][pixel] - buckets.clusters["cx"][near])
        inside = np.flatnonzero((dx <= s) & (np.abs(pixels["y"][pixel] - buckets.clusters["cy"][near]) <= s))
        if not len(inside):
            continue
        pixel, near, dx, s = pixel[inside], near[inside], dx[inside], s[inside]
        cy = buckets.clusters["cy"][near]
        dy = np.abs(pixels["y"][pixel] - (np.maximum(cy, s) if config.top_clip else cy))
        offset = (dx + dy).astype(np.float32) if config.distance_metric == MANHATTAN else np.hypot(dx.astype(np.float64), dy).astype(np.float32)
        d = np.minimum(np.floor(weight[pixel] * offset), 65535).astype(np.int64)
        for c in ("l", "a", "b"):
            d += np.abs(pixels[c][pixel] - buckets.clusters[c][near])
        first = np.flatnonzero(np.diff(pixel, prepend=-1))
        key[pixel[first]] = np.minimum.reduceat(d << 32 | cy << 16 | buckets.clusters["k"][near], first)
        covered[pixel[first]] = True
    return key, covered


def _nearest_key(clusters: DataFrame, config: Config, start: int, stride: int) -> Column:
    """Each pixel's least packed distance, null in rows that aren't sampled; the clusters go along with the function."""
    names = ("image_id", "cy", "cx", "l", "a", "b", "k", "s")
    # a cluster with a null has no distance
    table = clusters.select(*(F.col(n).cast("long") for n in names)).na.drop().toArrow()
    image, *own = (table[n].to_numpy() for n in names)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        buckets = Buckets(image, dict(zip(names[1:], own, strict=True)))
        for columns in batches:
            pixels = {n: c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n, c in zip(("image_id", "y", "x", "l", "a", "b", "s"), columns, strict=True)}
            here = pixels["y"] % stride == start
            for c in columns:
                if c.null_count:
                    here &= c.is_valid().to_numpy(zero_copy_only=False)
            here = np.flatnonzero(here)
            key, covered = np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), bool)
            key[here], covered[here] = nearest(buckets, config, {n: v[here] for n, v in pixels.items()})
            yield pa.array(key, mask=~covered)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")("image_id", "y", "x", "l", "a", "b", "s")


def assign(state: DataFrame, clusters: DataFrame, config: Config, start: int = 0, stride: int | None = None, broadcast: bool | None = None) -> DataFrame:
    """``state`` (pixels with s, k, min_dist) after one assignment of the rows with y % stride = start.

    A sampled pixel that no window covers keeps its cluster and loses its distance; rows that aren't sampled keep
    both.  Ties go to the cluster with the smaller row, then the smaller number.
    """
    stride = config.subsample_stride if stride is None else stride
    if broadcast is None:
        broadcast = clusters.limit(BROADCAST_CLUSTERS + 1).count() <= BROADCAST_CLUSTERS
    sampled = is_sampled(start, stride)
    names = state.columns
    if broadcast:
        met = state.withColumn("key", _nearest_key(clusters, config, start, stride))
    else:
        side = 2 * F.col("s") + 1
        dealt = state.withColumns({"by": F.floor(F.col("y") / side).cast("int"), "bx": F.floor(F.col("x") / side).cast("int")})
        met = dealt.join(cluster_buckets(clusters), ["image_id", "by", "bx"], "left")
        met = met.withColumn("key", F.when(sampled, F.array_min(F.transform("near", lambda c: packed_distance(c, config)))))
    k = F.coalesce(F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.col("k"))
    distance = F.when(sampled, F.shiftright("key", 32).cast("int")).otherwise(F.col("min_dist"))
    return met.withColumns({"k": k, "min_dist": distance}).select(*names)


def assign_theta(state: DataFrame, clusters: DataFrame, config: Config) -> DataFrame:
    """The same full assignment as a plain band join and a grouped minimum; for comparison in tests."""
    c = F.struct(*[clusters[n].alias(n) for n in ("cy", "cx", "l", "a", "b", "k")])
    near = clusters.select(F.col("image_id").alias("c_image"), c.alias("c"))
    met = state.drop("k", "min_dist").join(near, (F.col("image_id") == F.col("c_image")) & (F.abs(F.col("y") - F.col("c.cy")) <= F.col("s")) & (F.abs(F.col("x") - F.col("c.cx")) <= F.col("s")))
    best = met.groupBy("image_id", "y", "x").agg(F.min(packed_distance(F.col("c"), config)).alias("key"))
    return best.select("image_id", "y", "x", F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("k"), F.shiftright("key", 32).cast("int").alias("min_dist"))
