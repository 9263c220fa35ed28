"""Connected components of label rasters and the clean-up of small ones.

Images are cut into bands of rows (``operators.bands``): a band's components are found in one task, those that cross
a cut are joined by a graph over bands, and what a band needs to know of the others are a few rows.  Unassigned
pixels (null) count as one label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixeloom.operators.bands import BAND_PIXELS, banded, marked, opened, pixels, told, unpacked
from pixeloom.operators.graph import ONE_TASK_EDGES
from pixeloom.plans.shared import written


def pixel_edges(labels: DataFrame) -> DataFrame:
    """(image_id, y, x, toward): the 4-neighbour pairs with one label, seen from the right or lower pixel."""
    left, up = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    same = lambda w: (F.row_number().over(w) > 1) & F.lag("k").over(w).eqNullSafe(F.col("k"))
    marked = labels.select("image_id", "y", "x", F.array_compact(F.array(F.when(same(left), F.lit("left")), F.when(same(up), F.lit("up")))).alias("toward"))
    return marked.select("image_id", "y", "x", F.explode("toward").alias("toward"))


def _rooted(row: dict, own: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether each component of the band has its first pixel here."""
    out = np.ones(len(row["first"]), bool)
    out[np.searchsorted(row["first"], own)] = own == root
    return out


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each band, how many components start in it, and the ranks of the open ones among them."""
    for row in unpacked(batches):
        own, root, _ = marked(row)
        here = _rooted(row, own, root)
        of = (np.cumsum(here) - 1)[np.searchsorted(row["first"], own)]
        ranks = [{"root": int(r), "rank": int(n)} for o, r, n in zip(own, root, of, strict=True) if o == r]
        yield pa.RecordBatch.from_pylist([{"image_id": row["image_id"], "band": row["band"], "n": int(here.sum()), "ranks": ranks}], pa.schema([("image_id", pa.int64()), ("band", pa.int32()), ("n", pa.int64()), ("ranks", pa.list_(pa.struct([("root", pa.int64()), ("rank", pa.int64())])))]))


def _numbered(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The number of each component of the band, and whether it starts here."""
    own, root, number = marked(row)
    here = _rooted(row, own, root)
    out = np.cumsum(here) - 1 + row["before"]
    out[np.searchsorted(row["first"], own)] = number
    return out, here


def _numbers(bands: DataFrame, crossing: DataFrame) -> DataFrame:
    """Bands told how many components start before them (``before``) and the numbers of their open components."""
    marks = crossing.select("image_id", "band", "leader", "root", F.lit(None).cast("long").alias("value"))
    ranks = told(bands.select("image_id", "band", "first"), marks).mapInArrow(_ranked, "image_id long, band int, n long, ranks array<struct<root: long, rank: long>>")
    ranks = written(ranks, "ranks")
    earlier = Window.partitionBy("image_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    numbers = ranks.select("image_id", "before", F.explode("ranks").alias("r")).select("image_id", F.col("r.root").alias("root"), (F.col("before") + F.col("r.rank")).alias("value"))
    marks = crossing.join(numbers, ["image_id", "root"]).select("image_id", "band", "leader", "root", "value")
    return told(bands.join(ranks.select("image_id", "band", "before"), ["image_id", "band"]), marks)


def component_pixels(labels: DataFrame, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """(image_id, y, x, comp) from labels with columns image_id, y, x, k, w, h, s; numbers as in :func:`component_sizes`."""
    bands = banded(labels, pixels=band_pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches):
            yield from pixels(row, _numbered(row)[0], "comp", pa.int64())

    known = _numbers(bands, opened(bands)[0])
    return known.select("image_id", "band", "y0", "w", "h", "per", "begin", "comp", "first", "before", "marks").mapInArrow(run, "image_id long, y int, x int, comp long")


def component_sizes(labels: DataFrame, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """A COMPONENTS table: components numbered by their first pixel."""
    bands = banded(labels, pixels=band_pixels)
    crossing, _ = opened(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches):
            number, here = _numbered(row)
            closed = here.copy()
            closed[row["open"]] = False
            # open ones get their members from all their bands
            for own, members in ((closed, row["members"][closed].astype(np.int64)), (here & ~closed, None)):
                n = int(own.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["image_id"], np.int64)), pa.array(number[own]), pa.array(row["first"][own]), pa.nulls(n, pa.int64()) if members is None else pa.array(members)], ["image_id", "comp", "leader", "members"])

    known = _numbers(bands, crossing).select("image_id", "band", "first", "members", "open", "before", "marks")
    found = known.mapInArrow(run, "image_id long, comp long, leader long, members long")
    whole = crossing.groupBy("image_id", F.col("root").alias("leader")).agg(F.sum("members").alias("all_members"))
    met = found.where("members is null").join(whole, ["image_id", "leader"])
    return found.where("members is not null").unionByName(met.select("image_id", "comp", "leader", F.col("all_members").alias("members")))


def least_members(size: int, factor: float) -> int:
    """round(s * s * factor) in single precision, halves up."""
    return int(np.floor(np.float64(np.float32(size * size) * np.float32(factor)) + 0.5))


def _candidates(bands: DataFrame, crossing: DataFrame, factor: float, most: int) -> DataFrame:
    """(image_id, s, leader, members) of whole components, among them the ``most`` largest of each image that are large enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches):
            closed = np.ones(len(row["first"]), bool)
            closed[row["open"]] = False
            own = np.flatnonzero(closed & (row["members"] >= least_members(row["s"], factor)))
            own = own[np.lexsort((own, -row["members"][own]))[:most]]
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["image_id"], np.int64)), pa.array(np.full(n, row["s"], np.int32)), pa.array(row["first"][own]), pa.array(row["members"][own].astype(np.int64))], ["image_id", "s", "leader", "members"])

    closed = bands.select("image_id", "s", "first", "members", "open").mapInArrow(run, "image_id long, s int, leader long, members long")
    whole = crossing.groupBy("image_id", F.col("root").alias("leader")).agg(F.sum("members").alias("members"))
    return closed.unionByName(whole.join(bands.select("image_id", "s").distinct(), "image_id").select("image_id", "s", "leader", "members"))


def _large(bands: DataFrame, crossing: DataFrame, factor: float, most: int) -> DataFrame:
    return large_components(_candidates(bands, crossing, factor, most), size_threshold(F.col("s"), factor), most)


def large_labels(labels: DataFrame, clusters: int, min_size_factor: float, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """(image_id, leader, label) of the large components of labels with columns image_id, y, x, k, w, h, s."""
    bands = banded(labels, pixels=band_pixels)
    return _large(bands, opened(bands)[0], min_size_factor, clusters)


def large_components(found: DataFrame, threshold: F.Column, most: int) -> DataFrame:
    """(image_id, leader, label): components of at least ``threshold`` pixels, the ``most`` largest of each image.

    Ties in size go to the earlier component; labels count from 0 by first pixel.
    """
    by_size = Window.partitionBy("image_id").orderBy(F.col("members").desc(), "leader")
    kept = found.where(F.col("members") >= threshold).withColumn("place", F.row_number().over(by_size)).where(F.col("place") <= most)
    label = F.row_number().over(Window.partitionBy("image_id").orderBy("leader")) - 1
    return kept.select("image_id", "leader", label.cast("int").alias("label"))


def size_threshold(size: F.Column, factor: float) -> F.Column:
    """round(s * s * factor) in single precision, halves up."""
    return F.floor((size * size).cast("float") * F.lit(float(factor)).cast("float") + F.lit(0.5)).cast("long")


def _chased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all components of a small forest: pointers are followed until nothing changes; null where they lead nowhere."""
    schema = pa.schema([("root", pa.int64()), ("label", pa.int32()), ("parent", pa.int64())])
    table = pa.Table.from_batches([b.cast(schema) for b in batches], schema).sort_by("root")
    root, label = table["root"].to_numpy(), table["label"].fill_null(-1).to_numpy()
    parent = table["parent"]
    up = np.searchsorted(root, np.where((label >= 0) | parent.is_null().to_numpy(), root, parent.fill_null(0).to_numpy()))
    while not np.array_equal(up, up[up]):
        up = up[up]
    yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(label[up], mask=label[up] < 0)], ["root", "label"])


def _settled(forest: DataFrame, max_rounds: int) -> DataFrame:
    """(root, label): each component's label, or the one that its pointers lead to; rounds double the pointers."""
    for _ in range(max_rounds):
        if forest.where("label is null and parent is not null").isEmpty():
            return forest.select("root", "label")
        up = forest.select(F.col("root").alias("parent"), F.col("label").alias("up_label"), F.col("parent").alias("up_parent"))
        forest = forest.join(up, "parent", "left").select("root", F.coalesce("label", "up_label").alias("label"), F.when(F.col("label").isNull() & F.col("up_label").isNull(), F.col("up_parent")).alias("parent"))
        forest = written(forest, "forest")
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def _resolved(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each component of the band, its label, or else the root elsewhere that its pointers lead to; -1 for neither."""
    w, y0, first, (own, root, value) = row["w"], row["y0"], row["first"], marked(row)
    n = len(first)
    # two more places: the component left of the cut above the band, and nowhere
    label, away, up = np.full(n + 2, -1), np.full(n + 2, -1), np.arange(n + 2)
    at = np.where(own < 0, n, np.searchsorted(first, own))
    label[at] = value
    elsewhere = (own != root) & (value < 0)
    away[at[elsewhere]] = root[elsewhere]
    if n and first[0] == 0 and label[0] < 0:
        label[0] = 0
    loose = np.flatnonzero((label[:n] < 0) & (away[:n] < 0))
    beside = np.where(first[loose] % w > 0, first[loose] - 1, first[loose] - w) - y0 * w
    inside = row["comp"][np.searchsorted(row["begin"], np.maximum(beside, 0), "right") - 1]
    up[loose] = np.where(beside < 0, n, np.where(inside < 0, n + 1, inside))
    while not np.array_equal(up, up[up]):
        up = up[up]
    return label[up[:n]], away[up[:n]]


def _pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the open components without a label that start in a band, the label or the root that they lead to."""
    for row in unpacked(batches):
        own, root, value = marked(row)
        own = own[(own == root) & (value < 0)]
        label, away = (v[np.searchsorted(row["first"], own)] for v in _resolved(row))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["image_id"], np.int64)), pa.array(own), pa.array(label.astype(np.int32), mask=label < 0), pa.array(away, mask=away < 0)], ["image_id", "root", "label", "parent"])


def enforce_connectivity(labels: DataFrame, clusters: int, min_size_factor: float, max_rounds: int = 64, one_task: int = ONE_TASK_EDGES, keep: tuple[str, ...] = (), band_pixels: int = BAND_PIXELS) -> DataFrame:
    """(image_id, y, x, label, *keep) from labels with columns image_id, y, x, k, w, s and h, and the INT columns ``keep``.

    Large components are labelled by first pixel; the first component of an image without a label gets 0; any other
    takes the label of the pixel left of its first one (above it in column 0), followed as far as needed.
    """
    bands = banded(labels, keep, band_pixels)
    crossing, area = opened(bands, one_task)
    big = written(_large(bands, crossing, min_size_factor, clusters), "large")
    # what a band is told: its open components, the one before its first pixel, its large ones
    known = crossing.join(big.withColumnRenamed("leader", "root"), ["image_id", "root"], "left")
    known = known.select("image_id", "band", "leader", "root", F.coalesce("label", F.when(F.col("root") == 0, 0)).alias("value"))
    corners = bands.where("corner is not null").select("image_id", "band", F.col("corner").alias("leader"))

    def marks(known: DataFrame) -> DataFrame:
        before = corners.join(known, ["image_id", "band", "leader"]).select("image_id", (F.col("band") + 1).alias("band"), F.lit(-1).cast("long").alias("leader"), "root", "value")
        band = F.floor(F.floor(F.col("leader") / F.col("w")) / F.col("per")).cast("int")
        placed = big.join(bands.select("image_id", "w", "per").distinct(), "image_id").select("image_id", band.alias("band"), "leader", F.col("leader").alias("root"), F.col("label").alias("value"))
        return known.unionByName(before).unionByName(placed)

    if not crossing.isEmpty():
        base = F.col("image_id") * area
        forest = told(bands.select("image_id", "band", "y0", "w", "begin", "comp", "first"), marks(known)).mapInArrow(_pointers, "image_id long, root long, label int, parent long")
        forest = written(forest.select((base + F.col("root")).alias("root"), "label", (base + F.col("parent")).alias("parent")), "forest")
        few = forest.count() <= one_task
        settled = forest.coalesce(1).mapInArrow(_chased, "root long, label int") if few else _settled(forest, max_rounds)
        settled = settled.select(F.col("root").alias("node"), "label")
        known = known.withColumn("node", base + F.col("root")).join(settled, "node", "left")
        known = written(known.select("image_id", "band", "leader", "root", F.coalesce("value", "label").alias("value")), "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches, keep):
            yield from pixels(row, _resolved(row)[0], "label", pa.int32(), keep)

    names = ["image_id", "band", "y0", "w", "h", "per", "begin", "comp", "first", *(f"keep_{n}" for n in keep)]
    return told(bands.select(*names), marks(known)).mapInArrow(run, "image_id long, y int, x int, label int" + "".join(f", {n} int" for n in keep))
