"""Whole segmentations: the loop of assignment and update, and the clean-up.

Two plans give the same rows.  ``distributed`` keeps pixels as rows, carries the
state from iteration to iteration through written tables, and has no limit on an
image's size.  ``local`` segments each image inside one task with numpy and is
chosen where images are small enough for that, so many images run in parallel
with a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.config import Config
from pixeloom.operators.assign import BROADCAST_CLUSTERS, assign
from pixeloom.operators.components import enforce_connectivity
from pixeloom.operators.seeds import seed_grid
from pixeloom.operators.spatial import image_shapes
from pixeloom.operators.update import rounded_mean, update
from pixeloom.plans import local
from pixeloom.plans.shared import written

#: Pixels of the largest image that one task segments whole.
LOCAL_PIXELS = 4_000_000


def prepared(pixels: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The pixels with w, h, s and empty assignments, and the images' shapes; both written."""
    shapes = written(image_shapes(pixels, config.num_of_clusters), "shapes")
    n = shapes.limit(BROADCAST_CLUSTERS + 1).count()
    state = pixels.join(F.broadcast(shapes) if n <= BROADCAST_CLUSTERS else shapes, "image_id")
    state = state.withColumns({"k": F.lit(None).cast("int"), "min_dist": F.lit(None).cast("int")})
    return written(state, "state"), shapes


def iterate(pixels: DataFrame, config: Config, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """State (pixels with w, h, s, k, min_dist) after the loop and the last full assignment, and the clusters.

    ``clusters`` replaces the seed grid: a CLUSTERS table with numbers below ``num_of_clusters``.
    """
    state, shapes = prepared(pixels, config)
    if clusters is None:
        clusters = seed_grid(state.select("image_id", "y", "x", "l", "a", "b"), config.num_of_clusters, shapes)
    elif "s" not in clusters.columns:
        clusters = clusters.join(shapes, "image_id")
    clusters = written(clusters, "clusters")
    few = clusters.limit(BROADCAST_CLUSTERS + 1).count() <= BROADCAST_CLUSTERS
    start = 0
    for _ in range(config.max_iterations):
        state = written(assign(state, clusters, config, start, broadcast=few), "state")
        clusters = written(update(state, clusters, config.subsample_stride, start), "clusters")
        start = (start + 1) % config.subsample_stride
    state = written(assign(state, clusters, config, 0, stride=1, broadcast=few), "state")
    if config.final_update:
        clusters = written(update(state, clusters), "clusters")
    return state, clusters


def distributed(pixels: DataFrame, config: Config, clusters: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x, label, min_dist) and the pixels' INT columns ``keep``, which go along with the labels."""
    state, _ = iterate(pixels, config, clusters)
    return enforce_connectivity(state, config.num_of_clusters, config.min_size_factor, keep=("min_dist", *keep))


def segment(pixels: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x, label, min_dist, *keep), by the local plan where every image is small enough for one task."""
    largest = pixels.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    return local.segment(pixels, config, keep) if largest <= LOCAL_PIXELS else distributed(pixels, config, keep=keep)


def label_stats(segmented: DataFrame) -> DataFrame:
    """Per final label of pixels with their label and l, a, b: members and rounded mean place and colour; one shuffle, of partial sums."""
    n = F.count("*")
    return segmented.groupBy("image_id", "label").agg(n.alias("members"), *[rounded_mean(F.sum(c), n).alias(f"mean_{c}") for c in ("y", "x", "l", "a", "b")])


def segment_stats(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`label_stats` of labels whose colours are in another table."""
    return label_stats(labels.join(pixels, ["image_id", "y", "x"]))
