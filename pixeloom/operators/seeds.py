"""The grid of starting clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeloom.operators.spatial import image_shapes


def columns_per_band(clusters: int) -> list[int]:
    """Seeds of each band of rows: an even share, the remainder one each to bands 0, 2, 4, ... and then 1, 3, 5, ..."""
    bands = int(np.sqrt(np.float32(clusters)))
    base, extra = divmod(clusters, bands)
    order = sorted(range(bands), key=lambda r: (r % 2, r))
    lucky = set(order[:extra])
    return [base + (r in lucky) for r in range(bands)]


def _div_up(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("int")


def seed_places(shapes: DataFrame, clusters: int) -> DataFrame:
    """(image_id, k, cy, cx, w, h, s) from (image_id, w, h, s): ``clusters`` seeds of each image, numbered from 0.

    Bands of rows and columns inside them, each seed in the middle of its cell; where the grid has too few cells the
    rest stands in the middle of the image, where it has too many the last ones are left out.
    """
    share = columns_per_band(clusters)
    bands = len(share)
    widths = F.array(*map(F.lit, share))
    grid = shapes.withColumn("band_h", _div_up(F.col("h"), bands))
    grid = grid.withColumn("band", F.explode(F.sequence(F.lit(0), _div_up(F.col("h"), F.col("band_h")) - 1)))
    grid = grid.withColumn("cell_w", _div_up(F.col("w"), F.get(widths, F.least("band", F.lit(bands - 1)))))
    grid = grid.withColumn("across", _div_up(F.col("w"), F.col("cell_w")))
    # the number of a seed: cells of the bands before, and its own; a band's cells follow from its number alone
    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.col("band") - 1, F.lit(0))), lambda i: F.ceil(F.col("w") / F.ceil(F.col("w") / F.get(widths, F.least(i, F.lit(bands - 1))))).cast("int"))
    start = F.when(F.col("band") == 0, 0).otherwise(F.aggregate(cells, F.lit(0), lambda a, c: a + c))
    grid = grid.withColumn("first", start).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    cy = F.least(F.col("band") * F.col("band_h") + F.expr("band_h div 2"), F.col("h") - 1)
    cx = F.least(F.col("cell") * F.col("cell_w") + F.expr("cell_w div 2"), F.col("w") - 1)
    placed = grid.select("image_id", (F.col("first") + F.col("cell")).cast("int").alias("k"), cy.cast("int").alias("cy"), cx.cast("int").alias("cx"), "w", "h", "s").where(F.col("k") < clusters)
    have = placed.groupBy("image_id", "w", "h", "s").agg(F.count("*").cast("int").alias("n")).where(F.col("n") < clusters)
    rest = have.withColumn("k", F.explode(F.sequence(F.col("n"), F.lit(clusters - 1)))).select("image_id", "k", F.expr("cast(h div 2 as int)").alias("cy"), F.expr("cast(w div 2 as int)").alias("cx"), "w", "h", "s")
    return placed.unionByName(rest)


def seed_grid(pixels: DataFrame, clusters: int, shapes: DataFrame | None = None) -> DataFrame:
    """A CLUSTERS table with the colours of the pixels that the seeds stand on, and the columns w, h, s."""
    places = seed_places(image_shapes(pixels, clusters) if shapes is None else shapes, clusters)
    at = pixels.select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "l", "a", "b")
    return places.join(at, ["image_id", "cy", "cx"]).select("image_id", "k", "cx", "cy", "l", "a", "b", F.lit(0).cast("long").alias("num_members"), "w", "h", "s")


def windows(clusters: DataFrame) -> DataFrame:
    """Clusters with their windows: rows top..bottom - 1, columns left..right, and whether the image cuts them off."""
    s, w, h = F.col("s"), F.col("w"), F.col("h")
    out = clusters.withColumns({"top": F.greatest(F.col("cy") - s, F.lit(0)), "bottom": F.least(F.col("cy") + s + 1, h), "left": F.greatest(F.col("cx") - s, F.lit(0)), "right": F.least(F.col("cx") + s, w - 1)})
    return out.withColumn("is_boundary", (F.col("cy") < s) | (F.col("cx") < s) | (F.col("cy") + s + 1 > h) | (F.col("cx") + s > w - 1))
