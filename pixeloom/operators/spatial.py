"""Search sizes and the spatial part of the distance, in single precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeloom.config import MANHATTAN, Config


def _float(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def search_size(width: Column, height: Column, clusters: int | Column) -> Column:
    """S: half the side of a cluster's window; the root of the pixels per cluster, cut to an integer."""
    area = (width.cast("long") * height).cast("float")
    return F.sqrt((area / _float(clusters)).cast("float")).cast("float").cast("int")


def spatial_weight(size: Column, compactness: float) -> Column:
    """Distance per pixel of offset, FLOAT; null where the window has no extent."""
    step = (size.cast("float") / _float(compactness)).cast("float")
    return F.when(size > 0, (_float(1) / step).cast("float") * _float(2))


def spatial_distance(dx: Column, dy: Column, weight: Column, metric: str) -> Column:
    """Cut to an integer in 0..65535; 0 where there is no weight (a window of one pixel)."""
    offset = (dx + dy).cast("float") if metric == MANHATTAN else F.hypot(dx.cast("double"), dy.cast("double")).cast("float")
    return F.when(weight.isNull(), 0).otherwise(F.least(F.floor(weight * offset), F.lit(65535))).cast("int")


def spatial_lut(spark: SparkSession, size: int, config: Config) -> DataFrame:
    """(i, j, d): the distance of each place of a window from its centre; i and j in 0..2S."""
    side = 2 * size + 1
    flat = spark.range(side * side).select(F.expr(f"cast(id div {side} as int)").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    weight = spatial_weight(F.lit(size), config.compactness)
    return flat.select("i", "j", spatial_distance(F.abs(F.col("i") - size), F.abs(F.col("j") - size), weight, config.distance_metric).alias("d"))


def image_shapes(pixels: DataFrame, clusters: int) -> DataFrame:
    """(image_id, w, h, s) of each image."""
    shapes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return shapes.withColumn("s", search_size(F.col("w"), F.col("h"), clusters))
