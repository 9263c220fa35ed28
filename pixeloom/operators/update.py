"""Cluster means from the pixels assigned to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeloom.sources.rasters import is_sampled


def rounded_mean(total: Column, n: Column) -> Column:
    """(total + n / 2) / n in integers, for values that aren't negative."""
    return F.floor((total + F.floor(n / 2)) / n).cast("int")


def update(state: DataFrame, clusters: DataFrame, stride: int = 1, start: int = 0) -> DataFrame:
    """Clusters moved to the rounded means of their pixels in rows with y % stride = start.

    A cluster without such pixels stays as it is, its number of members too.  One shuffle, of partial sums.
    """
    rows = state.where(F.col("k").isNotNull() & is_sampled(start, stride))
    sums = rows.groupBy("image_id", "k").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ("y", "x", "l", "a", "b")])
    met = clusters.join(sums, ["image_id", "k"], "left")
    mean = lambda c, old: F.coalesce(rounded_mean(F.col(f"sum_{c}"), F.col("n")), F.col(old)).alias(old)
    rest = [c for c in clusters.columns if c not in ("image_id", "k", "cx", "cy", "l", "a", "b", "num_members")]
    return met.select("image_id", "k", mean("x", "cx"), mean("y", "cy"), mean("l", "l"), mean("a", "a"), mean("b", "b"), F.coalesce("n", "num_members").alias("num_members"), *rest)
