"""Fixed-point sRGB to Lab as column expressions.

Two small tables, computed once on the driver in single precision, become array
literals of the plan, so the conversion stays inside one projection.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the matrix from linear RGB to X, Y, Z, in 16-bit fixed point (fixed values).
XYZ = ((28440, 24656, 12442), (13938, 46868, 4730), (1164, 7175, 57202))
#: Steps of linear light and of the Lab function's table (fixed value).
STEPS = 8192


@functools.cache
def gamma_table() -> np.ndarray:
    """Linear light, in 1/8192, of each sRGB byte."""
    v = np.arange(256) / 255.0
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return (linear.astype(np.float32) * np.float32(STEPS)).astype(np.int64)


@functools.cache
def lab_table() -> np.ndarray:
    """The Lab function of 0..8192 steps, in 1/8192."""
    t = np.arange(STEPS + 1).astype(np.float32) / np.float32(STEPS)
    root = np.power(t.astype(np.float64), np.float64(np.float32(0.333333))).astype(np.float32)
    f = np.where(t < np.float32(0.008856), np.float32(7.787) * t + np.float32(0.137931), root).astype(np.float32)
    return np.floor((f * np.float32(STEPS)).astype(np.float64) + 0.5).astype(np.int64)


def _literal(values: np.ndarray) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values.tolist()))}', ',') as array<int>)")


def srgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L in 0..200, a and b in 0..255 with 128 for neutral, all INT; null where a channel is null."""
    gamma, lab = _literal(gamma_table()), _literal(lab_table())
    light = [F.get(gamma, c.cast("int")) for c in (r, g, b)]
    fx, fy, fz = (F.get(lab, F.shiftright(sum(F.lit(w) * c for w, c in zip(row, light, strict=True)), 16)) for row in XYZ)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c))
    scaled = lambda c: F.shiftright(c + F.lit(128 << 13), 12) - 128
    lightness = F.shiftright(F.lit(116) * fy - F.lit(16 << 13), 12)
    return lightness, clamp(scaled(F.lit(500) * (fx - fy))), clamp(scaled(F.lit(200) * (fy - fz)))


def to_lab(pixels_rgb: DataFrame) -> DataFrame:
    """A PIXELS table from a PIXELS_RGB table; one projection, no shuffle."""
    lightness, a, b = srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels_rgb.select("image_id", "y", "x", lightness.alias("l"), a.alias("a"), b.alias("b"))


def table(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """(i, v) rows of one of the tables above."""
    return spark.range(len(values)).select(F.col("id").cast("int").alias("i"), F.get(_literal(values), F.col("id").cast("int")).alias("v"))


def nonlinear_srgb(v: Column) -> Column:
    """sRGB byte to linear light in 0..1, FLOAT."""
    u = v / F.lit(255.0)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4))).cast("float")


def nonlinear_lab(t: Column) -> Column:
    """The Lab function of a FLOAT in 0..1, FLOAT."""
    f = lambda v: F.lit(v).cast("float")
    return F.when(t < f(0.008856), f(7.787) * t + f(0.137931)).otherwise(F.pow(t.cast("double"), f(0.333333).cast("double")).cast("float"))
