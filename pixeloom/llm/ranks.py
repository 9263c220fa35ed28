"""Ranks inside groups of any size, from a range partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeloom.plans.shared import written


def ranked(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... inside each value of the non-null ``key``, in ``order``.

    Rows are dealt out by ranges of (key, order), so a hot key spans many tasks: a rank in the task plus the key's
    rows in earlier tasks.  The number of the task is stored with the row, so it can't change when work is redone.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = written(rows.repartitionByRange(parts, F.col(key), *order).withColumn("_part", F.spark_partition_id()), name)
    here = spread.groupBy(key, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = here.select(key, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = spread.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    return own.join(start, [key, "_part"]).withColumn("rank", F.col("_start") + F.col("_rank")).drop("_part", "_start", "_rank")
