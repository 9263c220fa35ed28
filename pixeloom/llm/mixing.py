"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document has the same expected number of copies, its
source's target over its source's size.  The documents of a source stand in
order of size, so their running sum of expected copies is their rank times that
rate; with one offset drawn for the source, a document is taken once for each
integer that the sum crosses.  Ordering by size keeps the words taken near the
target: every stretch of like-sized documents is sampled at the same rate.

Ranks come from a range partitioning by (source, size, id), which cuts a hot
source into many tasks: a rank inside the partition plus the rows of the same
source in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeloom.plans.shared import written

#: Weights of the sources in order, repeating (fixed values of the mix).
WEIGHTS = (1, 2, 3)
#: A source's target stops at so many times its size.
MOST = 3


def word_count(text: Column) -> Column:
    """The number of runs of characters other than the six spaces; null counts 0."""
    plain = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(plain, "[\\x20\\x09-\\x0D]+"))
    ends = plain.rlike("^[\\x20\\x09-\\x0D]").cast("int") + F.substring(plain, -1, 1).rlike("[\\x20\\x09-\\x0D]").cast("int")
    return F.when(plain == "", 0).otherwise(parts - ends).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): weight and target of each source.

    All sizes are shared by weight; a target stops at ``most`` times its source's size and the excess is
    reshared by weight until none is above.  That fixed point is a water level: sources in order of
    ``most * size / weight`` are full up to one of them, and the others get the level times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    given = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    filled = Window.orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    up_to, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = given.select("*", F.sum("source_size").over(everything).alias("all"), F.sum("weight").over(everything).alias("weights"), F.coalesce(F.sum(most * F.col("source_size")).over(up_to), F.lit(0)).alias("full"), F.coalesce(F.sum("weight").over(up_to), F.lit(0)).alias("done"))
    level = level.withColumn("level", (F.col("all") - F.col("full")) / (F.col("weights") - F.col("done")))
    # the first source, in filling order, whose cap is not below the level fixes it
    fits = level.withColumn("place", F.when(most * F.col("source_size") >= F.col("level") * F.col("weight"), F.row_number().over(filled)))
    fits = fits.withColumn("level", F.min_by("level", "place").over(everything))
    return fits.select("source", "source_size", "weight", F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): from a digest, so that reruns and engines agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document and ``taken`` the words that makes.  Null texts have
    size 0; a null source is a source of its own, last in order; documents of size 0 can be taken and add
    nothing; a source whose size is 0 has target 0 and is not taken.  Repeated rows are documents like others
    (ties in rank are broken by id, and rows alike in all three may swap their equal copies).  An empty table
    gives an empty result; other columns of any name are ignored.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    # two columns are all that is dealt out; the partition number is stored with the row, so it can't change later
    spread = written(sized, "mix-sizes")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = written(spread.repartitionByRange(parts, F.col("source").asc_nulls_last(), "size", F.col("id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "mix-order")
    here = spread.groupBy("source", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = here.select("source", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    aims = targets(here.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = start.alias("s").join(aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select(F.col("s.source").alias("p_source"), F.col("part").alias("p_part"), "start", "source_size", "target")
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("source", "part").orderBy("size", F.col("id").asc_nulls_first())))
    rows = ranked.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place, u = F.col("start") + F.col("rank"), offset(F.col("source"), seed)
    copies = F.floor(place * rate + u) - F.floor((place - 1) * rate + u)
    return rows.withColumn("copies", F.least(F.lit(most), copies)).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("copies").cast("long"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))

