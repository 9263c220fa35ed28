"""Exact deduplication as a stateful stream with disk-backed keyed state (DataFrame functions only).

Arrivals are small rows: digest, code points, identifier, and the content
locator (file and row in it).  A streaming aggregation without watermark keeps
one state row for each digest for good, in RocksDB, so the state lies on disk
and in the stream's checkpoint: the best arrival so far (its stable identifier
and locator) and the number of arrivals.  Texts enter the state nowhere.  With a
folder of its own the state outlives a call, and later tables arrive on top.

Digest hits are then checked on full bytes.  Their locators become bitmaps of
rows by file, small enough to be sent to every task, and only the located texts
are read: the least and the greatest text of a digest are the same, or the
digest stands for several texts and is resolved by grouping on the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeloom.plans.shared import shared_path, written

#: The characters that normalisation deletes (fixed values).
SPACES = " \t\n\x0b\x0c\r"
#: How the stream keeps its state: on disk, with a task's store closed once it is committed to the checkpoint.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Bitmaps (4 KB for 32768 rows of a file) up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BITMAPS = 16_384


def normalised(text: Column) -> Column:
    """The text without any of the six space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` where its rows are those of files, so that a file and a row number locate one; else written to such files."""

    def plain(node) -> bool:
        return node.nodeName() in ("LogicalRelation", "Filter", "SubqueryAlias") and all(plain(node.children().apply(i)) for i in range(node.children().size()))

    return docs if docs.inputFiles() and plain(docs._jdf.queryExecution().analyzed()) else written(docs, "dedup-input")


def located(docs: DataFrame) -> tuple[Column, Column]:
    """File and row of each of a stored table's rows, whatever its columns are called."""
    about = docs.metadataColumn("_metadata")
    return about["file_path"], about["row_index"]


def free(docs: DataFrame) -> str:
    """A beginning of names that none of the table's columns has."""
    out = "xd__"
    while any(c.lower().startswith(out) for c in docs.columns):
        out += "_"
    return out


def bitmaps(places: DataFrame, own: str) -> DataFrame:
    """Located rows (file, row) as bitmaps of 32768 rows of a file; broadcast where they are few."""
    at = F.col("row") + 1
    made = places.select(F.col("file").alias(f"{own}f"), F.bitmap_bucket_number(at).alias(f"{own}b"), F.bitmap_bit_position(at).alias("bit"))
    made = written(made.groupBy(f"{own}f", f"{own}b").agg(F.bitmap_construct_agg("bit").alias(f"{own}bits")), "dedup-bitmaps")
    return F.broadcast(made) if made.limit(BROADCAST_BITMAPS + 1).count() <= BROADCAST_BITMAPS else made


def marked(docs: DataFrame, places: DataFrame, keep: bool) -> DataFrame:
    """The rows of a stored table that ``places`` (file, row) locates; with ``keep`` False the others."""
    file, row = located(docs)
    own = free(docs)
    columns = [docs[f"`{c}`"] for c in docs.columns]
    at = docs.select(*columns, file.alias(f"{own}file"), (row + 1).alias(f"{own}at")).withColumn(f"{own}bucket", F.bitmap_bucket_number(f"{own}at"))
    met = at.join(bitmaps(places, own), (F.col(f"{own}file") == F.col(f"{own}f")) & (F.col(f"{own}bucket") == F.col(f"{own}b")), "inner" if keep else "left")
    place = F.bitmap_bit_position(f"{own}at")
    byte = F.conv(F.hex(F.substring(f"{own}bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.where(on if keep else F.coalesce(~on, F.lit(True)))


def arrive(spark: SparkSession, arrivals: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """This call's arrivals as they were stored, and the state of each of their digests after them.

    The state is one row for each digest: ``best`` (the arrival with the most code points, then the smallest id, of
    this call and all before it) and ``n``.
    """
    call = uuid.uuid4().hex
    arrivals.write.parquet(f"{base}/arrivals/{call}")
    own = spark.read.schema(arrivals.schema).parquet(f"{base}/arrivals/{call}")
    before = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        state = spark.readStream.schema(arrivals.schema).parquet(f"{base}/arrivals/*").groupBy("digest").agg(F.min(_order()).alias("best"), F.count("*").alias("n"))
        # only the digests that a batch touches leave the state; a batch that is done again writes the same folder
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/touched/{call}/{n}")).start()
        query.awaitTermination()
        batches = len(query.recentProgress)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if own.isEmpty():
        return own, spark.createDataFrame([], state.schema)
    touched = spark.read.schema(state.schema).parquet(f"{base}/touched/{call}/*")
    if batches > 1:  # a digest that several batches touched: its last row counts most arrivals
        touched = touched.groupBy("digest").agg(F.max_by("best", "n").alias("best"), F.max("n").alias("n"))
    return own, touched


def _order() -> Column:
    return F.struct((-F.col("size")).alias("less"), "id", "file", "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, and its locator: file, row.

    Texts are equal when they are identical without their space characters; null counts as empty, so null,
    empty and blank texts are one group.  Of equal texts the row with the most code points stays, then the
    smallest id (null first); of repeated rows with one id exactly one has ``kept``.  An empty table gives an
    empty result; other columns of any name are ignored.

    ``state`` is a folder in shared storage that keeps the state from call to call: groups then span all tables that
    have arrived, ``keep_id`` may be a row of an earlier one, and a row of an earlier one that no longer stays isn't
    returned again.  Tables that aren't files of their own are written there first, as locators must hold.
    """
    spark = docs.sparkSession
    base = state or shared_path(spark, "dedup-state")
    docs = stored(docs)
    file, row = located(docs)
    norm = normalised(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), file.alias("file"), row.alias("row"), F.length(F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))).cast("long").alias("size"), digest(norm).alias("digest"))
    keys, seen = arrive(spark, rows, base)
    hits = written(seen.where("n > 1"), "dedup-hits")
    # full bytes of the located texts: of this call's hits, and of what an earlier call left as the best
    places = keys.join(hits.select("digest"), "digest", "left_semi").select("file", "row")
    best = hits.select(F.col("best.file").alias("file"), F.col("best.row").alias("row"))
    texts = _texts(marked(docs, places, True), norm, digest)
    if state is not None:
        older = best.join(keys.select("file", "row"), ["file", "row"], "left_anti")
        texts = texts.unionByName(_fetched(older, docs, id_col, text_col, digest))
    judged = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    false = written(judged.where("low != high").select("digest"), "dedup-false")
    done = _verdicts(keys, seen, ["digest"])
    if not false.isEmpty():
        done = done.join(false, "digest", "left_anti").select(*done.columns).unionByName(_by_text(spark, docs, keys, base, id_col, text_col, digest, false))
    return done.withColumnRenamed("id", id_col)


def _verdicts(keys: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return keys.join(groups, by).select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "digest", "file", "row")


def _texts(rows: DataFrame, norm: Column, digest: Callable[[Column], Column]) -> DataFrame:
    return rows.select(norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def _fetched(places: DataFrame, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], with_place: bool = False) -> DataFrame:
    """(norm, digest) of located rows, also of tables of earlier calls; their files are as many as a scan of them has."""
    places = written(places, "dedup-places")
    files = [r.file for r in places.select("file").distinct().collect()]
    norm = normalised(F.col(f"`{text_col}`").cast("string"))
    if not files:
        return _texts(docs.limit(0), norm, digest) if not with_place else None
    table = docs.sparkSession.read.parquet(*files)
    found = marked(table, places, True)
    if not with_place:
        return _texts(found, norm, digest)
    return found.select(F.col(f"`{id_col}`").alias("id"), F.col(f"{free(table)}file").alias("file"), (F.col(f"{free(table)}at") - 1).alias("row"), norm.alias("norm"), F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long").alias("size")).withColumn("digest", digest(F.col("norm")))


def _by_text(spark: SparkSession, docs: DataFrame, keys: DataFrame, base: str, id_col: str, text_col: str, digest: Callable[[Column], Column], false: DataFrame) -> DataFrame:
    """The same result for the digests that stand for several texts, from the texts of all that arrived with them."""
    every = spark.read.schema(keys.schema).parquet(f"{base}/arrivals/*").join(false, "digest", "left_semi")
    own = written(_fetched(every.select("file", "row"), docs, id_col, text_col, digest, True), "dedup-texts")
    best = own.groupBy("digest", "norm").agg(F.min(_order()).alias("best"), F.count("*").alias("n"))
    own = own.join(keys.select("file", "row"), ["file", "row"], "left_semi")
    return _verdicts(own, best, ["digest", "norm"])


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`exact_dedup` keeps: one of each group of equal texts."""
    docs = stored(docs)
    verdicts = exact_dedup(docs, id_col, text_col)
    return marked(docs, verdicts.where("not kept").select("file", "row"), False).select(*[F.col(f"`{c}`") for c in docs.columns])
