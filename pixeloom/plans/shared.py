"""Tables that cut lineage, in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster; there it must be set.
Only a session whose tasks all run in the driver's process (tests) may leave it
unset, and uses a temporary folder of its own.
A written table survives lost executors, unlike a cached or locally
checkpointed one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Makes Spark delete an execution's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or in a local session without one a folder made for it.

    RuntimeError on a cluster without one: its machines don't see each other's temporary folders.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pixeloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        place = f"file://{_own[0]}"
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or folder of this application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again from there; its shuffle files go at once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_path` through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written; call it once its results are stored."""
    remove(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    spark.catalog.clearCache()


#: Bytes of texts that one Arrow batch holds: what executors and their Python workers each hold at a time.
BATCH_BYTES = "4m"
_BATCHES, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are bounded by BATCH_BYTES, unless the session has a bound of its own already."""
    if spark.conf.get(_BATCHES, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_BATCHES, BATCH_BYTES)
