"""Rasters from tables, files and rules, and label sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RasterError(ValueError):
    """Sizes that don't fit together."""


def _int(*columns: tuple[str, Column]) -> list[Column]:
    return [c.cast("int").alias(n) for n, c in columns]


def from_rgb_table(df: DataFrame, image_id: str | None = None) -> DataFrame:
    """A PIXELS_RGB table from columns y, x, r, g, b (and ``image_id``, else image 0)."""
    key = F.lit(0) if image_id is None else F.col(image_id)
    return df.select(key.cast("long").alias("image_id"), *[F.col(c).cast("int") for c in ("y", "x", "r", "g", "b")])


def from_lab_table(df: DataFrame, image_id: str | None = None) -> DataFrame:
    """A PIXELS table from columns y, x, l, a, b that hold Lab already."""
    key = F.lit(0) if image_id is None else F.col(image_id)
    return df.select(key.cast("long").alias("image_id"), *[F.col(c).cast("int") for c in ("y", "x", "l", "a", "b")])


def from_bytes(spark: SparkSession, data: bytes, width: int, height: int, channels: int = 3) -> DataFrame:
    """A PIXELS_RGB (3 channels) or PIXELS (4: L, a, b and padding) table of one image from packed row-major bytes.

    RasterError where the sizes aren't positive or the data has another length.
    """
    if width < 1 or height < 1 or channels not in (3, 4) or len(data) != channels * width * height:
        raise RasterError(f"{len(data)} bytes are no {width} x {height} image of {channels} channels")
    rows = spark.createDataFrame([(y, bytearray(data[y * width * channels : (y + 1) * width * channels])) for y in range(height)], "y int, row binary")
    return _exploded(rows.withColumn("image_id", F.lit(0).cast("long")), F.lit(width), channels, ("r", "g", "b") if channels == 3 else ("l", "a", "b"))


def from_iterator(spark: SparkSession, values: Iterator[int], width: int, height: int) -> DataFrame:
    """As :func:`from_bytes` of Lab pixels, from an iterator over bytes."""
    return from_bytes(spark, bytes(values), width, height, 4)


def _exploded(rows: DataFrame, width: Column, channels: int, names: tuple[str, str, str]) -> DataFrame:
    """Pixels of (image_id, y, row) rows, each holding one raster row's bytes."""
    byte = lambda k: F.conv(F.hex(F.substring("row", (F.col("x") * channels + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("x", F.explode(F.sequence(F.lit(0), width - 1)))
    return out.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), *[byte(k).alias(n) for k, n in enumerate(names)])


def from_image_files(spark: SparkSession, path: str) -> DataFrame:
    """A PIXELS_RGB table of the JPEG and PNG files under ``path``; ``image_id`` numbers them by their URI's hash.

    Spark's image source holds blue, green, red; grey images give equal channels; files it can't read are left out.
    Pixels are unpacked in Arrow batches, one raster row at a time, by the executors that read the files.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                h, w, c = row["height"], row["width"], row["nChannels"]
                data = np.frombuffer(row["data"], np.uint8).reshape(h, w, c).astype(np.int32)
                red, green, blue = (data[:, :, k] for k in ((2, 1, 0) if c >= 3 else (0, 0, 0)))
                for y in range(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(w, row["image_id"])), pa.array(np.full(w, y, np.int32)), pa.array(np.arange(w, dtype=np.int32)), *(pa.array(np.ascontiguousarray(v[y])) for v in (red, green, blue))], ["image_id", "y", "x", "r", "g", "b"])

    return images.mapInArrow(run, "image_id long, y int, x int, r int, g int, b int")


def filled(spark: SparkSession, value: int, width: int, height: int) -> DataFrame:
    """(y, x, value): a constant raster."""
    return spark.range(width * height).select(*_int(("y", F.expr(f"id div {width}")), ("x", F.col("id") % width), ("value", F.lit(value))))


def from_array(spark: SparkSession, values: list[int], width: int, height: int) -> DataFrame:
    """(y, x, value) from a flat row-major list; RasterError where its length isn't width * height."""
    if len(values) != width * height:
        raise RasterError(f"{len(values)} values are no {width} x {height} array")
    flat = spark.createDataFrame([(values,)], "v array<int>").select(F.posexplode("v"))
    return flat.select(*_int(("y", F.expr(f"pos div {width}")), ("x", F.col("pos") % width)), F.col("col").alias("value"))


def synthetic(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A smooth gradient with a checker in blue, as image 0."""
    flat = spark.range(width * height).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))
    return flat.select(F.lit(0).cast("long").alias("image_id"), *_int(("y", F.col("y")), ("x", F.col("x")), ("r", F.col("x") * 4 % 256), ("g", F.col("y") * 5 % 256), ("b", F.expr("((x div 8 + y div 8) % 2) * 255"))))


#: The event types in order, for the blue channel of event rasters (fixed values).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _event_channels() -> list[Column]:
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return _int(("r", F.floor("value") % 256), ("g", F.col("user_id") * 17 % 256), ("b", kind * 51))


def event_shape(events: DataFrame) -> tuple[int, int]:
    """Width and height of the raster of all events: the largest square-like one that they fill."""
    n = events.count()
    width = int(n**0.5)
    return width, (n // width if width else 0)


def from_events(events: DataFrame) -> DataFrame:
    """One image of all events in order of their dense ids; the rest of the last row is left out."""
    width, height = event_shape(events)
    flat = events.withColumns({"y": F.expr(f"event_id div {max(1, width)}"), "x": F.col("event_id") % max(1, width)}).where(F.col("y") < height)
    return flat.select(F.lit(0).cast("long").alias("image_id"), *_int(("y", F.col("y")), ("x", F.col("x"))), *_event_channels())


def from_event_tiles(events: DataFrame, side: int = 16) -> DataFrame:
    """Many images of ``side`` by ``side`` events; the last, partial one is left out."""
    area = side * side
    whole = events.count() // area
    flat = events.withColumns({"image_id": F.expr(f"event_id div {area}"), "at": F.col("event_id") % area}).where(F.col("image_id") < whole)
    return flat.select(F.col("image_id").cast("long"), *_int(("y", F.expr(f"at div {side}")), ("x", F.col("at") % side)), *_event_channels())


def from_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One grey image with a row for each vector."""
    grey = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("col").cast("double") * 200) + 128)).cast("int")
    flat = vectors.select(F.col(id_col).cast("int").alias("y"), F.posexplode(vector_col)).select(F.lit(0).cast("long").alias("image_id"), "y", F.col("pos").alias("x"), grey.alias("grey"))
    return flat.select("image_id", "y", "x", F.col("grey").alias("r"), F.col("grey").alias("g"), F.col("grey").alias("b"))


def even_split(spark: SparkSession, length: int, parts: int) -> DataFrame:
    """(part, start, end): contiguous ranges, end exclusive, the first ``length % parts`` one longer."""
    small, more = divmod(length, parts)
    return spark.range(parts).select(*_int(("part", F.col("id")), ("start", F.col("id") * small + F.least("id", F.lit(more))), ("end", (F.col("id") + 1) * small + F.least(F.col("id") + 1, F.lit(more)))))


def tiled(raster: DataFrame, tile_width: int, tile_height: int) -> DataFrame:
    """The raster with each pixel's tile and place inside it: tile_y, tile_x, local_y, local_x."""
    return raster.select("*", *_int(("tile_y", F.expr(f"y div {tile_height}")), ("tile_x", F.expr(f"x div {tile_width}")), ("local_y", F.col("y") % tile_height), ("local_x", F.col("x") % tile_width)))


def row(raster: DataFrame, y: int) -> DataFrame:
    return raster.where(F.col("y") == y)


def row_part(raster: DataFrame, y: int, left: int, right: int, with_right: bool = True) -> DataFrame:
    """Pixels left..right of a row; the left one is included, the right one unless ``with_right`` is False."""
    return raster.where((F.col("y") == y) & F.col("x").between(left, right if with_right else right - 1))


def is_sampled(start: int, stride: int) -> Column:
    """Whether a pixel's row is one of start, start + stride, ..."""
    return F.lit(True) if stride == 1 else F.col("y") % stride == start


def sampled_rows(raster: DataFrame, start: int, stride: int) -> DataFrame:
    return raster.where(is_sampled(start, stride))


def average(raster: DataFrame, column: str) -> DataFrame:
    """(image_id, average): the mean of a column's values, cut to an integer."""
    return raster.groupBy("image_id").agg(F.sum(F.col(column).cast("long")).alias("total"), F.count(column).alias("n")).select("image_id", F.expr("total div n").cast("long").alias("average"))


def pixels_at(raster: DataFrame, places: DataFrame) -> DataFrame:
    """The raster's pixels at (image_id, y, x) rows."""
    return raster.join(places.select("image_id", "y", "x"), ["image_id", "y", "x"])


def index_of(y: Column, x: Column, width: Column) -> Column:
    return (y.cast("long") * width + x).cast("long")


def place_of(index: Column, width: Column) -> tuple[Column, Column]:
    """Row and column of a linear index."""
    return F.floor(index / width).cast("int"), (index % width).cast("int")


def global_place(tiles: DataFrame, tile_width: int, tile_height: int) -> DataFrame:
    """Rows with tile_y, tile_x, local_y, local_x and their places in the whole raster: y, x."""
    return tiles.withColumns({"y": (F.col("tile_y") * tile_height + F.col("local_y")).cast("int"), "x": (F.col("tile_x") * tile_width + F.col("local_x")).cast("int")})


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as Parquet, a folder for each image."""
    labels.write.mode("overwrite").partitionBy("image_id").parquet(path)


def write_png(raster: DataFrame, path: str, image_id: int, columns: tuple[str, ...] = ("r", "g", "b"), maximum: int | None = None) -> None:
    """One image as a PNG through Spark's file system layer: one column is grey, three are RGB.

    With ``maximum``, a grey value v is scaled to v / maximum * 65535 in 16 bits, else taken modulo 256.  Meant for
    looking at one image: its rows are gathered one by one, in order.
    """
    own = raster.where(F.col("image_id") == image_id)
    rows = own.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", *columns))).alias("row")).orderBy("y")
    body, width, height = zlib.compressobj(), 0, 0
    packed = b""
    for r in rows.toLocalIterator():
        values = [v for p in r["row"] for v in p[1:]]
        width, height = len(r["row"]), height + 1
        line = b"".join(struct.pack(">H", min(65535, int(v / maximum * 65535))) for v in values) if maximum else bytes(v % 256 for v in values)
        packed += body.compress(b"\0" + line)
    packed += body.flush()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 16 if maximum else 8, 2 if len(columns) == 3 else 0, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")
    spark = raster.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(png))
    finally:
        stream.close()
