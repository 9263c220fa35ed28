"""The registered segmentation queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeloom import oracle as O
from pixeloom.config import EUCLID, MANHATTAN, Config
from pixeloom.functions import color
from pixeloom.operators import components as cc
from pixeloom.operators import seeds, spatial
from pixeloom.operators.assign import assign
from pixeloom.operators.update import update
from pixeloom.plans import local, segment
from pixeloom.plans.shared import shared_path, written
from pixeloom.sources import rasters as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ONE = Config(num_of_clusters=40, subsample_stride=1, max_iterations=0)
STRIDED = Config(num_of_clusters=40, subsample_stride=3, max_iterations=3)
TWICE = Config(num_of_clusters=40, subsample_stride=1, max_iterations=2, distance_metric=MANHATTAN)
SMALL = Config(num_of_clusters=6, subsample_stride=2, max_iterations=2)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def events_rgb(spark: SparkSession, d: str) -> DataFrame:
    return R.from_events(spark.read.parquet(f"{d}/events.parquet"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return color.to_lab(events_rgb(spark, d))


BASE = (O.EVENTS, O.PIXELS, O.shapes(40), O.places(40), O.CLUSTERS0, O.STATE0)


@query(O.with_(O.EVENTS, select="SELECT * FROM rgb"))
def raster_events(spark, d):
    return events_rgb(spark, d)


@query(O.with_(O.VECTORS, select="SELECT * FROM rgb"))
def raster_embeddings(spark, d):
    return R.from_vectors(spark.read.parquet(f"{d}/embeddings.parquet"))


@query(O.with_(O.synthetic(64, 48), select="SELECT * FROM rgb"))
def raster_synthetic(spark, d):
    return R.synthetic(spark, 64, 48)


@query(O.with_(O.TILES, select="SELECT * FROM rgb"))
def raster_event_tiles(spark, d):
    return R.from_event_tiles(spark.read.parquet(f"{d}/events.parquet"))


@query(O.with_(O.synthetic(40, 30), select="SELECT y, x, r, g, b FROM rgb"))
def image_file_source(spark, d):
    """A raster written as PNG and read again by the image source (blue, green, red there)."""
    path = shared_path(spark, "png") + "/one.png"
    R.write_png(R.synthetic(spark, 40, 30), path, 0)
    return R.from_image_files(spark, path).select("y", "x", "r", "g", "b")


@query("WITH t AS (SELECT unnest([10,20,30,40,50,60,70,80,90,100,110,120]) AS v, generate_subscripts([10,20,30,40,50,60,70,80,90,100,110,120], 1) - 1 AS p) SELECT 0::BIGINT AS image_id, (p // 6)::INT AS y, (p // 3 % 2)::INT AS x, max(v) FILTER (p % 3 = 0)::INT AS r, max(v) FILTER (p % 3 = 1)::INT AS g, max(v) FILTER (p % 3 = 2)::INT AS b FROM t GROUP BY ALL")
def raster_from_bytes(spark, d):
    return R.from_bytes(spark, bytes(range(10, 130, 10)), 2, 2)


@query("SELECT (p // 3)::INT AS y, (p % 3)::INT AS x, p::INT AS value FROM range(6) t(p)")
def raster_from_array(spark, d):
    return R.from_array(spark, list(range(6)), 3, 2)


@query("SELECT (p // 7)::INT AS y, (p % 7)::INT AS x, 65535::INT AS value FROM range(35) t(p)")
def raster_filled(spark, d):
    return R.filled(spark, 65535, 7, 5)


@query(O.with_(O.GAMMA, select="SELECT i, v FROM gamma"))
def lab_gamma_table(spark, d):
    return color.table(spark, color.gamma_table())


@query(O.with_(O.LABF, select="SELECT i, v FROM labf"))
def lab_f_table(spark, d):
    return color.table(spark, color.lab_table())


@query("WITH t AS (SELECT i::INT AS i, CASE WHEN i / 255.0::DOUBLE <= 0.04045::DOUBLE THEN i / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((i / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS lin FROM range(256) r(i)) SELECT i, round(CAST(lin AS FLOAT)::DOUBLE * 1000000)::BIGINT AS micro FROM t")
def scalar_nonlinear_srgb(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("i"), F.round(color.nonlinear_srgb(F.col("id")).cast("double") * 1000000).cast("long").alias("micro"))


@query(O.with_(O.LABF, select="SELECT i, (i * 3 % 7)::INT AS dummy, v FROM labf"))
def scalar_nonlinear_lab(spark, d):
    t = (F.col("id").cast("float") / F.lit(8192)).cast("float")
    v = F.floor((color.nonlinear_lab(t) * F.lit(8192).cast("float")).cast("double") + 0.5).cast("int")
    return spark.range(8193).select(F.col("id").cast("int").alias("i"), (F.col("id") * 3 % 7).cast("int").alias("dummy"), v.alias("v"))


@query(O.with_(O.EVENTS, O.PIXELS, select="SELECT * FROM px"))
def lab_convert(spark, d):
    return events(spark, d)


@query(O.with_(O.VECTORS, O.PIXELS, select="SELECT l, a, b, count(*) AS n FROM px GROUP BY ALL"))
def lab_convert_grey_histogram(spark, d):
    return color.to_lab(R.from_vectors(spark.read.parquet(f"{d}/embeddings.parquet"))).groupBy("l", "a", "b").agg(F.count("*").alias("n"))


@query("SELECT w::INT AS w, h::INT AS h, k::INT AS k, floor(CAST(sqrt(CAST(w * h AS FLOAT) / CAST(k AS FLOAT)) AS FLOAT))::INT AS s FROM (VALUES (4096, 2160, 2000), (64, 48, 24), (10, 10, 7), (96, 64, 40), (17, 5, 6)) t(w, h, k)")
def search_size(spark, d):
    rows = spark.createDataFrame([(4096, 2160, 2000), (64, 48, 24), (10, 10, 7), (96, 64, 40), (17, 5, 6)], "w int, h int, k int")
    return rows.withColumn("s", spatial.search_size(F.col("w"), F.col("h"), F.col("k")))


_LUT = "SELECT i::INT AS i, j::INT AS j, floor((CAST(1 AS FLOAT) / (CAST(29 AS FLOAT) / CAST(10 AS FLOAT)) * CAST(2 AS FLOAT)) * {0})::INT AS d FROM range(59) t(i), range(59) u(j)"


@query(_LUT.format("CAST(abs(i - 29) + abs(j - 29) AS FLOAT)"))
def spatial_lut_manhattan(spark, d):
    return spatial.spatial_lut(spark, 29, Config(distance_metric=MANHATTAN))


@query(_LUT.format("CAST(sqrt(((i - 29) * (i - 29) + (j - 29) * (j - 29))::DOUBLE) AS FLOAT)"))
def spatial_lut_euclid(spark, d):
    return spatial.spatial_lut(spark, 29, Config(distance_metric=EUCLID))


@query(O.with_(*BASE[:5], select="SELECT image_id, k, cx, cy, l, a, b, num_members FROM c0"))
def seed_grid(spark, d):
    return seeds.seed_grid(events(spark, d), 40).drop("w", "h", "s")


@query(O.with_(*BASE[:5], select="SELECT image_id, k, greatest(cy - s, 0) AS top, least(cy + s + 1, h) AS bottom, greatest(cx - s, 0) AS \"left\", least(cx + s, w - 1) AS \"right\", cy < s OR cx < s OR cy + s + 1 > h OR cx + s > w - 1 AS is_boundary FROM c0"))
def seed_window(spark, d):
    return seeds.windows(seeds.seed_grid(events(spark, d), 40)).select("image_id", "k", "top", "bottom", "left", "right", "is_boundary")


@query("SELECT p::INT AS part, (p * 8 + least(p, 4))::INT AS start, ((p + 1) * 8 + least(p + 1, 4))::INT AS \"end\" FROM range(12) t(p)")
def even_split(spark, d):
    return R.even_split(spark, 100, 12)


@query(O.with_(O.EVENTS, select="SELECT (y // 7)::INT AS tile_y, (x // 9)::INT AS tile_x, count(*) AS n, max(y % 7)::INT AS last_y, max(x % 9)::INT AS last_x FROM rgb GROUP BY ALL"))
def tile_grid(spark, d):
    return R.tiled(events_rgb(spark, d), 9, 7).groupBy("tile_y", "tile_x").agg(F.count("*").alias("n"), F.max("local_y").alias("last_y"), F.max("local_x").alias("last_x"))


@query(O.with_(O.EVENTS, select="SELECT * FROM rgb WHERE y = 5 AND x BETWEEN 3 AND 20"))
def row_part(spark, d):
    return R.row_part(events_rgb(spark, d), 5, 3, 20)


@query(O.with_(O.EVENTS, select="SELECT * FROM rgb WHERE y = 4"))
def raster_row(spark, d):
    return R.row(events_rgb(spark, d), 4)


@query(O.with_(O.EVENTS, select="SELECT y, x, y::BIGINT * w + x AS i, ((y::BIGINT * w + x) // w)::INT AS back_y, ((y::BIGINT * w + x) % w)::INT AS back_x FROM rgb, shape"))
def linear_index(spark, d):
    width, _ = R.event_shape(spark.read.parquet(f"{d}/events.parquet"))
    at = events_rgb(spark, d).select("y", "x", R.index_of(F.col("y"), F.col("x"), F.lit(width)).alias("i"))
    y, x = R.place_of(F.col("i"), F.lit(width))
    return at.select("y", "x", "i", y.alias("back_y"), x.alias("back_x"))


@query(O.with_(O.EVENTS, O.PIXELS, select="SELECT * FROM px WHERE y = x"))
def pixel_lookup(spark, d):
    px = events(spark, d)
    return R.pixels_at(px, px.where("y = x"))


@query(O.with_(O.EVENTS, O.PIXELS, select="SELECT y, x, l FROM px WHERE y % 3 = 1"))
def sampled_rows(spark, d):
    return R.sampled_rows(events(spark, d), 1, 3).select("y", "x", "l")


def first_assignment(spark: SparkSession, d: str, config: Config) -> tuple[DataFrame, DataFrame]:
    px = events(spark, d)
    state, shapes = segment.prepared(px, config)
    clusters = seeds.seed_grid(state.select("image_id", "y", "x", "l", "a", "b"), config.num_of_clusters, shapes)
    return state, written(clusters, "clusters")


ASSIGNED = O.with_(*BASE, O.assign(0, 0, ONE, 0, 1), select="SELECT image_id, y, x, k, min_dist FROM s1")


@query(ASSIGNED)
def assign_once(spark, d):
    state, clusters = first_assignment(spark, d, ONE)
    return assign(state, clusters, ONE, 0, 1).select("image_id", "y", "x", "k", "min_dist")


@query(O.with_(*BASE, O.assign(0, 0, TWICE, 0, 1), select="SELECT min_dist, count(*) AS n FROM s1 GROUP BY ALL"))
def min_distance_map(spark, d):
    state, clusters = first_assignment(spark, d, TWICE)
    return assign(state, clusters, TWICE, 0, 1).groupBy("min_dist").agg(F.count("*").alias("n"))


@query(O.with_(*BASE, O.assign(0, 0, STRIDED, 1, 3), select="SELECT image_id, y, x, k, min_dist FROM s1"))
def assign_subsampled(spark, d):
    state, clusters = first_assignment(spark, d, STRIDED)
    return assign(state, clusters, STRIDED, 1, 3).select("image_id", "y", "x", "k", "min_dist")


@query(O.with_(*BASE, O.assign(0, 0, ONE, 0, 1), O.update(1, 0, 0, 1), select="SELECT image_id, k, cx, cy, l, a, b, num_members FROM c1"))
def update_once(spark, d):
    state, clusters = first_assignment(spark, d, ONE)
    return update(assign(state, clusters, ONE, 0, 1), clusters).drop("w", "h", "s")


def _looped(config: Config, table: str) -> str:
    steps, n, m = O.loop(config)
    return O.with_(*BASE, *steps, select="SELECT image_id, y, x, k, min_dist FROM s%d" % n if table == "s" else "SELECT image_id, k, cx, cy, l, a, b, num_members FROM c%d" % m)


@query(_looped(TWICE, "s"))
def iterate_n2(spark, d):
    return segment.iterate(events(spark, d), TWICE)[0].select("image_id", "y", "x", "k", "min_dist")


@query(_looped(STRIDED, "s"))
def iterate_n3_stride3(spark, d):
    return segment.iterate(events(spark, d), STRIDED)[0].select("image_id", "y", "x", "k", "min_dist")


@query(_looped(STRIDED, "c"))
def clusters_n3_stride3(spark, d):
    return segment.iterate(events(spark, d), STRIDED)[1].drop("w", "h", "s")


def assigned(spark: SparkSession, d: str) -> DataFrame:
    state, clusters = first_assignment(spark, d, ONE)
    return written(assign(state, clusters, ONE, 0, 1), "state")


CONNECTED = (*BASE, O.assign(0, 0, ONE, 0, 1), O.edges("s1"), O.connectivity("s1", ONE))


@query(O.with_(*BASE, O.assign(0, 0, ONE, 0, 1), O.edges("s1"), select="SELECT n.image_id, p.y, p.x, CASE WHEN n.j = n.i - 1 THEN 'left' ELSE 'up' END AS toward FROM near n JOIN idx p ON p.image_id = n.image_id AND p.i = n.i"))
def label_edges(spark, d):
    return cc.pixel_edges(assigned(spark, d))


@query(O.with_(*CONNECTED, select="SELECT r.image_id, (r.i // c.w)::INT AS y, (r.i % c.w)::INT AS x, c.comp FROM root r JOIN comp c ON c.image_id = r.image_id AND c.leader = r.r"))
def connected_components(spark, d):
    return cc.component_pixels(assigned(spark, d))


@query(O.with_(*CONNECTED, select="SELECT image_id, comp, leader::BIGINT AS leader, members FROM comp"))
def component_sizes(spark, d):
    return cc.component_sizes(assigned(spark, d))


@query(O.with_(*CONNECTED, select="SELECT image_id, leader::BIGINT AS leader, label FROM big"))
def large_components_topk(spark, d):
    return cc.large_labels(assigned(spark, d), 40, 0.25)


@query(O.with_(*CONNECTED, select="SELECT image_id, y, x, label FROM labels"))
def enforce_connectivity(spark, d):
    return cc.enforce_connectivity(assigned(spark, d), 40, 0.25)


def _full(config: Config, raster: str, final: str) -> str:
    steps, n, _ = O.loop(config)
    base = (raster, O.PIXELS, O.shapes(config.num_of_clusters), O.places(config.num_of_clusters), O.CLUSTERS0, O.STATE0)
    return O.with_(*base, *steps, O.edges(f"s{n}"), O.connectivity(f"s{n}", config), select=final.format(n=n))


@query(_full(STRIDED, O.EVENTS, "SELECT q.image_id, q.y, q.x, label, min_dist FROM labels q JOIN s{n} s ON s.image_id = q.image_id AND s.y = q.y AND s.x = q.x"))
def segment_full(spark, d):
    """The loop and the clean-up as DataFrame operators."""
    return segment.distributed(events(spark, d), STRIDED)


_MEANS = ", ".join(f"((sum(s.{c})::BIGINT + count(*) // 2) // count(*))::INT AS mean_{c}" for c in ("y", "x", "l", "a", "b"))


@query(_full(STRIDED, O.EVENTS, f"SELECT q.image_id, label, count(*) AS members, {_MEANS} FROM labels q JOIN s{{n}} s ON s.image_id = q.image_id AND s.y = q.y AND s.x = q.x GROUP BY ALL"))
def segment_stats(spark, d):
    return segment.label_stats(segment.segment(events(spark, d), STRIDED, keep=("l", "a", "b")))


@query(_full(SMALL, O.TILES, "SELECT image_id, y, x, label FROM labels"))
def segment_many_images(spark, d):
    """Many images at once, one task for each."""
    px = color.to_lab(R.from_event_tiles(spark.read.parquet(f"{d}/events.parquet")))
    return local.segment(px, SMALL).select("image_id", "y", "x", "label")


@query(_full(SMALL, O.TILES, "SELECT image_id, y, x, label FROM labels"))
def segment_many_images_distributed(spark, d):
    px = color.to_lab(R.from_event_tiles(spark.read.parquet(f"{d}/events.parquet")))
    return segment.distributed(px, SMALL).select("image_id", "y", "x", "label")


@query(_full(Config(num_of_clusters=24, max_iterations=3, subsample_stride=3, distance_metric=MANHATTAN), O.synthetic(64, 48), "SELECT label, count(*) AS n FROM labels GROUP BY ALL"))
def segment_synthetic(spark, d):
    px = color.to_lab(R.synthetic(spark, 64, 48))
    return segment.segment(px, Config(num_of_clusters=24, max_iterations=3, subsample_stride=3, distance_metric=MANHATTAN)).groupBy("label").agg(F.count("*").alias("n"))


@query(O.with_(O.EVENTS, select="SELECT * FROM rgb WHERE y = 5 AND x BETWEEN 3 AND 19"))
def row_part_exclusive(spark, d):
    return R.row_part(events_rgb(spark, d), 5, 3, 20, with_right=False)


@query(O.with_(O.EVENTS, select="SELECT * FROM rgb"))
def tile_to_raster(spark, d):
    """Places inside tiles and back to places of the whole raster."""
    tiles = R.tiled(events_rgb(spark, d), 9, 7).drop("y", "x")
    return R.global_place(tiles, 9, 7).select("image_id", "y", "x", "r", "g", "b")


@query(O.with_(O.EVENTS, O.PIXELS, select="SELECT * FROM px"))
def raster_lab_table(spark, d):
    """Pixels that are Lab already, as a table with other columns and types."""
    table = events(spark, d).select(*[F.col(c).cast("long") for c in ("y", "x", "l", "a", "b")], F.lit("x").alias("more"))
    return R.from_lab_table(table)


@query(O.with_(O.TILES, select="SELECT image_id + 5 AS image_id, y, x, r, g, b FROM rgb"))
def raster_rgb_table(spark, d):
    tiles = R.from_event_tiles(spark.read.parquet(f"{d}/events.parquet"))
    return R.from_rgb_table(tiles.withColumn("number", F.col("image_id") + 5).drop("image_id"), "number")


@query("SELECT 0::BIGINT AS image_id, (p // 3)::INT AS y, (p % 3)::INT AS x, (p * 4)::INT AS l, (p * 4 + 1)::INT AS a, (p * 4 + 2)::INT AS b FROM range(6) t(p)")
def raster_lab_iterator(spark, d):
    return R.from_iterator(spark, iter(range(24)), 3, 2)


@query("SELECT * FROM (VALUES ('num_of_clusters', 2000.0::DOUBLE), ('max_iterations', 10.0), ('compactness', 10.0), ('min_size_factor', 0.25), ('subsample_stride', 3.0)) t(name, value)")
def config_defaults(spark, d):
    c = Config()
    return spark.createDataFrame([(n, float(getattr(c, n))) for n in ("num_of_clusters", "max_iterations", "compactness", "min_size_factor", "subsample_stride")], "name string, value double")


@query(O.with_(O.synthetic(3, 3), O.PIXELS, O.shapes(7), O.places(7), O.CLUSTERS0, select="SELECT image_id, k, cx, cy, l, a, b, num_members FROM c0"))
def seed_grid_filled(spark, d):
    """A grid with fewer cells than seeds: the rest stands in the middle."""
    return seeds.seed_grid(color.to_lab(R.synthetic(spark, 3, 3)), 7).drop("w", "h", "s")


UNCLIPPED = Config(num_of_clusters=40, subsample_stride=1, max_iterations=0, top_clip=False)


@query(O.with_(*BASE, O.assign(0, 0, UNCLIPPED, 0, 1), select="SELECT image_id, y, x, k, min_dist FROM s1"))
def assign_without_top_clip(spark, d):
    state, clusters = first_assignment(spark, d, UNCLIPPED)
    return assign(state, clusters, UNCLIPPED, 0, 1).select("image_id", "y", "x", "k", "min_dist")


CLOSED = Config(num_of_clusters=40, subsample_stride=3, max_iterations=2, final_update=True)


def _closed() -> str:
    steps, n, m = O.loop(CLOSED)
    return O.with_(*BASE, *steps, O.update(n, m, 0, 1), select=f"SELECT image_id, k, cx, cy, l, a, b, num_members FROM c{m + 1}")


@query(_closed())
def clusters_final_update(spark, d):
    """Cluster statistics taken once more after the last assignment."""
    return segment.iterate(events(spark, d), CLOSED)[1].drop("w", "h", "s")


#: Starting clusters of the caller's own: every fifth pixel of the diagonal, numbered along it.
_OWN = "c0 AS MATERIALIZED (SELECT px.image_id, (px.y // 5)::INT AS k, px.x AS cx, px.y AS cy, l, a, b, 0::BIGINT AS num_members, w, h, s FROM px JOIN shapes USING (image_id) WHERE px.y = px.x AND px.y % 5 = 2 AND px.y < 100)"


def _own_start() -> str:
    steps, n, _ = O.loop(TWICE)
    return O.with_(O.EVENTS, O.PIXELS, O.shapes(40), _OWN, O.STATE0, *steps, select=f"SELECT image_id, y, x, k, min_dist FROM s{n}")


@query(_own_start())
def iterate_own_clusters(spark, d):
    px = events(spark, d)
    own = px.where((F.col("y") == F.col("x")) & (F.col("y") % 5 == 2) & (F.col("y") < 100)).select("image_id", F.expr("cast(y div 5 as int)").alias("k"), F.col("x").alias("cx"), F.col("y").alias("cy"), "l", "a", "b", F.lit(0).cast("long").alias("num_members"))
    return segment.iterate(px, TWICE, own)[0].select("image_id", "y", "x", "k", "min_dist")


@query(O.with_(*CONNECTED, select="SELECT image_id, (sum(label) // count(label))::BIGINT AS average FROM labels GROUP BY ALL"))
def label_average(spark, d):
    return R.average(cc.enforce_connectivity(assigned(spark, d), 40, 0.25), "label")


@query(O.with_(*CONNECTED, select="SELECT image_id, y, x, label FROM labels"))
def label_table_sink(spark, d):
    """Labels written as a table with a folder for each image, and read again."""
    path = shared_path(spark, "labels")
    R.write_labels(cc.enforce_connectivity(assigned(spark, d), 40, 0.25), path)
    return spark.read.parquet(path).select(F.col("image_id").cast("long"), "y", "x", "label")


@query("SELECT (i // 40)::INT AS y, (i % 40)::INT AS x, (i % 256)::INT AS grey FROM range(1200) t(i)")
def label_image_sink(spark, d):
    """Labels written as a grey PNG of 8 bits (modulo 256) and read again by the image source."""
    path = shared_path(spark, "png") + "/labels.png"
    labels = R.filled(spark, 0, 40, 30).select(F.lit(0).cast("long").alias("image_id"), "y", "x", R.index_of(F.col("y"), F.col("x"), F.lit(40)).cast("int").alias("label"))
    R.write_png(labels, path, 0, ("label",))
    return R.from_image_files(spark, path).select("y", "x", F.col("r").alias("grey"))
