"""Goldens, invariants and comparisons of the two plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixeloom.config import EUCLID, MANHATTAN, Config, ConfigError
from pixeloom.functions import color
from pixeloom.operators import components, seeds, spatial
from pixeloom.operators.assign import assign, assign_theta
from pixeloom.operators.graph import connected_components
from pixeloom.operators.update import update
from pixeloom.plans import local, segment
from pixeloom.sources import rasters

COLORS = {(0, 0, 0): (0, 128, 128), (255, 255, 255): (200, 128, 128), (255, 0, 0): (106, 255, 255), (0, 255, 0): (175, 0, 255), (0, 0, 255): (64, 255, 0), (128, 128, 128): (107, 128, 128), (255, 255, 0): (194, 84, 255), (12, 200, 77): (141, 0, 225)}


def lab_image(spark, width, height):
    rows = color.to_lab(rasters.synthetic(spark, width, height)).toPandas()
    out = np.zeros((height, width, 3), np.int32)
    out[rows.y, rows.x] = rows[["l", "a", "b"]].to_numpy()
    return out


def test_tables():
    gamma, lab = color.gamma_table(), color.lab_table()
    assert gamma[[0, 10, 11, 128, 255]].tolist() == [0, 24, 27, 1768, 8192] and gamma.sum() == 652121
    assert lab[[0, 72, 73, 8192]].tolist() == [1130, 1691, 1698, 8192] and lab.sum() == 50346579
    assert (lab > 0).all()


def test_colors(spark):
    rows = spark.createDataFrame([(0, i, 0, *rgb) for i, rgb in enumerate(COLORS)], "image_id long, y int, x int, r int, g int, b int")
    got = color.to_lab(rows).orderBy("y").collect()
    assert [(r.l, r.a, r.b) for r in got] == list(COLORS.values())


@pytest.mark.parametrize(
    ("w", "h", "k", "s", "bands", "first", "last"),
    [
        (4096, 2160, 2000, 66, 44, [(45, 25), (135, 25), (225, 25)], [(4002, 2159), (4094, 2159)]),
        (64, 48, 24, 11, 4, [(5, 6), (16, 6), (27, 6)], [(49, 42), (60, 42)]),
        (10, 10, 7, 3, 2, [(1, 2), (4, 2), (7, 2)], [(6, 7), (9, 7)]),
        (96, 64, 40, 12, 6, [(7, 5), (21, 5), (35, 5)], [(72, 60), (88, 60)]),
        (17, 5, 6, 3, 2, [(3, 1), (9, 1), (15, 1)], [(9, 4), (15, 4)]),
    ],
)
def test_seed_grid(spark, w, h, k, s, bands, first, last):
    assert len(seeds.columns_per_band(k)) == bands
    shape = spark.createDataFrame([(0, w, h)], "image_id long, w int, h int").withColumn("s", spatial.search_size(F.col("w").cast("long"), F.col("h").cast("long"), k))
    rows = seeds.seed_places(shape, k).orderBy("k").collect()
    at = [(r.cx, r.cy) for r in rows]
    assert [r.k for r in rows] == list(range(k)) and rows[0].s == s and at[:3] == first and at[-2:] == last
    own = local.seeds(np.zeros((h, w, 3), np.int32), k)
    assert [(int(x), int(y)) for y, x in own[:, :2]] == at


def test_filler_seeds_stand_in_the_middle(spark):
    shape = spark.createDataFrame([(0, 3, 2, 1)], "image_id long, w int, h int, s int")
    rows = seeds.seed_places(shape, 9).orderBy("k").collect()
    assert len(rows) == 9 and (rows[-1].cx, rows[-1].cy) == (1, 1)


GOLDEN = {(MANHATTAN, 1): (170286, 24, 18315485), (MANHATTAN, 3): (166720, 24, 19292869), (EUCLID, 1): (159458, 24, 18481670), (EUCLID, 3): (155272, 24, 18205724)}


@pytest.mark.parametrize(("metric", "stride"), list(GOLDEN))
def test_goldens_local(spark, metric, stride):
    labels, best, _ = local.run(lab_image(spark, 64, 48), Config(24, 3, 10.0, 0.25, stride, metric))
    index = np.arange(64 * 48) % 1009 + 1
    assert (best.sum(), len(np.unique(labels)), (labels.ravel() * index).sum()) == GOLDEN[metric, stride]


def test_golden_distributed(spark):
    out = segment.distributed(color.to_lab(rasters.synthetic(spark, 64, 48)), Config(24, 3, 10.0, 0.25, 3, MANHATTAN))
    mark = F.sum(F.col("label") * ((F.col("y") * 64 + F.col("x")) % 1009 + 1))
    assert tuple(out.agg(F.sum("min_dist"), F.countDistinct("label"), mark).first()) == GOLDEN[MANHATTAN, 3]


def test_bucket_join_equals_band_join(spark):
    config = Config(num_of_clusters=24, subsample_stride=1)
    state, shapes = segment.prepared(color.to_lab(rasters.synthetic(spark, 40, 30)), config)
    clusters = seeds.seed_grid(state.select("image_id", "y", "x", "l", "a", "b"), 24, shapes)
    for broadcast in (True, False):
        a = assign(state, clusters, config, 0, 1, broadcast=broadcast).select("image_id", "y", "x", "k", "min_dist")
        b = assign_theta(state, clusters, config)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize(("w", "h"), [(200, 200), (290, 200), (201, 335)])
def test_no_pixel_is_left_unassigned(w, h):
    lab = np.zeros((h, w, 3), np.int32)
    count = max(2, w * h // 1000)
    size = int(np.sqrt(np.float32(w * h) / np.float32(count)))
    config = Config(num_of_clusters=count, subsample_stride=1)
    k, best = np.full((h, w), -1), np.full((h, w), np.iinfo(np.int16).max, np.int16)
    table = local.mirrored(local.spatial_table(size, config), np.int16)
    local.assign([lab[:, :, c].astype(np.int16) for c in range(3)], local.seeds(lab, count), size, table, config, 0, 1, k, best)
    assert (k >= 0).all()


def test_rows_not_sampled_keep_their_cluster(spark):
    config = Config(num_of_clusters=6, subsample_stride=3)
    state, shapes = segment.prepared(color.to_lab(rasters.synthetic(spark, 12, 9)), config)
    clusters = seeds.seed_grid(state.select("image_id", "y", "x", "l", "a", "b"), 6, shapes)
    marked = state.withColumn("k", F.lit(77)).withColumn("min_dist", F.lit(1))
    rows = assign(marked, clusters, config, 1).collect()
    assert all((r.k, r.min_dist) == (77, 1) for r in rows if r.y % 3 != 1) and all(r.k != 77 for r in rows if r.y % 3 == 1)


def test_update_rounds_and_leaves_empty_clusters(spark):
    state = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 0), (0, 1, 3, 2, 3, 4, 0), (0, 1, 4, 9, 9, 9, None)], "image_id long, y int, x int, l int, a int, b int, k int")
    clusters = spark.createDataFrame([(0, 0, 5, 5, 5, 5, 5, 0), (0, 1, 6, 6, 6, 6, 6, 9)], "image_id long, k int, cx int, cy int, l int, a int, b int, num_members long")
    got = [tuple(r) for r in update(state, clusters).orderBy("k").collect()]
    assert got == [(0, 0, 2, 1, 2, 3, 4, 2), (0, 1, 6, 6, 6, 6, 6, 9)]


def brute_components(k):
    h, w = k.shape
    out = np.full((h, w), -1)
    for i in range(h * w):
        if out[i // w, i % w] < 0:
            todo = [(i // w, i % w)]
            out[todo[0]] = i
            while todo:
                y, x = todo.pop()
                for p, q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= p < h and 0 <= q < w and out[p, q] < 0 and k[p, q] == k[y, x]:
                        out[p, q] = i
                        todo.append((p, q))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_and_clean_up(spark, seed):
    rng = np.random.default_rng(seed)
    h, w = 14, 17
    k = rng.integers(-1, 3, (h, w))
    begin, length, first = local.components(k)
    assert np.array_equal(np.repeat(begin[first], length).reshape(h, w), brute_components(k))
    rows = [(0, y, x, int(k[y, x]) if k[y, x] >= 0 else None, w, h, 4) for y in range(h) for x in range(w)]
    state = spark.createDataFrame(rows, "image_id long, y int, x int, k int, w int, h int, s int")
    want = local.connectivity(k, 4, 5, 0.25)
    for one_task in (0, 1000):
        got = {(r.y, r.x): r.label for r in components.enforce_connectivity(state, 5, 0.25, one_task=one_task).collect()}
        assert got == {(y, x): want[y, x] for y in range(h) for x in range(w)}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_graph_components(spark, one_task):
    rng = np.random.default_rng(7)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 230)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges, one_task_edges=one_task).collect()}
    assert got == {x: find(x) for x in {v for a, b in pairs if a != b for v in (a, b)}}
    assert connected_components(edges.limit(0)).isEmpty()


def test_plans_agree_on_many_images(spark):
    px = color.to_lab(rasters.synthetic(spark, 24, 16))
    many = px.unionByName(px.withColumn("image_id", F.lit(5).cast("long")).withColumn("l", 200 - F.col("l")))
    config = Config(num_of_clusters=8, max_iterations=2, subsample_stride=2)
    a, b = local.segment(many, config), segment.distributed(many, config)
    assert a.count() == 2 * 24 * 16
    cols = ["image_id", "y", "x", "label", "min_dist"]
    assert a.select(cols).exceptAll(b.select(cols)).isEmpty()


def test_config_and_raster_errors(spark):
    for bad in ({"num_of_clusters": 1}, {"subsample_stride": 0}, {"compactness": 0}, {"max_iterations": -1}, {"distance_metric": "x"}):
        with pytest.raises(ConfigError):
            Config(**bad)
    for args in ((b"abc", 2, 1), (b"", 0, 1)):
        with pytest.raises(rasters.RasterError):
            rasters.from_bytes(spark, *args)
    with pytest.raises(rasters.RasterError):
        rasters.from_array(spark, [1], 2, 2)


def test_lab_bytes_and_iterator(spark):
    rows = rasters.from_iterator(spark, iter([1, 2, 3, 0, 4, 5, 6, 0]), 2, 1).orderBy("x").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 1, 2, 3), (0, 0, 1, 4, 5, 6)]


def test_tiles_cover_the_raster(spark):
    rows = rasters.tiled(rasters.filled(spark, 0, 19, 11), 4, 3).groupBy("tile_y", "tile_x").count().collect()
    assert len(rows) == 20 and sum(r["count"] for r in rows) == 19 * 11


def test_lab_image_file_round_trip(spark, tmp_path):
    raster = rasters.synthetic(spark, 9, 7)
    rasters.write_png(raster, f"file://{tmp_path}/a.png", 0)
    got = rasters.from_image_files(spark, f"file://{tmp_path}").select("y", "x", "r", "g", "b")
    want = raster.select("y", "x", "r", "g", "b")
    assert got.count() == 63 and got.exceptAll(want).isEmpty()


def test_labels_as_a_png_of_16_bits(spark, tmp_path):
    import struct
    import zlib

    from pixeloom.sources import rasters

    labels = rasters.filled(spark, 0, 5, 2).selectExpr("0L as image_id", "y", "x", "cast((y * 5 + x) * 50 as int) as label")
    path = str(tmp_path / "labels.png")
    rasters.write_png(labels, path, 0, ("label",), maximum=450)
    data = open(path, "rb").read()
    assert struct.unpack(">IIBB", data[16:26]) == (5, 2, 16, 0)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    values = [v for k in range(2) for v in struct.unpack(">5H", raw[k * 11 + 1 : k * 11 + 11])]
    assert values == [int(i * 50 / 450 * 65535) for i in range(10)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from pixeloom.plans import shared

    class Elsewhere:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            shared.shared_folder(Elsewhere)
    assert shared.shared_folder(spark)


def noise(seed, h, w, labels):
    return np.random.default_rng(seed).integers(-1, labels, (h, w))


def as_state(spark, images, size=4):
    rows = [(i, y, x, int(k[y, x]) if k[y, x] >= 0 else None, k.shape[1], k.shape[0], size, y * 50 + x) for i, k in images.items() for y in range(k.shape[0]) for x in range(k.shape[1]) if k[y, x] > -9]
    return spark.createDataFrame(rows, "image_id long, y int, x int, k int, w int, h int, s int, at int")


@pytest.mark.parametrize(("band_pixels", "one_task"), [(1, 0), (34, 1000), (50, 0)])
def test_bands_give_what_the_whole_image_gives(spark, band_pixels, one_task):
    images = {3: noise(5, 14, 17, 3), 8: noise(6, 9, 30, 2), 9: noise(7, 1, 5, 3), 11: np.zeros((12, 10), int)}
    state = as_state(spark, images)
    got = {(r.image_id, r.y, r.x): (r.label, r.at) for r in components.enforce_connectivity(state, 5, 0.25, one_task=one_task, keep=("at",), band_pixels=band_pixels).collect()}
    want = {i: local.connectivity(k, 4, 5, 0.25) for i, k in images.items()}
    assert got == {(i, y, x): (label, y * 50 + x) for i, k in want.items() for (y, x), label in np.ndenumerate(k)}
    first = {i: brute_components(k) for i, k in images.items()}
    number = {i: {int(lead): n for n, lead in enumerate(np.unique(c))} for i, c in first.items()}
    got = {(r.image_id, r.y, r.x): r.comp for r in components.component_pixels(state, band_pixels).collect()}
    assert got == {(i, y, x): number[i][lead] for i, c in first.items() for (y, x), lead in np.ndenumerate(c)}
    got = sorted(tuple(r) for r in components.component_sizes(state, band_pixels).collect())
    assert got == [(i, number[i][lead], lead, n) for i, c in first.items() for lead, n in zip(*(v.tolist() for v in np.unique(c, return_counts=True)), strict=True)]


@pytest.mark.parametrize(("band_pixels", "one_task"), [(1 << 18, 1000), (17, 1000), (17, 0)])
def test_places_without_a_pixel_part_components_and_end_chains(spark, band_pixels, one_task):
    k = noise(9, 13, 17, 2)
    k[np.random.default_rng(2).random(k.shape) < 0.2] = -9
    k[0, 0], k[3, 0], k[4, 0] = 1, -9, 0
    h, w = k.shape
    first = brute_components(k).ravel()
    first[k.ravel() == -9] = -1
    lead, members = np.unique(first[first >= 0], return_counts=True)
    large = sorted(sorted(lead[members >= 4], key=lambda i: (-members[lead == i][0], i))[:6])
    label = {int(i): n for n, i in enumerate(large)}
    label.setdefault(0, 0)
    for i in lead.tolist():
        before = first[i - 1 if i % w else i - w]
        if i not in label:
            label[i] = label.get(int(before))
    got = {(r.y, r.x): r.label for r in components.enforce_connectivity(as_state(spark, {0: k}), 6, 0.25, one_task=one_task, band_pixels=band_pixels).collect()}
    assert None in label.values() and got == {(i // w, i % w): label[f] for i, f in enumerate(first.tolist()) if f >= 0 and label[f] is not None}


def test_clean_up_writes_few_rows(spark, monkeypatch):
    """No table between the stages has rows for pixels, runs or components; rows with one label in many runs aren't paired."""
    from pixeloom.operators import bands, graph

    rows, kept = {}, components.written

    def counted(df, name, *partitions):
        out = kept(df, name, *partitions)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    for module in (components, graph, bands):
        monkeypatch.setattr(module, "written", counted, raising=False)
    k = np.tile(np.arange(60) % 2, (40, 1))
    k[::2] += 2
    assert components.enforce_connectivity(as_state(spark, {0: k}), 5, 0.25).count() == 2400
    assert sum(rows.values()) < 100, rows


def test_numbering_writes_no_more_rows_than_cuts_have_pixels(spark, monkeypatch):
    """Numbers of components come from bands: no table between the stages has a row for a pixel, run or component inside a band."""
    from pixeloom.operators import bands, graph

    rows, kept = {}, components.written

    def counted(df, name, *partitions):
        out = kept(df, name, *partitions)
        rows.setdefault(name, []).append(out.count())
        return out

    for module in (components, graph, bands):
        monkeypatch.setattr(module, "written", counted)
    h, w, per = 45, 60, 6
    k = noise(3, h, w, 3)
    got = {(r.y, r.x): r.comp for r in components.component_pixels(as_state(spark, {0: k}), per * w).collect()}
    first = brute_components(k)
    number = {lead: n for n, lead in enumerate(np.unique(first))}
    assert got == {p: number[lead] for p, lead in np.ndenumerate(first)}
    n, cut = -(-h // per), (-(-h // per) - 1) * w
    assert {name: len(made) for name, made in rows.items()} == {"bands": 1, "edges": 1, "open": 1, "ranks": 1}
    assert rows["bands"] == rows["ranks"] == [n] and 0 < rows["edges"][0] <= cut and 0 < rows["open"][0] <= 2 * cut < len(number)


def test_columns_that_go_along(spark, monkeypatch):
    px = color.to_lab(rasters.synthetic(spark, 24, 16))
    config = Config(num_of_clusters=8, max_iterations=2, subsample_stride=2)
    a = segment.segment(px, config, keep=("l", "b"))
    monkeypatch.setattr(segment, "LOCAL_PIXELS", 10)
    b = segment.segment(px, config, keep=("l", "b"))
    assert a.columns == b.columns == ["image_id", "y", "x", "label", "min_dist", "l", "b"]
    assert a.count() == 24 * 16 and a.exceptAll(b).isEmpty() and b.select("y", "x", "l", "b").exceptAll(px.select("y", "x", "l", "b")).isEmpty()
    # neither the distances nor the colours are joined back to the labels
    own = segment.segment(px, config, keep=("l", "a", "b"))
    for made in (segment.label_stats(own), segment.distributed(px, config)):
        assert not re.search(r"Join .*\by#", made._jdf.queryExecution().optimizedPlan().toString())
    want = segment.segment_stats(px, own.select("image_id", "y", "x", "label"))
    assert segment.label_stats(own).exceptAll(want).isEmpty() and want.exceptAll(segment.label_stats(own)).isEmpty()


@pytest.mark.parametrize(("metric", "clip"), [(EUCLID, True), (MANHATTAN, False)])
def test_assignment_of_batches_equals_the_join(spark, metric, clip):
    """Clusters that go to every task: no join, no expression for every pair of pixel and cluster; the same rows as the shuffled join."""
    rng = np.random.default_rng(4)
    sizes = {-5: 3, 7: 0, 9: 6, 1 << 40: 2}  # the last image has no clusters
    color = lambda: [None if v < 4 else int(v) for v in rng.integers(0, 255, 3)]
    pixels = [(i, y, x, *color(), s, None if y % 2 else 3, 8) for i, s in sizes.items() for y in range(11) for x in range(13)]
    own = [(i, k, int(rng.integers(-4, 15)), int(rng.integers(0, 13)), *color(), s) for i, s in list(sizes.items())[:3] for k in range(25)]
    state = spark.createDataFrame(pixels, "image_id long, y int, x int, l int, a int, b int, s int, k int, min_dist int")
    clusters = spark.createDataFrame(own, "image_id long, k int, cx int, cy int, l int, a int, b int, s int")
    config = Config(num_of_clusters=25, distance_metric=metric, top_clip=clip)
    for start, stride, some in ((0, 1, clusters), (1, 3, clusters), (0, 1, clusters.limit(0))):
        a, b = (assign(state, some, config, start, stride, broadcast=few) for few in (True, False))
        plan = a._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "lambda" not in plan
        rows = lambda d: sorted(d.collect(), key=lambda r: (r.image_id, r.y, r.x))
        assert rows(a) == rows(b) and len(rows(a)) == len(pixels)


@pytest.mark.parametrize("pairs", [1, 40, 1 << 18])
def test_assignment_compares_bounded_numbers_of_pairs(monkeypatch, pairs):
    from pixeloom.operators import assign as module

    monkeypatch.setattr(module, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    lab = rng.integers(0, 255, (30, 40, 3)).astype(np.int64)
    config = Config(num_of_clusters=24, subsample_stride=1)
    size, own = int(np.sqrt(np.float32(1200) / np.float32(24))), local.seeds(lab, 24)
    table = local.spatial_table(size, config)
    kind = local.distance_type(table)
    k, best = np.full((30, 40), -1), np.full((30, 40), np.iinfo(kind).max, kind)
    local.assign([lab[:, :, c].astype(kind) for c in range(3)], own, size, local.mirrored(table, kind), config, 0, 1, k, best)
    clusters = dict(zip(("cy", "cx", "l", "a", "b"), own.T)) | {"k": np.arange(24), "s": np.full(24, size)}
    at = np.random.default_rng(2).permutation(1200)
    pixels = {"image_id": np.zeros(1200, np.int64), "y": at // 40, "x": at % 40, "s": np.full(1200, size)} | {n: lab.reshape(-1, 3)[at, c] for c, n in enumerate("lab")}
    key, covered = module.nearest(module.Buckets(np.zeros(24, np.int64), clusters), config, pixels)
    assert covered.all() and np.array_equal(key & 0xFFFF, k.ravel()[at]) and np.array_equal(key >> 32, best.ravel()[at])


@pytest.mark.parametrize("band_pixels", [1, 34, 1 << 18])
def test_large_components_of_bands(spark, band_pixels):
    """Large ones inside a band and across cuts, ties in size to the earlier one, more of them than wanted."""
    images = {2: noise(11, 14, 17, 2), 4: np.arange(48).reshape(6, 8) // 8, 6: noise(12, 20, 5, 2)}
    want = set()
    for i, k in images.items():
        lead, members = (v.tolist() for v in np.unique(brute_components(k), return_counts=True))
        large = sorted(sorted((n for n in zip(lead, members, strict=True) if n[1] >= 4), key=lambda n: (-n[1], n[0]))[:4])
        want |= {(i, leader, label) for label, (leader, _) in enumerate(large)}
    assert {tuple(r) for r in components.large_labels(as_state(spark, images), 4, 0.25, band_pixels).collect()} == want
