"""Segmentation of one whole image in a task, with numpy.

Same rules and same results as the DataFrame operators; used for images that fit
a task.  Windows are visited in order of (row, number), and a pixel's key holds
its distance and the place in that order, so that the least key settles ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixeloom.config import MANHATTAN, Config
from pixeloom.operators.seeds import columns_per_band


def seeds(lab: np.ndarray, count: int) -> np.ndarray:
    """Rows (cy, cx, l, a, b, members)."""
    h, w, _ = lab.shape
    share = columns_per_band(count)
    band = -(-h // len(share))
    places = []
    for top in range(0, h, band):
        cell = -(-w // share[min(top // band, len(share) - 1)])
        places += [(min(top + band // 2, h - 1), min(left + cell // 2, w - 1)) for left in range(0, w, cell)]
    places = places[:count] + [(h // 2, w // 2)] * (count - len(places))
    at = np.array(places, np.int64)
    return np.column_stack([at, lab[at[:, 0], at[:, 1]], np.zeros(count, np.int64)])


def spatial_table(size: int, config: Config) -> np.ndarray:
    """Distances by (dy, dx), 0..2S each."""
    if size <= 0:
        return np.zeros((1, 1), np.int64)
    weight = np.float32(1) / (np.float32(size) / np.float32(config.compactness)) * np.float32(2)
    dy, dx = np.mgrid[: 2 * size + 1, : size + 1]
    offset = (dx + dy).astype(np.float32) if config.distance_metric == MANHATTAN else np.hypot(dx.astype(np.float64), dy).astype(np.float32)
    return np.minimum(np.floor(weight * offset), 65535).astype(np.int64)


def mirrored(table: np.ndarray, kind: type) -> np.ndarray:
    """Distances by (dy + 2S, dx + S) for offsets of either sign, so that a window's distances are a slice."""
    half = np.concatenate([table[:0:-1], table])
    return np.ascontiguousarray(np.concatenate([half[:, :0:-1], half], axis=1), kind)


def distance_type(table: np.ndarray) -> type:
    """The narrowest integers that hold every distance, with a value above them to start from."""
    return np.int16 if table.max() + 3 * 255 < np.iinfo(np.int16).max else np.int32


def assign(planes: list[np.ndarray], clusters: np.ndarray, size: int, table: np.ndarray, config: Config, start: int, stride: int, k: np.ndarray, best: np.ndarray) -> None:
    """Of sampled rows, ``k`` and ``best`` (of distance_type) become those of the nearest cluster.

    ``planes`` are the Lab channels, each (h, w) of distance_type; ``table`` is mirrored.  The least key of distance
    and place in the order of visits is a pixel's cluster.
    """
    h, w = planes[0].shape
    kind = best.dtype
    order = np.lexsort((np.arange(len(clusters)), clusters[:, 0]))
    bits = max(1, int(len(order) - 1).bit_length())
    wide = np.int32 if (int(table.max()) + 3 * 255 + 1) << bits <= np.iinfo(np.int32).max else np.int64
    sampled = [plane[start::stride] for plane in planes]
    near = np.full(sampled[0].shape, np.iinfo(wide).max, wide)
    # one window's work, kept from cluster to cluster
    room = [np.empty((2 * size + 1) ** 2, t) for t in (kind, kind, wide)]
    for place, number in enumerate(order):
        cy, cx, *color = clusters[number, :5].tolist()
        # rows start + i * stride of the window
        first, last = -(-(max(cy - size, 0) - start) // stride), -(-(min(cy + size + 1, h) - start) // stride)
        first = max(first, 0)
        if first >= last:
            continue
        left, right = max(cx - size, 0), min(cx + size, w - 1) + 1
        away = start + first * stride - (max(cy, size) if config.top_clip else cy) + 2 * size
        shape = (last - first, right - left)
        d, part, key = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
        np.copyto(d, table[away : away + (shape[0] - 1) * stride + 1 : stride, left - cx + size : right - cx + size])
        for plane, value in zip(sampled, color, strict=True):
            np.subtract(plane[first:last, left:right], kind.type(value), out=part)
            d += np.abs(part, out=part)
        np.left_shift(d, bits, out=key, dtype=wide)
        key += wide(place)
        old = near[first:last, left:right]
        np.minimum(old, key, out=old)
    met = near != np.iinfo(wide).max
    np.copyto(k[start::stride], order.astype(k.dtype)[near & ((1 << bits) - 1) if met.all() else np.where(met, near & ((1 << bits) - 1), 0)], where=met)
    best[start::stride] = np.where(met, near >> bits, np.iinfo(kind).max)


def update(planes: list[np.ndarray], clusters: np.ndarray, k: np.ndarray, start: int, stride: int) -> np.ndarray:
    own = k[start::stride]
    h, w = own.shape
    # bin 0 is for pixels without a cluster
    number = own.ravel().astype(np.intp) + 1
    total = lambda values: np.bincount(number, values, len(clusters) + 1)[1:].astype(np.int64)
    n = np.bincount(number, minlength=len(clusters) + 1)[1:]
    out = clusters.copy()
    has = n > 0
    places = [np.repeat(start + np.arange(h) * float(stride), w), np.tile(np.arange(w, dtype=float), h)]
    for c, values in enumerate([*places, *(plane[start::stride].ravel() for plane in planes)]):
        out[has, c] = (total(values)[has] + n[has] // 2) // n[has]
    out[has, 5] = n[has]
    return out


def components(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-connected components of one label, by runs of equal pixels in a row.

    Where each run starts (flat), its length, and the first run of its component.
    """
    h, w = k.shape
    new = np.ones((h, w), bool)
    np.not_equal(k[:, 1:], k[:, :-1], out=new[:, 1:])
    begin = np.flatnonzero(new)
    run = np.cumsum(new.ravel(), dtype=np.int32 if h * w < 1 << 31 else np.int64).reshape(h, w)
    # where two rows agree, a pair of runs shows where the later of them starts
    meet = (k[1:] == k[:-1]) & (new[1:] | new[:-1])
    i, j = run[1:][meet] - 1, run[:-1][meet] - 1
    label = np.arange(len(begin))
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return begin, np.diff(begin, append=h * w), label


def connectivity(k: np.ndarray, size: int, count: int, factor: float) -> np.ndarray:
    h, w = k.shape
    begin, length, first = components(k)
    leads = first == np.arange(len(first))
    comp = (np.cumsum(leads) - 1)[first]
    leaders = begin[leads]
    members = np.bincount(comp, length).astype(np.int64)
    least = int(np.floor(np.float64(np.float32(size * size) * np.float32(factor)) + 0.5))
    big = np.flatnonzero(members >= least)
    if len(big) > count:
        big = np.sort(big[np.lexsort((big, -members[big]))[:count]])
    label = np.full(len(leaders), -1, np.int64)
    label[big] = np.arange(len(big))
    if label[0] < 0:
        label[0] = 0
    beside = np.where(leaders % w > 0, leaders - 1, leaders - w)
    above = comp[np.searchsorted(begin, np.maximum(beside, 0), "right") - 1]
    parent = np.where(label < 0, above, np.arange(len(leaders)))
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    return np.repeat(label[parent][comp], length).reshape(h, w)


def run(lab: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final labels, distances (-1 where no window reaches) and clusters of one (h, w, 3) Lab image."""
    h, w, _ = lab.shape
    count = config.num_of_clusters
    size = int(np.sqrt(np.float32(h * w) / np.float32(count)))
    table = spatial_table(size, config)
    clusters = seeds(lab, count)
    kind = distance_type(table)
    table = mirrored(table, kind)
    planes = [np.ascontiguousarray(lab[:, :, c], kind) for c in range(3)]
    k, best = np.full((h, w), -1, np.int32), np.full((h, w), np.iinfo(kind).max, kind)
    start, stride = 0, config.subsample_stride
    for _ in range(config.max_iterations):
        assign(planes, clusters, size, table, config, start, stride, k, best)
        clusters = update(planes, clusters, k, start, stride)
        start = (start + 1) % stride
    assign(planes, clusters, size, table, config, 0, 1, k, best)
    if config.final_update:
        clusters = update(planes, clusters, k, 0, 1)
    best = best.astype(np.int64)
    best[best == np.iinfo(kind).max] = -1
    return connectivity(k, size, count, config.min_size_factor), best, clusters


def segment(pixels: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x, label, min_dist) and the pixels' INT columns ``keep``, one task for each image; whole rectangular images of integers are needed."""

    def one(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        lab = np.zeros((y.max() + 1, x.max() + 1, 3), np.int32)
        for c, name in enumerate(("l", "a", "b")):
            lab[y, x, c] = table.column(name).to_numpy()
        labels, best, _ = run(lab, config)
        d = best[y, x].astype(np.int32)
        return pa.table({"image_id": table.column("image_id"), "y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "label": pa.array(labels[y, x].astype(np.int32)), "min_dist": pa.array(d, mask=d < 0)} | {n: table.column(n) for n in keep})

    more = [n for n in keep if n not in ("l", "a", "b")]
    return pixels.select("image_id", "y", "x", "l", "a", "b", *more).groupBy("image_id").applyInArrow(one, "image_id long, y int, x int, label int, min_dist int" + "".join(f", {n} int" for n in keep))
