"""Images cut into bands of whole rows, each a row of packed arrays, and what a band is told about the others.

A band's components are found inside one task.  Only those that touch a neighbouring band (``open``) take part in a
graph over bands, so that graph has at most as many edges as the cuts between bands have pixels.  Components are named
by their first pixel's index y * w + x in the image (``leader``); an open one's ``root`` is the leader of the whole
component that it is a part of.  Places without a pixel belong to no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.operators.graph import ONE_TASK_EDGES, connected_components
from pixeloom.plans import local
from pixeloom.plans.shared import written

#: Pixels of a band; a longer row is a band of its own.
BAND_PIXELS = 1 << 18
#: Rows of an Arrow batch of pixels.
BATCH_PIXELS = 1 << 16
#: Stand for no label and no pixel among labels, and for null among kept columns: beyond all INT values.
_NULL, _ABSENT = -(1 << 40), -(1 << 41)

_ARRAYS = {"begin": np.int32, "comp": np.int32, "first": np.int64, "members": np.int32, "open": np.int32, "top_k": np.int64, "top": np.int64, "bottom_k": np.int64, "bottom": np.int64}
_SCHEMA = "image_id long, band int, y0 int, w int, h int, s int, per int, corner long, " + ", ".join(f"{n} binary" for n in _ARRAYS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring rows with one image and band, as one table."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        image, band = batch.column("image_id").to_numpy(), batch.column("band").to_numpy()
        cuts = np.flatnonzero((image[1:] != image[:-1]) | (band[1:] != band[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            own = image[low], band[low]
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _band(table: pa.Table, keep: tuple[str, ...]) -> dict:
    """A row of the bands' table."""
    image, band, w, h, s, per = (table.column(n)[0].as_py() for n in ("image_id", "band", "w", "h", "s", "per"))
    y0 = band * per
    rows = min(per, h - y0)
    at = (table.column("y").to_numpy().astype(np.int64) - y0) * w + table.column("x").to_numpy()

    def grid(name: str) -> np.ndarray:
        out = np.full(rows * w, _ABSENT)
        out[at] = table.column(name).cast(pa.int64()).fill_null(_NULL).to_numpy()
        return out

    k = grid("k")
    begin, length, lead = local.components(k.reshape(rows, w))
    leads = lead == np.arange(len(lead))
    comp = (np.cumsum(leads) - 1)[lead]
    first = begin[leads]
    here = k[first] != _ABSENT
    comp = np.where(here, np.cumsum(here) - 1, -1)[comp]
    first = first[here]
    members = np.bincount(comp[comp >= 0], length[comp >= 0], len(first))
    named = np.append(first + y0 * w, -1)
    edge = lambda low: comp[np.searchsorted(begin, np.arange(low, low + w), "right") - 1]
    out = {"image_id": image, "band": band, "y0": y0, "w": w, "h": h, "s": s, "per": per, "corner": None}
    touched = []
    for name, row, cut in (("top", 0, band > 0), ("bottom", rows - 1, y0 + rows < h)):
        own = edge(row * w) if cut else np.zeros(0, np.int64)
        touched.append(own[own >= 0])
        out[name], out[f"{name}_k"] = named[own], k[row * w : row * w + len(own)]
    if len(out["bottom"]) and out["bottom"][0] >= 0:
        out["corner"] = int(out["bottom"][0])
    out |= {"begin": begin, "comp": comp, "first": named[:-1], "members": members, "open": np.unique(np.concatenate(touched))}
    out |= {n: out[n].astype(kind).tobytes() for n, kind in _ARRAYS.items()}
    return out | {f"keep_{n}": grid(n).tobytes() for n in keep}


def banded(labels: DataFrame, keep: tuple[str, ...] = (), pixels: int = BAND_PIXELS) -> DataFrame:
    """The bands of labels with columns image_id, y, x, k, w, h, s, written; ``keep`` names INT columns to carry along.

    One shuffle, of pixels; unassigned pixels (null) count as one label.
    """
    per = F.greatest(F.lit(1), F.floor(F.lit(pixels) / F.col("w")).cast("int"))
    dealt = labels.select("image_id", F.floor(F.col("y") / per).cast("int").alias("band"), "y", "x", "k", "w", "h", "s", per.alias("per"), *keep)
    dealt = dealt.repartition("image_id", "band").sortWithinPartitions("band", "image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            yield pa.RecordBatch.from_pylist([_band(table, keep)], schema)

    ints, binary = {"image_id": pa.int64(), "corner": pa.int64()}, [*_ARRAYS, *(f"keep_{n}" for n in keep)]
    names = ["image_id", "band", "y0", "w", "h", "s", "per", "corner"]
    schema = pa.schema([*((n, ints.get(n, pa.int32())) for n in names), *((n, pa.binary()) for n in binary)])
    return written(dealt.mapInArrow(run, _SCHEMA + "".join(f", keep_{n} binary" for n in keep)), "bands")


def unpacked(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = ()) -> Iterator[dict]:
    """Rows of the bands' table, one by one, with their arrays."""
    kinds = _ARRAYS | {f"keep_{n}": np.int64 for n in keep}
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k] for n in batch.schema.names}
            yield {n: np.frombuffer(v.as_buffer(), kinds[n]) if n in kinds else v.as_py() for n, v in row.items()}


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of open components that touch across a cut."""
    for row in unpacked(batches):
        same = (row["bottom_k"] == row["top_k"]) & (row["top"] >= 0)
        pairs = np.unique(np.column_stack([row["bottom"][same], row["top"][same]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["image_id"], np.int64)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["image_id", "upper", "lower"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in unpacked(batches):
        own, n = row["open"], len(row["open"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["image_id"], np.int64)), pa.array(np.full(n, row["band"], np.int32)), pa.array(row["first"][own]), pa.array(row["members"][own].astype(np.int64))], ["image_id", "band", "leader", "members"])


def opened(bands: DataFrame, one_task: int = ONE_TASK_EDGES) -> tuple[DataFrame, int]:
    """(image_id, band, leader, members, root) of the open components, written; and a number that no image has more pixels than."""
    area = bands.agg(F.coalesce(F.max(F.col("w").cast("long") * F.col("h")), F.lit(1))).first()[0]
    upper = bands.where("y0 + per < h").select("image_id", (F.col("band") + 1).alias("band"), "bottom_k", "bottom")
    lower = bands.where("band > 0").select("image_id", "band", "top_k", "top")
    pairs = upper.join(lower, ["image_id", "band"]).mapInArrow(_met, "image_id long, upper long, lower long")
    base = F.col("image_id") * area
    roots = connected_components(pairs.select((base + F.col("upper")).alias("src"), (base + F.col("lower")).alias("dst")), one_task_edges=one_task)
    own = bands.where("y0 > 0 or y0 + per < h").select("image_id", "band", "first", "members", "open").mapInArrow(_open, "image_id long, band int, leader long, members long")
    own = own.withColumn("node", base + F.col("leader")).join(roots, "node", "left")
    return written(own.select("image_id", "band", "leader", "members", F.coalesce(F.col("component") - base, "leader").alias("root")), "open"), area


def told(bands: DataFrame, marks: DataFrame) -> DataFrame:
    """Bands with an array ``marks`` of the rows (image_id, band, leader, root, value) that concern them."""
    own = marks.groupBy("image_id", "band").agg(F.collect_list(F.struct("leader", "root", "value")).alias("marks"))
    return bands.join(own, ["image_id", "band"], "left")


def marked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders, roots and values (-1 for null) of a band's marks, in order of the leaders."""
    marks = row["marks"] or []
    out = np.array([(m["leader"], m["root"], -1 if m["value"] is None else m["value"]) for m in marks], np.int64).reshape(-1, 3)
    return tuple(out[np.argsort(out[:, 0], kind="stable")].T)


def pixels(row: dict, value: np.ndarray, name: str, kind: pa.DataType, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The band's pixels with their component's value and the kept columns; without those whose value is negative."""
    w, begin = row["w"], row["begin"]
    rows = min(row["per"], row["h"] - row["y0"])
    of_run = np.append(value, -1)[row["comp"]]
    at = np.repeat(of_run, np.diff(begin, append=rows * w))
    for low in range(0, rows * w, BATCH_PIXELS):
        own = at[low : low + BATCH_PIXELS]
        here = np.flatnonzero(own >= 0)
        place = here + low
        columns = {"image_id": pa.array(np.full(len(here), row["image_id"], np.int64)), "y": pa.array((row["y0"] + place // w).astype(np.int32)), "x": pa.array((place % w).astype(np.int32)), name: pa.array(own[here]).cast(kind)}
        for n in keep:
            kept = row[f"keep_{n}"][place]
            columns[n] = pa.array(np.where(kept == _NULL, 0, kept).astype(np.int32), mask=kept == _NULL)
        yield pa.RecordBatch.from_pydict(columns)
