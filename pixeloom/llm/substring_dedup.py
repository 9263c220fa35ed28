"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as deep as the threshold (``window`` bytes), in
passes by digits, most significant first; after the last pass, equal groups are
exactly the repeated windows.  A group of one document drops out as soon as a
pass shows it.

*First digit.*  A window's most significant digit is its anchor, the leftmost of
the ``ANCHOR``-byte strings in it with the least hash, and the anchor's place in
the window.  It depends on the window's own bytes alone, so equal windows have
equal first digits, and neighbouring windows share an anchor: a run of them is
one record (anchor, document, place), about one for each twenty windows.  Where
an anchor occurs in one document only, none of its windows is repeated; nor is
one of a run where no other document agrees in the bytes before the anchor or in
those behind it that make up half of a window's rest, as each window holds one
of the two whole.  Hashes of these only tell what differs, and deal records to
tasks; no byte is removed because of them.

*Further digits.*  The bytes of the runs that are left are brought together by
anchor, and their windows sorted by eight bytes at a time.  Runs with equal
bytes are one string there, with its smallest document.  Where an anchor has
very many runs, they are parted by the anchor's place in the window and dealt
out by the bytes that all windows of a part share, so that a common line or
passage doesn't make one task's group.

Before runs are dealt to other tasks, a task folds those with equal bytes among
the texts it holds: all but the smallest document's are repeated whole, so a
text with thousands of copies costs a record for each task, not for each copy.

A pass reads the documents, deals its records to tasks by their digit as packed
arrays, and hands back which runs or windows of a document are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.llm.bytekit import U64, buffer_of, dictionary, mix, run_ids, slices
from pixeloom.plans.shared import bound_batches, written

#: Bytes of an anchor.
ANCHOR = 16
#: Bytes of text that one task's bucket holds, that are worked on at a time, and that are held to fold equal runs.
BUCKET_BYTES, SLICE_BYTES, HELD_BYTES = 8 << 20, 1 << 19, 6 << 20
#: Low bits of an anchor's hash that give way to its place in a slice.
PLACE_BITS = 24
#: Records of one anchor up to which its runs are compared together; beyond, parts of runs are dealt out.
MOST_RUNS = 20_000
#: Places of the anchor in a window that make a part of a run: its windows share all bytes but PLACES - 1.
PLACES = 6
#: Kinds of verdicts on a run: repeated whole; to be compared with its anchor's other runs; to be compared by parts.
WHOLE, RUNS, PARTS = 1, 2, 3

#: ``row`` is a hash of a document's text where ids repeat or are missing, and tells such rows apart; equal texts share verdicts.
#: ``size`` counts a run's windows, ``rel`` is the anchor's place in the first of them.
#: ``before`` and ``after`` are hashes of the bytes beside the anchor, 0 where the text has too few.
RECORD = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("at", "<u4"), ("size", "u1"), ("rel", "u1"), ("before", "<u2"), ("after", "<u2")])
VERDICT = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<u4"), ("size", "u1"), ("rel", "u1"), ("kind", "u1"), ("anchor", "<u8")])
MASK = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<u4"), ("bits", "<u8")])
#: What goes with a string: ``digit`` is its anchor's hash, or that of the bytes that a part's windows share.
STRING = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<u4"), ("size", "u1"), ("rel", "u1"), ("digit", "<u8")])


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` on, as one number each; a view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data).data if len(data) > 7 else bytes(8), 0, (1,))


def runs(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text number, first window's start in the batch, windows, anchor's place, anchor's hash."""
    none = np.zeros(0, np.int64)
    span = window - ANCHOR + 1
    if len(data) < window:
        return none, none, none, none, none.view(U64)
    words = eights(data)
    hashes = mix(words[:-8] ^ mix(words[8:] + U64(0x9E3779B97F4A7C15)))
    # the high bits order the anchors, the low ones carry their place, so that a minimum tells where it is
    keyed = (hashes >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(hashes), dtype=U64)
    have, best = 1, keyed
    while have * 2 <= span:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < span:
        best = np.minimum(best[: len(keyed) - span + 1], best[span - have : span - have + len(keyed) - span + 1])
    place = (best & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    # windows inside one text only
    first = bounds[:-1]
    usable = np.maximum(0, np.diff(bounds) - window + 1)
    texts = np.flatnonzero(usable)
    if not len(texts):
        return none, none, none, none, none.view(U64)
    change = np.zeros(len(place) + 1, bool)
    change[1:-1] = place[1:] != place[:-1]
    change[first[texts]] = True
    change[first[texts] + usable[texts]] = True
    # the last byte's windows of one text and the first of the next are parted by windows that don't count
    starts = np.flatnonzero(change[:-1])
    ends = np.append(starts[1:], len(place))
    text = np.searchsorted(bounds, starts, "right") - 1
    good = starts < first[text] + usable[text]
    starts, ends, text = starts[good], ends[good], text[good]
    return text, starts, ends - starts, place[starts], hashes[place[starts]]


def fold(records: np.ndarray, at: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """Which runs (first bytes at ``at``) have the same bytes as one of a smaller document among them."""
    out = np.zeros(len(records), bool)
    if len(records) < 2:
        return out
    words, size = eights(data), records["size"].astype(np.int64) + window - 1
    key = mix(records["anchor"] ^ mix(words[at] ^ mix(words[at + size - 8] + size.astype(U64))))
    order = np.lexsort((records["doc"], key))
    group = run_ids(key[order])
    least = order[np.flatnonzero(np.diff(group, prepend=-1))][group]  # one with the smallest document
    later = records["doc"][order] > records["doc"][least]
    one, other = order[later], least[later]
    same = size[one] == size[other]
    for k in range(0, int(size.max()), 8):  # the key only suggests it: every byte is compared
        step = np.minimum(k, size[one] - 8)
        same &= words[at[one] + step] == words[at[other] + np.minimum(k, size[other] - 8)]
    out[one[same]] = True
    return out


def beside(data: np.ndarray, bounds: np.ndarray, text: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes, from 1, of the bytes before and behind anchors that make up half of a window's rest; 0 beyond the text.

    Of each window's bytes beside its anchor one half at least lies on one side.
    """
    half = (window - ANCHOR + 1) // 2
    if half < 8:  # too few to read by eights: all are alike
        return np.ones((2, len(place)), np.uint16)
    words, out = eights(data), []
    for start, there in ((place - half, place - half >= bounds[text]), (place + ANCHOR, place + ANCHOR + half <= bounds[text + 1])):
        start, key = np.where(there, start, 0), np.zeros(len(place), U64)
        for k in [*range(0, half - 7, 8), half - 8]:
            key = mix(key * U64(0x9E3779B97F4A7C15) ^ words[start + k])
        out.append(np.where(there, key % U64(65535) + U64(1), U64(0)).astype(np.uint16))
    return out[0], out[1]


def shared_by_several(first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a pair (first, second) that rows of another document have, too."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    start = np.flatnonzero(new)
    several = np.minimum.reduceat(doc[order], start) < np.maximum.reduceat(doc[order], start)
    out = np.empty(len(order), bool)
    out[order] = several[np.cumsum(new) - 1]
    return out


def settle(records: np.ndarray) -> np.ndarray:
    """Verdicts on all records of some anchors: those that may share a window with another document's are to be compared."""
    if not len(records):
        return verdicts(records, RUNS)
    may = np.zeros(len(records), bool)
    for side in ("before", "after"):
        may |= shared_by_several(records["anchor"], records[side], records["doc"]) & (records[side] > 0)
    records = records[may]
    records = records[np.argsort(records["anchor"], kind="stable")]
    group = run_ids(records["anchor"])
    return verdicts(records, np.where(np.bincount(group) > MOST_RUNS, PARTS, RUNS)[group] if len(group) else RUNS)


def verdicts(records: np.ndarray, kind) -> np.ndarray:
    out = np.empty(len(records), VERDICT)
    for name in ("doc", "row", "at", "size", "rel"):
        out[name] = records[name]
    out["kind"] = kind
    out["anchor"] = np.where(out["kind"] == WHOLE, U64(0), records["anchor"])
    return out


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def restore(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


#: Bytes of an anchor's hash that are dealt with a record; anchors that agree in them are compared together.
KEPT = {"anchor": 5, "digit": 5}


def pack(rows: np.ndarray, behind: bytes = b"") -> bytes:
    """Records column by column, so that they compress, places as steps from the one before; then other bytes."""
    parts = []
    for name in rows.dtype.names:
        column = np.ascontiguousarray(rows[name])
        if name == "at":
            column = np.diff(column, prepend=column[:1] * 0)
        if name in KEPT:
            column = np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8)[:, : KEPT[name]])
        parts.append(column.tobytes())
    return squeeze(np.array([len(rows)], "<i8").tobytes() + b"".join(parts) + behind)


def unpacked(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = restore(blob)
    m, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
    part = np.zeros(m, kind)
    for name in kind.names:
        width = KEPT.get(name, kind[name].itemsize)
        if name in KEPT:
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8, m * width, at).reshape(m, width)
            part[name] = wide.view("<u8").ravel()
        else:
            part[name] = np.frombuffer(raw, kind[name], m, at)
        at += m * width
    if "at" in kind.names:
        part["at"] = np.cumsum(part["at"], dtype=np.uint32)
    return part, raw[at:]


def unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [unpacked(blob, kind)[0] for blob in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    """The places of each bucket's rows; inside one, in the order they came."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def dealt(rows: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows packed by bucket."""
    parts = by_bucket(bucket)
    return [int(bucket[p[0]]) for p in parts], [pack(rows[p]) for p in parts]


def bucket_of_doc(doc: np.ndarray, row: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(doc.astype(np.int64).view(U64)) ^ row.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int64)


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["at"], rows["row"], rows["doc"]))]


def places_of(found: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], slice]]:
    """``found`` in order of documents, and each document's part of it by (doc, row)."""
    found = in_order(found)
    cuts = np.flatnonzero((np.diff(found["doc"]) != 0) | (np.diff(found["row"]) != 0)) + 1
    edges = [0, *cuts.tolist(), len(found)] if len(found) else []
    return found, {(int(found["doc"][a]), int(found["row"][a])): slice(a, b) for a, b in zip(edges, edges[1:], strict=False)}


FIRST, LATER, TEXT, BITS = "a", "v", "t", "m"


def slices_of(data: np.ndarray, bounds: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, start in the data, bounds from there) of slices; a long text goes in parts that overlap by a window."""
    for a, b in slices(bounds, SLICE_BYTES):
        if b == a + 1 and bounds[b] - bounds[a] > SLICE_BYTES:
            for k in range(int(bounds[a]), int(bounds[b]), SLICE_BYTES):
                yield a, k, np.array([0, min(int(bounds[b]) - k, SLICE_BYTES + window - 1)])
        else:
            yield a, int(bounds[a]), bounds[a : b + 1] - bounds[a]


def first_pass(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(kind, bucket, rows): records by anchor, and verdicts on runs that a task can fold by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # records, their places in the bytes, bytes
        size = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(d) for *_, d in held)])
            records = np.concatenate([r for r, *_ in held]) if held else np.zeros(0, RECORD)
            at = np.concatenate([p + b for (_, p, _), b in zip(held, base, strict=False)]) if held else np.zeros(0, np.int64)
            whole = fold(records, at, np.concatenate([d for *_, d in held]) if held else np.zeros(0, np.uint8), window)
            held.clear()
            done, rest = verdicts(in_order(records[whole]), WHOLE), in_order(records[~whole])
            b1, r1 = dealt(rest, (rest["anchor"] >> U64(8 * KEPT["anchor"])).astype(np.int64) % buckets)
            b2, r2 = dealt(done, bucket_of_doc(done["doc"], done["row"], buckets))
            return pa.RecordBatch.from_arrays([pa.array([FIRST] * len(b1) + [LATER] * len(b2), pa.string()), pa.array(b1 + b2, pa.int64()), pa.array(r1 + r2, pa.binary())], ["kind", "bucket", "rows"])

        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, bounds = buffer_of(batch.column(1))
            for first, base, inner in slices_of(data, bounds, window):
                part = data[base : base + inner[-1]]
                text, start, n, place, anchor = runs(part, inner, window)
                out = np.empty(len(text), RECORD)
                out["anchor"], out["doc"], out["row"], out["size"], out["rel"] = anchor, ids[first + text], own[first + text], n, place - start
                out["at"] = start + base - bounds[first + text]
                out["before"], out["after"] = beside(part, inner, text, place, window)
                held.append((out, start, part.copy()))
                size += len(part)
                if size >= HELD_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("id", "text", "row").mapInArrow(run, "kind string, bucket long, rows binary")


def second_pass(first: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, rows): verdicts by document, from all records of each anchor and what the first pass folded."""

    def run(table: pa.Table) -> pa.Table:
        rows, same = table.column("rows").to_pylist(), table.column("bucket")[0].as_py()
        if table.column("kind")[0].as_py() == LATER:
            b, r = [same] * len(rows), rows
        else:
            done = in_order(settle(unpack(rows, RECORD)))
            b, r = dealt(done, bucket_of_doc(done["doc"], done["row"], buckets))
        return pa.table({"kind": pa.array([LATER] * len(b), pa.string()), "bucket": pa.array(b, pa.int64()), "rows": pa.array(r, pa.binary())})

    return first.groupBy("kind", "bucket").applyInArrow(run, "kind string, bucket long, rows binary")


def pack_texts(ids: np.ndarray, own: np.ndarray, texts: list[bytes]) -> bytes:
    head = np.array([len(ids)], "<i8").tobytes() + ids.astype("<i8").tobytes() + own.astype("<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
    return squeeze(head + b"".join(texts))


def unpack_texts(blob: bytes) -> tuple[list[tuple[int, int]], np.ndarray, bytes]:
    """(id, row) of each document, the texts' bounds, their bytes."""
    raw = restore(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, own, sizes = (np.frombuffer(raw, "<i8", n, 8 + 8 * n * k) for k in range(3))
    return list(zip(ids.tolist(), own.tolist(), strict=True)), np.concatenate([[0], np.cumsum(sizes)]), raw[8 + 24 * n :]


def texts_by_bucket(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, rows): the documents' bytes, packed by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, bounds = buffer_of(batch.column(1))
            raw = data.tobytes()
            bucket = bucket_of_doc(ids, own, buckets)
            parts = by_bucket(bucket)
            yield pa.RecordBatch.from_arrays([pa.array([TEXT] * len(parts), pa.string()), pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([pack_texts(ids[p], own[p], [raw[bounds[i] : bounds[i + 1]] for i in p]) for p in parts], pa.binary())], ["kind", "bucket", "rows"])

    return docs.select("id", "text", "row").mapInArrow(run, "kind string, bucket long, rows binary")


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """data[start:start + size] of every row, one behind the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()


def third_pass(texts: DataFrame, judged: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, rows): the bytes that are to be compared: runs by anchor, or their parts by shared bytes."""

    def run(table: pa.Table) -> pa.Table:
        kinds, rows = table.column("kind").to_pylist(), table.column("rows").to_pylist()
        found = unpack([r for k, r in zip(kinds, rows, strict=True) if k == LATER], VERDICT)
        found, of = places_of(found[found["kind"] != WHOLE])
        taken, base, raws, size = [], [], [], 0  # verdicts of the documents here, and where their bytes begin
        for blob in (r for k, r in zip(kinds, rows, strict=True) if k == TEXT):
            ids, bounds, raw = unpack_texts(blob)
            own = [(of[key], size + int(bounds[i])) for i, key in enumerate(ids) if key in of]
            if own:
                taken += [s for s, _ in own]
                base += [b for _, b in own]
                raws.append(raw)
                size += len(raw)
        if not taken:
            return pa.table({"bucket": pa.array([], pa.int64()), "rows": pa.array([], pa.binary())})
        data = np.frombuffer(b"".join(raws), np.uint8)
        mine = np.concatenate([found[s] for s in taken])
        start = mine["at"].astype(np.int64) + np.repeat(base, [s.stop - s.start for s in taken])
        strings, start = parted(mine, start, data, window)
        bucket = (mix(strings["digit"]) % U64(buckets)).astype(np.int64)
        size = strings["size"].astype(np.int64) + window - 1
        parts = [p[np.argsort(strings["digit"][p], kind="stable")] for p in by_bucket(bucket)]
        return pa.table({"bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), "rows": pa.array([pack(strings[p], gathered(data, start[p], size[p])) for p in parts], pa.binary())})

    return _with_texts(texts, judged).groupBy("bucket").applyInArrow(run, "bucket long, rows binary")


def parted(found: np.ndarray, start: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of verdicts on runs whose first windows are at ``start``, and their places: whole runs, or parts of them."""
    high, low = found["rel"].astype(np.int64), found["rel"].astype(np.int64) - found["size"] + 1  # places of the anchor, first and last window's
    by_part = found["kind"] == PARTS
    times = np.where(by_part, high // PLACES - low // PLACES + 1, 1)
    row = np.repeat(np.arange(len(found)), times)
    part = high[row] // PLACES - (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))
    by_part, first, last, anchor = by_part[row], high[row], low[row], (start + high)[row]
    first = np.where(by_part, np.minimum(first, part * PLACES + PLACES - 1), first)
    last = np.where(by_part, np.maximum(last, part * PLACES), last)
    out = np.empty(len(row), STRING)
    for name in ("doc", "row"):
        out[name] = found[name][row]
    out["at"], out["size"], out["rel"] = found["at"][row] + (high[row] - first), first - last + 1, first
    out["digit"] = found["anchor"][row]
    if by_part.any():
        words, shared = eights(data), (anchor - part * PLACES)[by_part]
        digit = part[by_part].astype(U64)
        length = window - PLACES + 1
        for k in [*range(0, length - 7, 8), length - 8]:
            digit = mix(digit * U64(0x9E3779B97F4A7C15) ^ words[shared + k])
        out["digit"][by_part] = digit
    return out, anchor - first


def compared(strings: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """For each string, as bits, which of its windows have the bytes of one in a smaller document."""
    size = strings["size"].astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(size + window - 1)])
    # strings with equal bytes are one, of the smallest document
    names, number = dictionary(data, edges)
    order = np.lexsort((strings["doc"], number))
    one = order[np.flatnonzero(np.diff(number[order], prepend=-1))]
    least = strings["doc"][one]
    # all windows of the different strings, by first digit: the anchor, and its place in the window
    times = size[one]
    owner = np.repeat(np.arange(len(one)), times)
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    digit = np.unique(strings["digit"][one], return_inverse=True)[1][owner] * 128 + strings["rel"][one][owner].astype(np.int64) - step + 64
    repeated = repeated_windows(eights(data), edges[:-1][one][owner] + step, least[owner], digit, window)
    bits = np.zeros(len(one), U64)
    np.bitwise_or.at(bits, owner[repeated], U64(1) << step[repeated].astype(U64))
    every = np.where(size < 64, (U64(1) << (size % 64).astype(U64)) - U64(1), ~U64(0))
    return np.where(strings["doc"] > least[number], every, bits[number])


def repeated_windows(words: np.ndarray, start: np.ndarray, doc: np.ndarray, digit: np.ndarray, window: int) -> np.ndarray:
    """Which windows have the bytes of one in a smaller document.

    Passes by a first digit and then by eight bytes at a time, most significant first.  After each pass, groups of
    one document drop out; what the last one leaves together is equal in all bytes.
    """
    out = np.zeros(len(start), bool)
    left, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for at in (None, *range(0, window - 7, 8), *([window - 8] if window % 8 else [])):
        if not len(left):
            break
        now = digit[left] if at is None else words[start[left] + at]
        order = np.lexsort((now, group))
        left, now, group = left[order], now[order], group[order]
        new = np.ones(len(left), bool)
        new[1:] = (now[1:] != now[:-1]) | (group[1:] != group[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        low = np.minimum.reduceat(doc[left], first)
        several = (low < np.maximum.reduceat(doc[left], first))[group]
        left, group, least = left[several], group[several], low[group][several]
    if len(left):
        out[left[doc[left] > least]] = True
    return out


def last_pass(strings: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, rows): for each string, the windows of it that also start in a smaller document, as bits."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(blob, STRING) for blob in table.column("rows").to_pylist()]
        own = np.concatenate([p for p, _ in parts])
        data = np.frombuffer(b"".join([b for _, b in parts]), np.uint8)
        parts.clear()
        out = np.zeros(len(own), MASK)
        out["doc"], out["row"], out["at"], out["bits"] = own["doc"], own["row"], own["at"], compared(own, data, window)
        out = in_order(out[out["bits"] > 0])
        b, r = dealt(out, bucket_of_doc(out["doc"], out["row"], buckets))
        return pa.table({"bucket": pa.array(b, pa.int64()), "rows": pa.array(r, pa.binary())})

    return strings.groupBy("bucket").applyInArrow(run, "bucket long, rows binary")


def _with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    return texts.unionByName(rows.select("kind", "bucket", "rows"))


def remove(texts: DataFrame, judged: DataFrame, masks: DataFrame, window: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): the documents without their repeated bytes."""

    def run(table: pa.Table) -> pa.Table:
        kinds, rows = table.column("kind").to_pylist(), table.column("rows").to_pylist()
        found = unpack([r for k, r in zip(kinds, rows, strict=True) if k == LATER], VERDICT)
        found, of = places_of(found[found["kind"] == WHOLE])
        bits = unpack([r for k, r in zip(kinds, rows, strict=True) if k == BITS], MASK)
        bits, bits_of = places_of(bits)
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for blob in (r for k, r in zip(kinds, rows, strict=True) if k == TEXT):
            ids, bounds, raw = unpack_texts(blob)
            for i, key in enumerate(ids):
                text = raw[bounds[i] : bounds[i + 1]]
                v, m = found[of.get(key, slice(0))], bits[bits_of.get(key, slice(0))]
                removed = spans = 0
                if len(v) or len(m):
                    begin, end = v["at"].astype(np.int64), v["at"].astype(np.int64) + v["size"] + window - 1
                    if len(m):
                        which, k = np.nonzero((m["bits"][:, None] >> np.arange(64, dtype=U64)) & U64(1))
                        start = m["at"][which].astype(np.int64) + k
                        begin, end = np.concatenate([begin, start]), np.concatenate([end, start + window])
                    n = len(text)
                    step = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out["id"].append(key[0])
                out["n_bytes"].append(int(bounds[i + 1] - bounds[i]))
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
        return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})

    tagged = judged.select("kind", "bucket", "rows").unionByName(masks.select(F.lit(BITS).alias("kind"), "bucket", "rows"))
    return _with_texts(texts, tagged).groupBy("bucket").applyInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when it is covered by a ``window``-byte string that also starts in a document with a smaller
    id; strings never cross documents and are judged on the input.  Null and short texts keep all they have.  Rows
    that repeat an id, or have none, are judged each by its own text; their strings aren't repeated by each other, as
    neither id is smaller, and a null id comes before all others (an id of -2**63 counts as null).  An empty table
    gives an empty result; other columns of any name are ignored.
    """
    if not ANCHOR < window <= ANCHOR + 63:
        raise ValueError(f"window must be in {ANCHOR + 1}..{ANCHOR + 63}")
    bound_batches(docs.sparkSession)
    null = F.lit(-(1 << 63)).cast("long")  # stands for a null id, before all others
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), null).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("id") == null)).limit(1).count() > 0
    rows = rows.withColumn("row", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    judged = written(second_pass(first_pass(rows, window, buckets), buckets), "suffix-verdicts")
    texts = texts_by_bucket(rows, buckets)
    masks = written(last_pass(third_pass(texts, judged, window, buckets), window, buckets), "suffix-masks")
    out = remove(texts, judged, masks, window)
    return out.select(F.when(F.col("id") != null, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
