"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles; documents with equal sets are one
class.  A class has a signature of ``SYMBOLS`` b-bit minima.  Two sets whose
similarity is at the threshold differ in more than ``radius`` symbols with a
probability of at most ``MISS``.  The join finds every pair within the radius:
the signature is split into chunks, and by the pigeonhole principle some chunk
has no more than its share of the errors, so each chunk is filed under all
variants with that many symbols left out.

Rows of one index key are compared inside a task, which returns a spanning
forest of the pairs within the radius, never the pairs.  Its components are
candidate clusters.  Their texts are then brought together and their full sets
compared, shingles by the words themselves and not by hashes, again inside tasks
and again returning a forest.  Oversized keys and clusters are cut into blocks,
and each two blocks are a task of their own, so every pair still meets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.llm.bytekit import BASE, U64, buffer_of, mix, run_ids, shingle_sets, slices, words
from pixeloom.operators.graph import connected_components
from pixeloom.plans.shared import bound_batches, written

#: Symbols of a signature, bits of each, and chunks it is split into.
SYMBOLS, BITS, CHUNKS = 64, 16, 16
#: The probability that a pair at the threshold lies outside the radius.
MISS = 5e-5
#: Rows of one key or cluster that one task compares; larger ones are cut into blocks of that size.
BLOCK = 8192
#: A cluster is cut into blocks of so many words, but into no more than SPREAD unless those exceed MOST_WORDS words.
BLOCK_WORDS, SPREAD, MOST_WORDS = 40_000, 8, 1_000_000
#: Rows that a task of the join gets, and words that a task of the comparison gets, about.
KEY_ROWS, TASK_WORDS = 200_000, 120_000
#: Cluster members up to which their identifiers are broadcast to the second scan; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Symbols that differ in the two nibbles of a byte, by what differs in it.
_nibbles = np.array([(x & 15 > 0) + (x >> 4 > 0) for x in range(256)], np.uint8)
_multipliers = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(BASE)) | U64(1)


@dataclass(frozen=True)
class Similarity:
    """Linked when ``100 * intersection >= percent * union``, on shingles of ``width`` words."""

    width: int = 5
    percent: int = 80

    @property
    def radius(self) -> int:
        """Symbols that may differ: the least r with P(more than r of SYMBOLS differ) <= MISS at the threshold."""
        p = 1 - self.percent / 100
        left = 1.0
        for r in range(SYMBOLS):
            left -= math.comb(SYMBOLS, r) * p**r * (1 - p) ** (SYMBOLS - r)
            if left <= MISS:
                return r
        return SYMBOLS


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of minima for each non-empty set, BITS bits each."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    for k in range(SYMBOLS if len(starts) else 0):
        out[:, k] = mix(np.minimum.reduceat(hashes * _multipliers[k], starts)) >> U64(64 - BITS)
    return out


def index_keys(sig: np.ndarray, radius: int) -> np.ndarray:
    """One column for each index entry of a signature.

    With radius = CHUNKS * a + q, either one of the first q + 1 chunks has at most a errors or one of the others at
    most a - 1 (else there were more than ``radius``); a chunk with e errors allowed is filed once for each choice of
    e symbols to leave out.
    """
    a, q = divmod(radius, CHUNKS)
    width = SYMBOLS // CHUNKS
    columns = []
    for chunk in range(CHUNKS):
        errors = a if chunk <= q else a - 1
        if errors < 0:
            continue
        for kept in itertools.combinations(range(width), max(0, width - errors)):
            key = np.full(len(sig), chunk, U64)
            for k in range(width):
                key = key * U64(BASE) + (sig[:, chunk * width + k].astype(U64) + U64(1) if k in kept else U64(0))
            columns.append(mix(key))
    return np.stack(columns, 1)


def star(ids: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest id of the component, other) where ``linked(x, others)`` says which of others link with x.

    A breadth-first search: each row reached is compared with the rows that no component holds yet.
    """
    left = np.argsort(ids, kind="stable")
    root, other = [], []
    while len(left) > 1:
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            x = queue.pop()
            near = linked(x, left)
            found = left[near]
            left = left[~near]
            root += [ids[first]] * len(found)
            other += ids[found].tolist()
            queue += found.tolist()
    return np.array(root, np.int64), np.array(other, np.int64)


def documents_features(docs: DataFrame, id_col: str, text_col: str, like: Similarity) -> DataFrame:
    """(id, n, low, high, sig): set size, a digest of the set (two sums of independent 64-bit hashes), and its signature."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffer_of(batch.column(1))
            for a, b in slices(bounds):
                sets, at = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], like.width)
                n = np.diff(at)
                has = n > 0
                digest = np.zeros((2, b - a), np.int64)
                sig = np.zeros((b - a, SYMBOLS), np.uint16)
                if has.any():
                    for half in range(2):
                        digest[half, has] = np.add.reduceat(mix(sets[half]), at[:-1][has]).view(np.int64)
                    sig[has] = signatures(sets[0], at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "n", "low", "high", "sig"])

    return rows.mapInArrow(run, "id long, n long, low long, high long, sig binary")


def candidate_forest(reps: DataFrame, n: int, radius: int) -> DataFrame:
    """(src, dst): a spanning forest of the pairs of (rep, sig) rows within the radius of each other."""
    per_row = index_keys(np.zeros((1, SYMBOLS), np.uint16), radius).shape[1]
    buckets = max(1, -(-n * per_row // KEY_ROWS))

    # a share of the rows only tells which keys may be too large for one task; it decides nothing else
    share = min(1.0, 50_000 / max(1, n))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(index_keys(sig, radius).view(np.int64).ravel())], ["key"])

    sampled = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20))).select("sig").mapInArrow(keys_of, "key long")
    hot = {r["key"]: max(2, -(-int(r["n"] / share) // BLOCK)) for r in sampled.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(2, 2 * BLOCK * share)).collect()}

    hot_keys = np.array(sorted(hot), np.int64)
    hot_blocks = np.array([hot[k] for k in sorted(hot)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = index_keys(sig, radius)
            row = np.repeat(np.arange(len(ids)), keys.shape[1])
            keys = keys.ravel()
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, keys.view(np.int64)), len(hot_keys) - 1)
                is_hot = hot_keys[at] == keys.view(np.int64)
                # a row of a hot key goes to a tile for its block with each of the key's blocks
                blocks, hot_row, hot_key = hot_blocks[at[is_hot]], row[is_hot], keys[is_hot]
                own = np.repeat(mix(ids[hot_row].view(U64)) % blocks.astype(U64), blocks)
                other = (np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(U64)
                tile = mix((np.repeat(hot_key, blocks) * U64(BASE) + np.minimum(own, other) + U64(1)) * U64(BASE) + np.maximum(own, other))
                keys, row = np.concatenate([keys[~is_hot], tile]), np.concatenate([row[~is_hot], np.repeat(hot_row, blocks)])
            bucket = (keys % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            # four low bits of each symbol: their distance never exceeds the whole symbols'
            small = (sig[:, ::2] & 15).astype(np.uint8) | ((sig[:, 1::2] & 15) << 4).astype(np.uint8)
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, cuts) if len(order) else []
            packed = [keys[p].tobytes() + ids[row[p]].tobytes() + small[row[p]].tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "rows"])

    def meet(table: pa.Table) -> pa.Table:
        keys, ids, sig = [], [], []
        for blob in table.column("rows").to_pylist():
            m = len(blob) // (16 + SYMBOLS // 2)
            keys.append(np.frombuffer(blob, U64, m))
            ids.append(np.frombuffer(blob, np.int64, m, 8 * m))
            sig.append(np.frombuffer(blob, np.uint8, m * SYMBOLS // 2, 16 * m).reshape(m, SYMBOLS // 2))
        keys, ids, sig = np.concatenate(keys), np.concatenate(ids), np.concatenate(sig)
        order = np.argsort(keys, kind="stable")
        group = run_ids(keys[order])
        sizes = np.bincount(group)
        starts = np.cumsum(sizes) - sizes
        two = starts[sizes == 2]
        x, y = order[two], order[two + 1]
        near = _nibbles[sig[x] ^ sig[y]].sum(1) <= radius
        src, dst = [ids[x[near]]], [ids[y[near]]]
        for g in np.flatnonzero(sizes > 2):
            own = order[starts[g] : starts[g] + sizes[g]]
            own_sig = sig[own]
            a, b = star(ids[own], lambda i, others, s=own_sig: _nibbles[s[others] ^ s[i]].sum(1) <= radius)
            src.append(a)
            dst.append(b)
        src, dst = np.concatenate(src), np.concatenate(dst)
        pairs = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], 1), axis=0) if len(src) else np.zeros((0, 2), np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return reps.select("rep", "sig").mapInArrow(deal, "bucket long, rows binary").groupBy("bucket").applyInArrow(meet, "src long, dst long")


def confirmed_forest(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, like: Similarity) -> DataFrame:
    """(src, dst): a spanning forest of the true links between the members (node, n) of each candidate component."""
    totals = clusters.groupBy("component").agg(F.sum("n").alias("words"))
    members = clusters.join(totals, "component")
    # a large cluster is cut into blocks by hashed id, and every two blocks meet in a tile
    blocks = F.greatest(F.ceil(F.col("words") / F.lit(MOST_WORDS)), F.least(F.ceil(F.col("words") / F.lit(BLOCK_WORDS)), F.lit(SPREAD))).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    seats = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    members = written(members.select(F.col("node").alias("id"), "component", "n", seats.alias("seats")), "near-members")
    count, dealt_words = members.agg(F.count("*"), F.coalesce(F.sum(F.size("seats") * F.col("n")), F.lit(0))).first()
    tasks = max(1, -(-dealt_words // TASK_WORDS))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    members = members.drop("n")
    found = rows.join(F.broadcast(members) if count <= BROADCAST_ROWS else members, "id")
    dealt = found.select("id", "component", F.explode("seats").alias("seat"), "text").select("id", "component", F.col("seat.i").alias("i"), F.col("seat.j").alias("j"), "text")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("component", "i", "j"), F.lit(tasks)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component, i, j = (table.column(c).to_numpy() for c in ("id", "component", "i", "j"))
        order = np.lexsort((j, i, component))
        change = (np.diff(component[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in np.split(order, np.flatnonzero(change) + 1):
            if len(own) > 1:
                a, b = compare_sets(ids[own], *exact_sets(*buffer_of(table.column("text").take(pa.array(own))), like.width), like)
                src.append(a)
                dst.append(b)
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return dealt.groupBy("task").applyInArrow(compare, "src long, dst long")


def exact_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as ascending numbers, equal for equal words in all texts of the batch, and their bounds."""
    _, codes, at = words(data, bounds)
    counts = np.diff(at)
    size = np.where(counts < width, np.minimum(counts, 1), counts - width + 1)
    text = np.repeat(np.arange(len(counts)), size)
    first = at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    # word by word: the number of a shingle's first k words, and the next word; 0 stands for no word
    number = np.zeros(len(text), np.int64)
    codes = np.append(codes.astype(np.int64) + 1, 0)
    most = int(codes.max()) + 1
    for k in range(width):
        word = codes[np.where(first + k < at[1:][text], first + k, len(codes) - 1)]
        number = np.unique(number * most + word, return_inverse=True)[1]
    pairs = np.unique(text * (int(number.max(initial=0)) + 1) + number)
    text, number = np.divmod(pairs, int(number.max(initial=0)) + 1)
    return number, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))])


def compare_sets(ids: np.ndarray, shingles: np.ndarray, at: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between sets; sizes that rule a link out aside, every pair is judged on the sets."""
    n = np.diff(at)
    here = np.zeros(int(shingles.max(initial=0)) + 1, bool)

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        fits = (n[others] > 0) & (n[x] > 0) & (100 * np.minimum(n[others], n[x]) >= like.percent * np.maximum(n[others], n[x]))
        some = np.flatnonzero(fits)
        here[shingles[at[x] : at[x + 1]]] = True
        for k in range(0, len(some), 512):
            part = some[k : k + 512]
            rows = others[part]
            starts = np.cumsum(n[rows]) - n[rows]
            values = shingles[np.repeat(at[rows] - starts, n[rows]) + np.arange(int(n[rows].sum()))]
            common = np.add.reduceat(here[values].astype(np.int64), starts)
            out[part] = 100 * common >= like.percent * (n[rows] + n[x] - common)
        here[shingles[at[x] : at[x + 1]]] = False
        return out

    return star(ids, linked)


def near_dedup(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (the component's smallest id).

    Words are runs of other than the six spaces, A-Z lower-cased; null, empty and blank texts have the empty set and
    link with nothing; a text of fewer words than a shingle has its whole sequence as its only one.  Links between
    different sets are confirmed on the words themselves; that two sets are equal is told by 2 x 64 bits.  Rows that repeat an id are one document in the links; an empty table gives an empty
    result; other columns of any name are ignored.  Ids must fit a long; a null id is left out of links.
    """
    bound_batches(docs.sparkSession)
    features = written(documents_features(docs, id_col, text_col, like), "near-features")
    filled = features.where("n > 0 and id is not null")
    reps = written(filled.groupBy("n", "low", "high").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "near-classes")
    n = reps.count()
    coarse = connected_components(written(candidate_forest(reps, n, like.radius), "near-candidates"))
    coarse = coarse.join(reps.select(F.col("rep").alias("node"), "n"), "node")
    links = written(confirmed_forest(docs, coarse, id_col, text_col, like), "near-links")
    components = connected_components(links)
    classes = reps.select("n", "low", "high", "rep").join(components, reps.rep == components.node, "left").select("n", "low", "high", F.coalesce("component", "rep").alias("component"))
    out = features.join(classes, ["n", "low", "high"], "left")
    component = F.when((F.col("n") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
