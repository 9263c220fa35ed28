"""Best-fit packing by patterns and non-negative least squares.

Documents become pieces of at most ``capacity`` tokens; only longer documents
are cut.  Everything that decides the packing is the histogram of piece
lengths, which has at most ``capacity`` entries however many documents there
are: patterns of up to three lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded down to what there is, and what remains is packed
best-fit in decreasing order, a whole batch of equal sequences at a time.  The
plan gives each length ranges of ranks; a piece finds its place by its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.llm.bytekit import SPACE, breaks, buffer_of, parts, run_ids, slices, strings
from pixeloom.llm.ranks import ranked
from pixeloom.plans.shared import bound_batches, written

#: Patterns with the largest repeat counts that the plan keeps; the remainder packs what they leave.
MOST_PATTERNS = 8192
#: Triples are enumerated while there are at most so many; their number is bounded by the capacity's square.
MOST_TRIPLES = 2_000_000
#: Bytes of words and token sequences that a task keeps from slice to slice, and bytes that an entry takes besides its own.
TABLE_BYTES, ENTRY_BYTES = 24 << 20, 150

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: ASCII signs that stand neither in words nor in contractions.
SIGN = np.zeros(256, bool)
SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


class WordTokens:
    """Token ids of whole texts through a table of words, filed under their bytes.

    The tokenizer lower-cases, drops white space and never joins letters with signs, so a text's ids are those of
    its parts between ASCII white space, cut further where an ASCII letter and an ASCII sign meet.  A word of ASCII
    letters alone is never normalised or cut, so the library's model gets it as it stands; others go the library's whole way.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.special = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.held = 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encoded(self, words: list[bytes]) -> list[list[int]]:
        """Each lower-cased word's ids."""
        out = [[t.id for t in self.model.tokenize(w.decode())] if w.isalpha() else [] for w in words]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        for a in range(0, len(rest), 2000):  # the library's results are large while they live
            some = rest[a : a + 2000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def learn(self, words: list[bytes]) -> None:
        got = self.encoded(words)
        sizes, new = np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(itertools.chain.from_iterable(got), np.uint32)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        self.table.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.at = np.concatenate([self.at, self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(new)
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words) + 4 * len(new)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch in order, and each text's bounds in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        inside = ~SPACE[data]
        cut = inside.copy()
        cut[1:] &= ~inside[:-1]
        letter, sign = LETTER[data], SIGN[data]
        cut[1:] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
        begins = bounds[:-1][bounds[:-1] < len(data)]
        cut[begins] |= inside[begins]
        start = np.flatnonzero(cut)
        names, back = parts(data, inside, start)
        names = strings(names)
        if self.held > TABLE_BYTES:
            self.clear()
        place = np.fromiter(map(self.table.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = len(self.at) + np.arange(len(missing))
            self.learn([names[i] for i in missing])
        at, size = self.at[place][back], self.size[place][back]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(start, bounds)]

    def batch(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Each text's ids."""
        raw = data.tobytes()
        odd = any(s in raw for s in self.special) or any(len(s) > 2 and s[:2] in raw for s in self.special)
        if not odd and len(bounds) == 2:  # a very long text goes in parts
            at = breaks(data)
            yield np.concatenate([np.zeros(0, np.uint32), *(self.ids(data[a:b], np.array([0, b - a]))[0] for a, b in zip(at[:-1], at[1:], strict=True) if b > a)])
            return
        if not odd:
            ids, at = self.ids(data, bounds)
            yield from (ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
            return
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            text = raw[a:b]
            if any(s[:2] in text for s in self.special):  # as the library has it, special strings too
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            else:
                ids, _ = self.ids(data[a:b], np.array([0, b - a]))
                yield ids


@functools.lru_cache(maxsize=1)
def word_tokens(file: str) -> WordTokens:
    """One per Python worker; a task leaves it without a table."""
    return WordTokens(file)


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_file)
        try:
            for batch in batches:
                data, bounds = buffer_of(batch.column(1))
                for a, b in slices(bounds):
                    who, piece, start, length, crc = [], [], [], [], []
                    for i, ids in enumerate(words.batch(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]), a):
                        ids = np.append(ids, np.uint32(end_id))
                        for k in range(0, len(ids), capacity):
                            own = ids[k : k + capacity]
                            who.append(i)
                            piece.append(k // capacity)
                            start.append(k)
                            length.append(len(own))
                            crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])
        finally:
            words.clear()

    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def patterns(have: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, that fill a sequence exactly and of which there are pieces."""
    lengths = np.flatnonzero(have)
    lengths = lengths[lengths > 0]
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    low = lengths[lengths <= capacity // 2]
    two = low[have[capacity - low] > 0]
    out.append(np.stack([capacity - two, two, np.zeros_like(two)], 1))
    total = 0
    for a in lengths[::-1]:  # a >= b >= c, so a is a third of the sequence at least
        if 3 * a < capacity or total > MOST_TRIPLES:
            break
        rest = capacity - a
        b = lengths[(lengths <= min(a, rest - 1)) & (2 * lengths >= rest)]
        b = b[have[rest - b] > 0]
        out.append(np.stack([np.full_like(b, a), b, rest - b], 1))
        total += len(b)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(made: np.ndarray, have: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram, by projected accelerated gradients."""
    if not len(made):
        return np.zeros(0)
    n = len(have)
    forward = lambda x: sum(np.bincount(made[:, k], x, n) for k in range(3)) * (np.arange(n) > 0)
    back = lambda r: sum(np.where(made[:, k] > 0, r[made[:, k]], 0) for k in range(3))
    v = np.ones(len(made))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(made))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + back(have * (np.arange(n) > 0) - forward(y)) / (1.05 * top))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (from, to, base, repeat, offset) of ranks from+1..to, and the number of sequences.

    A piece with t = rank - from - 1 goes to sequence base + t % repeat, at offset + (t // repeat) * length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    given = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequences = 0

    def use(lengths: list[int], repeat: int) -> None:
        nonlocal sequences
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            many = lengths.count(length)
            rows.setdefault(length, []).append((int(given[length]), int(given[length]) + many * repeat, sequences, repeat, offset))
            given[length] += many * repeat
            left[length] -= many * repeat
            offset += many * length
        sequences += repeat

    made = patterns(left, capacity)
    wanted = fit(made, left)
    for i in np.argsort(-wanted, kind="stable")[:MOST_PATTERNS]:
        if wanted[i] < 0.5:
            break
        lengths = [int(x) for x in made[i] if x]
        repeat = min(int(wanted[i] + 0.5), *(int(left[x]) // lengths.count(x) for x in lengths))
        if repeat > 0:
            use(lengths, repeat)
    present = np.flatnonzero(left).tolist()  # ascending
    while present:
        lengths, room = [], capacity
        taken: dict[int, int] = {}
        k = len(present)
        while k:
            k = bisect.bisect_right(present, room, 0, k)  # best fit: the longest that still fits
            if not k:
                break
            length = present[k - 1]
            n = min(room // length, int(left[length]))
            lengths += [length] * n
            taken[length] = n
            room -= n * length
            k -= 1
        use(lengths, min(int(left[x]) // n for x, n in taken.items()))
        for x in taken:
            if not left[x]:
                present.pop(bisect.bisect_left(present, x))
    return {k: np.array(v, np.int64) for k, v in rows.items()}, sequences


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone.  Repeated rows and ids are documents of their own.  An
    empty table gives an empty result; other columns of any name are ignored.  Every executor needs the file.
    """
    bound_batches(docs.sparkSession)
    rows = written(pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id), "pieces")
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    spread = ranked(rows, "length", [F.col("id").asc_nulls_first(), F.col("piece"), F.col("start"), F.col("ids_crc32")], "pieces-ranked")
    # bounded by the capacity and MOST_PATTERNS, not by the data
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    id_type = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            ids = run_ids(length[order])
            for own in np.split(order, np.flatnonzero(np.diff(ids)) + 1) if len(order) else []:
                table = shared.value[int(length[own[0]])]
                row = table[np.searchsorted(table[:, 1], rank[own])]
                t = rank[own] - row[:, 0] - 1
                sequence[own] = row[:, 2] + t % row[:, 3]
                offset[own] = row[:, 4] + t // row[:, 3] * length[own]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return spread.mapInArrow(place, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
