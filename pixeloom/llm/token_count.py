"""Token counts by a finite-state transducer that is compiled from a model's pieces.

Where two neighbouring characters stand together in no piece of a sentence-piece
BPE model, no merge crosses their border.  At such a *cut* the tokenizer is in
one known state, and what it emits up to the next cut depends on nothing before
it: the deterministic transducer has the cut as its state and *units*, the
strings between cuts, as the labels of its transitions.  ``Merges`` compiles a
transition when its unit is first met: it applies the model's merges, by score
and then from the left, to all new units of a slice at once, and the number of
symbols that are left (of bytes, for characters outside the vocabulary) is the
transition's annotation.  The library only reads the model file.

Texts are cut into chunks of ``CHUNK`` bytes.  A chunk is a map from the state
at its entry to the state at its exit and a count: its *head* (bytes before its
first cut, which finish the unit that the entry state holds), the tokens of its
whole units, and its *tail* (the unit left open).  Heads and tails are places in
the text, not copies.  These maps compose associatively; a parallel prefix scan
(rounds of doubling distance, over all texts of a slice at once) composes the
chunks of each text, and the last prefix of a text holds its count.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeloom.llm.bytekit import buffer_of, dictionary, slices, strings
from pixeloom.plans.shared import bound_batches

#: Bytes of a chunk.
CHUNK = 4096
#: Bytes of units and annotations that a task keeps from slice to slice, and bytes that an entry takes besides its unit's.
TABLE_BYTES, ENTRY_BYTES = 32 << 20, 150
#: Symbols of units that are merged together, a matrix of up to TOGETHER rows for each width; longer ones are merged from a queue.
WIDTHS, TOGETHER = (4, 8, 16, 32, 64), 1 << 14
#: Rank of a pair that doesn't merge.
NEVER = np.iinfo(np.int32).max
#: Bytes of text that are worked on at a time: many new units together.
SLICE = 2 << 20
SPACE, LINE = 0x20, 0x0A
MARK = "▁"  # the model's sign for a space; in a text it is the same as a space


class Merges:
    """The model's merges: symbols are pieces and characters, and two of them merge into the piece that they spell."""

    def __init__(self, pieces: dict[str, float]):
        names = list(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))
        number = {p: i for i, p in enumerate(names)}
        self.n = len(names)  # stands for all other characters
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        #: (rank, result) of merging two symbols; and the same as arrays, in order of left * (n + 1) + right
        self.pair = {(number[p[:k]], number[p[k:]]): (order[s], number[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        keys = sorted(self.pair) or [(-1, -1)]
        self.key = np.array([a * (self.n + 1) + b for a, b in keys], np.int64)
        self.rank, self.into = np.array([self.pair.get(k, (NEVER, 0)) for k in keys], np.int32).T.copy()
        self.symbol = np.full(0x110000, self.n, np.int32)
        single = {ord(p): i for p, i in number.items() if len(p) == 1}
        self.symbol[list(single)] = list(single.values())
        # a character outside the vocabulary is emitted byte by byte
        self.known = np.array([*(p in pieces for p in names), False])

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters, and for those outside the vocabulary their bytes less the one token that a symbol counts."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found = self.symbol[points]
        return found, np.where(self.known[found], 0, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))

    def counts(self, units: list[bytes]) -> np.ndarray:
        """Tokens of each unit."""
        texts = [u.decode() for u in units]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(units), np.int64)
        for low, high in zip((0, *WIDTHS), WIDTHS, strict=False):
            own = np.flatnonzero((size > low) & (size <= high))
            for rows in (own[a : a + TOGETHER] for a in range(0, len(own), TOGETHER)):
                flat, more = self.symbols("".join([texts[i] for i in rows]))
                row = np.repeat(np.arange(len(rows)), size[rows])
                out[rows] = self.short(flat, row, size[rows], high) + np.bincount(row, more, len(rows)).astype(np.int64)
        for i in np.flatnonzero(size > WIDTHS[-1]):
            flat, more = self.symbols(texts[i])
            out[i] = self.long(flat.tolist()) + int(more.sum())
        return out

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER for none) and result of merging pairs of symbols; below 0 there is no symbol."""
        key = left * np.int64(self.n + 1) + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        good = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], NEVER), self.into[at]

    def short(self, flat: np.ndarray, row: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Symbols left of units up to ``width`` long, a row each: in every round the leftmost pair of the least rank is merged."""
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.full((len(size), width + 2), -1, np.int32)
        symbols[row, column] = flat
        rank, into = np.full((len(size), width + 1), NEVER, np.int32), np.zeros((len(size), width + 1), np.int32)
        inner = column < size[row] - 1
        rank[row[inner], column[inner]], into[row[inner], column[inner]] = self.merged(flat[:-1], flat[1:]) if inner.all() else self.merged(flat[inner], flat[np.flatnonzero(inner) + 1])
        left, going, columns = size.copy(), np.arange(len(size)), np.arange(width)
        while len(going):
            rows, best = np.arange(len(going)), rank.argmin(1)
            more = rank[rows, best] != NEVER
            if not more.all():
                going, symbols, rank, into, best = (x[more] for x in (going, symbols, rank, into, best))
                rows = rows[: len(going)]
            if not len(going):
                break
            symbols[rows, best] = into[rows, best]
            # what stands behind the merged pair moves up by one
            behind = columns >= best[:, None]
            np.copyto(symbols[:, 1:-1], symbols[:, 2:], where=behind)
            np.copyto(rank[:, :-1], rank[:, 1:], where=behind)
            np.copyto(into[:, :-1], into[:, 1:], where=behind)
            before = best > 0
            rank[rows, best], into[rows, best] = self.merged(symbols[rows, best], symbols[rows, best + 1])
            r, b = rows[before], best[before]
            rank[r, b - 1], into[r, b - 1] = self.merged(symbols[r, b - 1], symbols[r, b])
            left[going] -= 1
        return left

    def long(self, value: list[int]) -> int:
        """Symbols left of a long unit: the same merges from a queue, over a linked list."""
        pair, n = self.pair, len(value)
        queue = [(found[0], i, value[i], value[i + 1], found[1]) for i in range(n - 1) if (found := pair.get((value[i], value[i + 1])))]
        heapq.heapify(queue)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while queue:
            _, at, x, y, piece = heapq.heappop(queue)
            behind = after[at]
            if value[at] != x or behind >= n or value[behind] != y:
                continue  # one of the two has been merged since
            value[at], value[behind], after[at] = piece, -1, after[behind]
            if after[at] < n:
                before[after[at]] = at
            left -= 1
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b < n and (found := pair.get((value[a], value[b]))):
                    heapq.heappush(queue, (found[0], a, value[a], value[b], found[1]))
        return left


class Transducer:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace(MARK, " "): model.get_score(i) for i in plain}
        self.merges = Merges(pieces)
        #: joined[x * 256 + y]: whether a piece may hold byte y right behind byte x; of other than ASCII, all may
        joined = np.ones((256, 256), bool)
        joined[:128, :128] = False
        for piece in (p.encode() for p in pieces):
            for x, y in zip(piece, piece[1:], strict=False):
                joined[x, y] = True
        if joined[:128, LINE].any() or joined[LINE, :128].any() or np.delete(joined[:128, SPACE], SPACE).any():
            raise ValueError("a piece of this model crosses lines or words")
        joined[:, LINE] = joined[LINE, :] = False
        joined[128:, SPACE] = False
        self.joined = joined.ravel()
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.held = 0

    def annotations(self, units: list[bytes]) -> np.ndarray:
        """Tokens of each unit, compiled where it is new."""
        if self.held > TABLE_BYTES:
            self.clear()
        missing = [u for u in dict.fromkeys(units) if u not in self.table]
        if missing:
            self.table.update(zip(missing, self.merges.counts(missing).tolist(), strict=True))
            self.held += sum(map(len, missing)) + ENTRY_BYTES * len(missing)
        return np.fromiter((self.table[u] for u in units), np.int64, len(units))

    def chunk_maps(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows (begin, end, end of head, count, start of tail, cuts) of chunks that lie side by side in ``data``."""
        low, high = int(begin[0]), int(end[-1])
        pair = data[low : high - 1].astype(np.uint16)
        pair <<= 8
        pair |= data[low + 1 : high]
        cut = np.zeros(high - low, bool)
        np.logical_not(self.joined[pair], out=cut[1:])
        cut[begin - low] = False  # a chunk can't tell about its own first byte
        cuts = np.flatnonzero(cut)
        first, last = np.searchsorted(cuts, begin - low), np.searchsorted(cuts, end - low)
        has = last > first
        cut[begin - low] = True
        points = np.flatnonzero(cut)
        names, number = dictionary(data[low:high], np.append(points, high - low))
        # whole units: from a cut to a cut of the same chunk
        at = np.searchsorted(points, cuts)
        whole = np.ones(len(cuts), bool)
        whole[last[has] - 1] = False
        counts = np.zeros(len(cuts), np.int64)
        if whole.any():
            number = number[at[whole]]
            used = np.zeros(len(names), bool)
            used[number] = True
            counts[whole] = self.annotations(strings(names.filter(pa.array(used))))[(np.cumsum(used) - 1)[number]]
        sums = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.append(cuts, 0)  # so that there is one to look at
        head = np.where(has, low + cuts[np.minimum(first, len(cuts) - 1)], end)
        tail = np.where(has, low + cuts[np.maximum(last, 1) - 1], end)
        return np.stack([begin, end, head, sums[last] - sums[first], tail, has.astype(np.int64)], 1)

    def units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of data[start:end], each a unit or nothing."""
        out = np.zeros(len(start), np.int64)
        some = np.flatnonzero(end > start)
        if len(some):
            out[some] = self.annotations([data[a:b].tobytes() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
        return out

    def compose(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of maps composed with those of the chunks right behind them."""
        begin, border, a_head, a_count, a_tail, a_cuts = a.T
        _, end, b_head, b_count, b_tail, b_cuts = b.T
        a_cuts, b_cuts = a_cuts > 0, b_cuts > 0
        goes_on = self.joined[data[border - 1].astype(np.int64) * 256 + data[border]]
        # the units that the border closes: what was open before it, and what the second map's head is then
        open_end = np.where(goes_on, b_head, border)
        closed = a_cuts & (b_cuts | ~goes_on)
        count = a_count + b_count + self.units(data, np.where(closed, a_tail, 0), np.where(closed, open_end, 0))
        behind = ~goes_on & b_cuts
        count += self.units(data, np.where(behind, border, 0), np.where(behind, b_head, 0))
        head = np.where(a_cuts, a_head, open_end)
        tail = np.where(b_cuts, b_tail, np.where(goes_on, np.where(a_cuts, a_tail, end), border))
        return np.stack([begin, end, head, count, tail, a_cuts | b_cuts | ~goes_on], 1)

    def scan(self, data: np.ndarray, maps: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Each text's prefixes composed, in rounds of doubling distance (a parallel prefix scan)."""
        maps, step = maps.copy(), 1
        while True:
            later = np.flatnonzero(text[step:] == text[:-step]) + step
            if not len(later):
                return maps
            maps[later] = self.compose(data, maps[later - step], maps[later])
            step *= 2

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text of a batch."""
        # the dummy prefix is one more space before every text that isn't empty
        sizes = np.diff(bounds)
        has = np.flatnonzero(sizes > 0)
        out = np.zeros(len(sizes), np.int64)
        if not len(has):
            return out
        wide = np.insert(data, bounds[:-1][has], SPACE)
        sizes = sizes[has] + 1
        base = np.cumsum(sizes) - sizes
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(has)), chunks)
        begin = base[text] + CHUNK * (np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        end = np.minimum(begin + CHUNK, (base + sizes)[text])
        # a few chunks at a time, so that a very long text takes no more memory than its own bytes
        step = max(1, SLICE // CHUNK)
        maps = np.concatenate([self.chunk_maps(wide, begin[i : i + step], end[i : i + step]) for i in range(0, len(begin), step)])
        last = self.scan(wide, maps, text)[np.cumsum(chunks) - 1]
        begin, end, head, count, tail, _ = last.T
        out[has] = count + self.units(wide, begin, head) + self.units(wide, tail, end)
        return out


@functools.lru_cache(maxsize=1)
def transducer(model_file: str) -> Transducer:
    """One per Python worker; a task leaves it without a table."""
    return Transducer(model_file)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (``n_tokens > limit``).

    Null and empty texts have no bytes and no tokens.  Repeated rows and ids each get their row; an empty table
    gives an empty result; other columns of any name are ignored.  Every executor needs ``model_file``.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        mark = MARK.encode()
        try:
            for batch in batches:
                data, bounds = buffer_of(batch.column(1))
                out = np.zeros(len(batch), np.int64)
                for a, b in slices(bounds, SLICE):
                    part = data[bounds[a] : bounds[b]]
                    own = bounds[a : b + 1] - bounds[a]
                    raw = part.tobytes()
                    if mark in raw:  # rewritten as the space that it stands for
                        texts = [raw[x:y].replace(mark, b" ") for x, y in zip(own[:-1], own[1:], strict=True)]
                        part, own = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                    out[a:b] = machine.counts(part, own)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(out), pa.array(out > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])
        finally:
            machine.clear()

    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
