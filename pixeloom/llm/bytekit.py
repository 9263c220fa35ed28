"""Vectorised work on batches of texts held as one UTF-8 buffer.

A batch is the concatenation of its documents' bytes with the start of each
document in ``bounds`` (one entry more than there are documents).  Everything
here runs inside Arrow batches on the executors.  Words are told apart by their
bytes: a slice's words become numbers by Arrow's dictionary encoding, and what
is kept for later slices is filed under the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier.
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are worked on at a time.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of an Arrow string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        empty = b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else ""
        texts = texts.fill_null(empty)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, end
        at = end


#: Byte values that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def breaks(data: np.ndarray, size: int = SLICE) -> list[int]:
    """0, places right behind white space about ``size`` bytes apart, and the end: a long text's parts without a word cut."""
    out, at = [0], size
    while at < len(data):
        found = np.flatnonzero(SPACE[data[at : at + size]])
        if len(found):
            out.append(at + int(found[0]) + 1)
            at = out[-1] + size
        else:
            at += size
    return [*[x for x in out if x < len(data)], len(data)]


#: Byte values after lower-casing A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def strings(array: pa.Array) -> list[bytes]:
    """The values of a binary array, without a Python object for anything else."""
    data, bounds = buffer_of(array)
    raw, at = data.tobytes(), bounds.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def dictionary(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings among data[edges[i]:edges[i + 1]], and the number of each string."""
    offsets = np.ascontiguousarray(edges, np.int32 if len(data) < 1 << 31 else np.int64)
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    strings = pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return strings.dictionary, strings.indices.to_numpy(zero_copy_only=False)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words of a batch, each word's number in order, and each document's first word (one entry more)."""
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    starts[begins] = inside[begins]  # a word never runs over the end of its document
    first = np.flatnonzero(starts)
    return *parts(data, inside, first), np.searchsorted(first, bounds)


def parts(data: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """:func:`dictionary` of the lower-cased strings of ``inside`` bytes that start at ``first``."""
    kept = LOWER[data[inside]]
    edges = np.append(np.cumsum(inside)[first] - 1, len(kept))
    return dictionary(kept, edges)


def word_digest(word: bytes) -> bytes:
    """128 bits of a word."""
    return hashlib.blake2b(word, digest_size=16).digest()


def shingle_hashes(codes: np.ndarray, known: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` words, 2 x 64 bits that come from its words' 128 bits."""
    n = len(codes) - width + 1
    out = np.zeros((2, max(n, 0)), U64)
    if n > 0:
        for half in range(2):
            for k in range(width):
                out[half] = mix(out[half] * U64(BASE) + known[half][codes[k : k + n]])
    return out


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct ``width``-word shingles as rows of 2 x 64 bits, ascending by the first, and their bounds.

    With fewer words the whole sequence is the only shingle; without words the set is empty.
    """
    names, codes, at = words(data, bounds)
    digests = np.frombuffer(b"".join(word_digest(w) for w in strings(names)), U64).reshape(-1, 2).T
    counts = np.diff(at)
    hashes = shingle_hashes(codes, digests, width)
    text = np.repeat(np.arange(len(counts)), np.maximum(0, counts - width + 1))
    place = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(0, counts - width + 1)) - np.maximum(0, counts - width + 1), np.maximum(0, counts - width + 1)) + at[:-1][text]
    hashes = hashes[:, place] if len(place) else hashes[:, :0]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.concatenate([shingle_hashes(codes[at[i] : at[i + 1]], digests, counts[i]) for i in short], 1)
        hashes, text = np.concatenate([hashes, whole], 1), np.concatenate([text, short])
    order = np.lexsort((hashes[1], hashes[0], text))
    hashes, text = hashes[:, order], text[order]
    new = np.ones(len(text), bool)
    if len(text):
        new[1:] = (text[1:] != text[:-1]) | (hashes[0, 1:] != hashes[0, :-1]) | (hashes[1, 1:] != hashes[1, :-1])
    return hashes[:, new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(counts)))])


def run_ids(keys: np.ndarray) -> np.ndarray:
    """For ascending keys, the number of each one's group, from 0."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.empty(len(keys), np.int64)
    new[0] = 0
    new[1:] = keys[1:] != keys[:-1]
    return np.cumsum(new)
