"""Hashes of the words of whole Arrow string columns, by numpy over the columns' bytes.

A word's hash is a polynomial in its bytes (each first mapped to a random 64-bit number), from one running sum over
the bytes, and then mixed; no object is made for a word. Columns are worked on in blocks of about a quarter of a megabyte that
end between words, so memory follows the block and not the column or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: bytes of words that are hashed by the running sum
LONG = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def _block(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, begins and ends of the words in data; a word also begins at each of starts_at."""
    word = ~SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    at = starts_at[starts_at < len(data)]
    begin[at] = word[at]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.empty(0, np.uint64), first, first
    # a word ends at the next space, text or word, whichever is first
    stop = np.zeros(len(data) + 1, bool)
    stop[:-1] = ~word
    stop[at] = True
    stop[-1] = True
    stops = np.flatnonzero(stop)
    last = stops[np.searchsorted(stops, first, side="right")]
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
    hashes = mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # polynomials of high degree modulo a power of two have words in common that differ: long ones get a digest
    for k in np.flatnonzero(last - first > LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, first, last


def word_hashes(column: pa.Array, with_words: bool = False):
    """Lower-cases A-Z and returns the hashes of all words `[^\\x20\\x09-\\x0D]+`, and the n + 1 offsets that cut them
    into rows; nulls have no words. with_words also returns the lower-cased words as a list of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return (np.empty(0, np.uint64), np.zeros(1, np.int64), []) if with_words else (np.empty(0, np.uint64), np.zeros(1, np.int64))
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    if column.null_count:
        # a null's bytes are undefined; Arrow writes none, but that isn't promised
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return word_hashes(column.fill_null(""), with_words)
    out, places, words = [], [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + BLOCK)
        if to < end:
            # back to a space or a text's end; if a word is longer than the block, on to its end
            spaces = np.flatnonzero(SPACE[data[at:to]])
            cut = offsets[np.searchsorted(offsets, to, side="right") - 1]
            back = max(at + int(spaces[-1]) + 1 if len(spaces) else at, int(cut))
            while back <= at:
                spaces = np.flatnonzero(SPACE[data[to : to + BLOCK]])
                cut = int(offsets[np.searchsorted(offsets, to)]) if to <= offsets[-1] else end
                nearest = to + int(spaces[0]) + 1 if len(spaces) else (end if to + BLOCK >= end else to + BLOCK)
                back = min(cut, nearest) if len(spaces) or cut <= to + BLOCK or nearest == end else at
                to = min(end, to + BLOCK)
            to = back
        block = np.frombuffer(data[at:to].tobytes().translate(LOWER), np.uint8)
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        hashes, first, last = _block(block, rows)
        out.append(hashes)
        places.append(first + at)
        if with_words:
            text = block.tobytes()
            words += [text[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        at = to
    hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
    where = np.concatenate(places) if places else np.empty(0, np.int64)
    cuts = np.searchsorted(where, offsets)
    cuts[0], cuts[-1] = 0, len(hashes)
    return (hashes, cuts, words) if with_words else (hashes, cuts)


def small_slices(batch: pa.RecordBatch, columns: tuple[int, ...], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to about most bytes in these string columns, or of one row where that has more."""
    size = np.zeros(batch.num_rows, np.int64)
    for k in columns:
        size += pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


_GRAM = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles of width words as sorted hashes, one after the other, and the n + 1 offsets. A row
    of fewer words has their whole sequence as its one shingle; a row without words has none."""
    words, cuts = word_hashes(column)
    n = len(cuts) - 1
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams += words[k : k + len(grams)] * _GRAM[k]
    grams = mix64(grams)
    sets = []
    for i in range(n):
        a, b = cuts[i], cuts[i + 1]
        if b - a >= width:
            sets.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            sets.append(mix64(np.array([np.sum(words[a:b] * _GRAM[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.fromiter((len(s) for s in sets), np.int64, n)
    return (np.concatenate(sets) if n else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
