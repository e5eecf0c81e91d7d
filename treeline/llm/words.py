"""Words of many texts at once, as arrays: places in the bytes and 64-bit hashes.

A word's hash sums one random number for each byte and place in the word (tabulation), so no pattern
of letters makes two words alike. A sequence's hash combines those of its two halves through a mixer,
not by powers of a base, so no pattern of words does either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the argument decides every bit of the result."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _numbers(at: np.ndarray) -> np.ndarray:
    """One random number for each (place in a word, byte), given as place * 256 + byte."""
    return mix64(at.astype(_U) * _GOLD + _U(0x1F83D9ABFB41BD6B))


#: The numbers of the first places of a word; those of later places are made when met.
_PLACES = 64
_TABLE = _numbers(np.arange(_PLACES * 256))


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, s in enumerate(size):
        if k > lo and held + s > most:
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += int(s)
    if lo < len(size):
        yield batch.slice(lo)


@dataclass
class Words:
    """Words of the texts of a batch. Word w is data[start[w]:end[w]]; text t has words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def words_of(column: pa.Array | pa.ChunkedArray, hashed: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, null having none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    large = column.cast(pa.large_string())
    n = len(large)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint8), none, none, np.zeros(1, np.int64), np.empty(0, _U))
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + n + 1]
    raw = large.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    # a blank before each text keeps the words of neighbours apart
    spread = np.full(len(data) + n, 0x20, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = data
    inside = ~_SPACE[spread]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_at = offsets[:-1] + np.arange(n)
    first = np.searchsorted(start, np.append(text_at, len(spread)))
    hashes = np.empty(0, _U)
    if hashed and len(start):
        size = end - start
        at = np.flatnonzero(inside)
        place = at - np.repeat(start, size)
        key = place * 256 + spread[at]
        if int(size.max()) <= _PLACES:
            number = _TABLE[key]
        else:
            late = place >= _PLACES
            number = _TABLE[np.where(late, 0, key)]
            number[late] = _numbers(key[late])
        sums = np.add.reduceat(number, np.cumsum(size) - size)
        hashes = mix64(sums + size.astype(_U) * _GOLD)
    return Words(spread, start, end, first, hashes)


def _join(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of left and right side by side; the order counts."""
    x = left * _U(0xD6E8FEB86659FD93)
    x += right
    x += _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def blocks(hashes: np.ndarray, most: int, lane: int = 0) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... words from each place on, up to the greatest power of two that ``most`` reaches."""
    found, size = [mix64(hashes + _U(0xA0761D6478BD642F)) if lane else hashes], 1
    while 2 * size <= most:
        last = found[-1]
        found.append(_join(last[: max(len(last) - size, 0)], last[size:], size))
        size *= 2
    return found


def sequence_hash(hashes: np.ndarray, at: np.ndarray, length: np.ndarray | int, lane: int = 0, known: list[np.ndarray] | None = None) -> np.ndarray:
    """Hash of the ``length`` words from each place ``at``: of the greatest blocks at both its ends, which meet or overlap.

    Hashes of different lanes are independent, so two make one of 128 bits. ``known``: ``blocks`` of
    these hashes, if there are some already.
    """
    at = np.asarray(at, np.int64)
    length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    if not len(at):
        return np.empty(0, _U)
    most = int(length.max())
    known = known or blocks(hashes, most, lane)
    out = np.zeros(len(at), _U)
    level = np.frexp(length.astype(np.float64))[1] - 1  # length 0 is below all levels
    for k in range(int(level.min()), int(level.max()) + 1):
        if k < 0:
            continue
        some = np.flatnonzero(level == k) if int(level.min()) != k or int(level.max()) != k else slice(None)
        begin, n = at[some], length[some]
        end = begin + n - (1 << k)
        out[some] = mix64(_join(known[k][begin], known[k][end], 101) + n.astype(_U) * _GOLD)
    return out


def starts_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places at which ``width`` words of one text start, and the text of each."""
    counts = np.diff(words.first)
    windows = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(words)), windows)
    before = np.concatenate([[0], np.cumsum(windows)])[:-1]
    return words.first[:-1][text] + (np.arange(len(text)) - before[text]), text


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the text of each; a shorter text is one run of all its words."""
    at, text = starts_of(words, width)
    found = sequence_hash(words.hash, at, width) if len(at) else np.empty(0, _U)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        found = np.concatenate([found, sequence_hash(words.hash, words.first[short], counts[short])])
        text = np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        found, text = found[order], text[order]
    return found, text


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text in ascending order, and where each text's begin (one more at the end)."""
    found, text = shingles(words, width)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])])
        found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(len(words) + 1))
