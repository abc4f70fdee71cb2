"""Whole texts as byte arrays: words, lines and their 64-bit hashes for a bounded piece of documents at a time.

A null text counts as empty. White space is the six ASCII characters 0x09-0x0D and 0x20, lower-casing touches A-Z only;
every other byte, malformed or not, is part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

PIECE = 1 << 20          # bytes of text handled at once; a longer document is a piece of its own
ROWS = 1 << 12           # texts handled at once
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def pieces(column, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ROWS rows with about `limit` bytes."""
    data, offsets = buffers(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1), start + ROWS)
        yield start, stop, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        start = stop


def words(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None,
          between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row (plus one) the number of words before it. Words are also cut
    before the bytes marked in `cut`; `between` marks the bytes that are in no word."""
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True                        # a word never crosses rows
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    if cut is not None:
        begins |= cut & solid
        ends[:-1] |= (cut & solid)[1:] & solid[:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line (split at \\n; an empty row is one empty line), and lines before each row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    rows = np.searchsorted(offsets, breaks, "right") - 1
    row = np.concatenate([np.arange(len(offsets) - 1), rows])
    row_end = np.concatenate([rows, np.arange(len(offsets) - 1)])
    starts = starts[np.lexsort((starts, row))]
    ends = ends[np.lexsort((ends, row_end))]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    return starts, ends, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at either end; an all-white span becomes empty."""
    solid = np.flatnonzero(~WHITE[data])
    if not len(solid):
        return starts, starts.copy()
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = first <= last
    return (np.where(some, solid[np.minimum(first, len(solid) - 1)], starts),
            np.where(some, solid[np.maximum(last, 0)] + 1, starts))


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in every span."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[ends] - before[starts]


_ALL = np.concatenate([[0], (1 << np.arange(8, 64, 8, dtype=object)) - 1, [(1 << 64) - 1]]).astype(_U)   # by bytes kept
_BLOCKS = 1 << 18         # 8-byte blocks hashed at once


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of the data on, as little-endian numbers (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


class SpanHasher:
    """64-bit hashes of byte spans. A span is cut into blocks of 8 bytes, each is mixed with a key for its place in the
    span, and the mixed blocks are added up. `second` gives 64 further bits of another construction: sums of products of
    half blocks, each half shifted by a key for its place. No relation between bytes of different places survives either."""

    def __init__(self, seed: int = 1, lower: bool = False):
        self.fold = lower
        self.key, self.left, self.right, self.length = (constants(seed + k, 1)[0] for k in (0, 7919, 104729, 1299709))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._hashed(data, starts, ends, False)[0]

    def both(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the second one."""
        return self._hashed(data, starts, ends, True)

    def _hashed(self, data, starts, ends, second):
        eights, size = _eights(LOWER[data] if self.fold else data), np.asarray(ends) - starts
        with np.errstate(over="ignore"):
            one, two = self._block(eights[starts] & _ALL[np.minimum(size, 8)], _U(1), second)
            long = np.flatnonzero(size > 8)
            if len(long):
                more = np.cumsum((size[long] - 1) // 8)                # blocks behind the first, up to each span
                for begin in range(0, int(more[-1]), _BLOCKS):
                    n = np.arange(begin, min(begin + _BLOCKS, int(more[-1])))
                    which = np.searchsorted(more, n, "right")
                    place = n - np.where(which > 0, more[which - 1], 0) + 1
                    which = long[which]
                    block = eights[starts[which] + 8 * place] & _ALL[np.minimum(size[which] - 8 * place, 8)]
                    at = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                    for total, part in zip((one, two), self._block(block, place.astype(_U) + _U(1), second)):
                        if total is not None:
                            total[which[at]] += np.add.reduceat(part, at)
            tail = size.astype(_U) * self.length
            return mix(one + tail), mix(two ^ mix(tail + self.left)) if second else None

    def _block(self, block, place, second):
        one = mix(block * self.key + place * self.length)
        if not second:
            return one, None
        half = _U(0xFFFFFFFF)
        return one, (((block & half) + mix(place + self.left)) & half) * (((block >> _U(32)) + mix(place + self.right)) & half)


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """The first span of every distinct content (lower-cased, if the hasher does so), and for each span the number of its
    content. Spans are compared with the first one of their hash, byte by byte; if any differs, all are told apart by
    their bytes."""
    data = LOWER[data] if hasher.fold else data
    which, found = pd.factorize(hasher(data, starts, ends))
    first = np.empty(len(found), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    size, eights, mine = ends - starts, _eights(data), first[which]
    same = size == size[mine]
    long, k = np.flatnonzero(same & (mine != np.arange(len(mine)))), 0
    while len(long):                                                   # 8 bytes of the spans that have so many
        x, y, left = starts[long] + k, starts[mine[long]] + k, np.minimum(size[long] - k, 8)
        same[long[((eights[x] ^ eights[y]) & _ALL[left]) != 0]] = False
        k += 8
        long = long[(size[long] > k) & same[long]]
        if k == 64:
            break
    raw = data.tobytes() if len(long) else b""
    for i in long.tolist():
        same[i] = raw[starts[i] + k:ends[i]] == raw[starts[mine[i]] + k:ends[mine[i]]]
    if same.all():
        return first, which
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(raw[s:e], len(number)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
    return np.unique(which, return_index=True)[1], which


def distinct_pairs(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two hashes, sorted by the first."""
    order = np.lexsort((m, h))
    h, m = h[order], m[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    return h[new], m[new]


def windows(hashes: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """Hash of every run of `size` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, _U)
        for j, c in enumerate(constants(seed, size)):
            total += hashes[j:j + n] * c
        return mix(total)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For every row, its kept words joined by one space."""
    return [b" ".join([data[s:e].tobytes() for s, e in zip(starts[a:b][k], ends[a:b][k])]) if (k := keep[a:b]).any() else b""
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def all_joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words of every row joined by one space, as one buffer with the rows' offsets."""
    size = ends - starts
    keep = ~WHITE[data]
    inner = np.ones(len(starts), bool)
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    inner[last] = False                                     # no space after the last word of a row
    keep[ends[inner]] = True                                # the white byte after a word becomes its space
    out = np.where(WHITE[data], np.uint8(32), data)[keep]
    before = np.concatenate([[0], np.cumsum(size + inner)])
    return out.tobytes(), before[bounds]
