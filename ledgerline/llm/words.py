"""Words of many texts at once, as flat numpy arrays.

A batch of texts is one byte array with row offsets, as Arrow keeps it. Separators are ASCII in
every word definition used here, so words can be cut on UTF-8 bytes. All functions are helpers for
``mapInArrow``: Spark partitions the documents, a task looks at a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SEED = 20240229
_tables: dict = {}


class Kind:
    """A word definition: which bytes separate words, and whether A-Z count as a-z."""

    def __init__(self, separators: list[range], lower: bool):
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.keep = np.ones(256, bool)
        for block in separators:
            self.keep[block.start : block.stop] = False
        self.keep = self.keep[self.fold]


#: Words between ASCII white space, unchanged: ``[^\x20\x09-\x0D]+``.
SPACED = Kind([range(0x09, 0x0E), range(0x20, 0x21)], lower=False)
#: Lower-cased words of digits, letters and everything beyond ASCII.
ALNUM = Kind([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)], lower=True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text, one row at least."""
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses."""
    if "pow" not in _tables or len(_tables["pow"][0]) < n:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        size = max(n, SLICE_BYTES + (1 << 16))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _tables["pow"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _tables["pow"]


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
    return _tables["letters"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end) of 64-bit values, by polynomial prefix sums."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """The words of a batch: row, start and end byte, and for each row its first word and count."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: Kind):
        self.bytes = kind.fold[data]
        inside = kind.keep[data]
        rows = len(offsets) - 1
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.first = self.first[:-1]
        self.row = np.repeat(np.arange(rows), self.count)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = mix(spans(_letters()[self.bytes], self.start, self.end))
        return self._hash

    def grams(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of the k words that start at each word; those that run past a row are to be masked."""
        n = max(len(self.start) - k + 1, 0)
        at = np.arange(n)
        return mix(spans(self.hash ^ np.uint64(salt), at, at + k) + np.uint64(salt))

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words that start at each word lie in one row."""
        n = max(len(self.start) - k + 1, 0)
        return self.row[:n] == self.row[k - 1 : n + k - 1] if n else np.zeros(0, bool)

    def position(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.first[self.row]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values, by doubling."""
    have, out = 1, values
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def window_anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: for each place the least k-gram hash in its window of words, and whether the window
    lies in one text. Equal windows have equal anchors, so two texts that share a window share one."""
    least = sliding_min(words.grams(k), window - k + 1)
    return least, words.whole(window)[: len(least)]
