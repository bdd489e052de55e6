"""Words of many texts as flat numpy arrays of offsets and 64-bit hashes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than this are hashed one by one.
_LONG = 48


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """What each byte counts as: 0 for a separator, a letter A-Z as its small one."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    table[0] = 0 if 0 in separators else 255  # 255 is no byte of UTF-8
    return table


#: Contract words: everything but space and U+0009 to U+000D.
SPACED = byte_table(b" \t\n\v\f\r")
#: Letters and digits, and all beyond ASCII; ASCII punctuation parts words too.
PLAIN = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    data: np.ndarray  # the bytes, each as the table counts it
    first: np.ndarray  # of each word: its first byte, the byte after its last, its text
    last: np.ndarray
    text: np.ndarray
    count: np.ndarray  # words of each text

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        size = self.last - self.first
        h = np.full(len(size), seed, dtype=np.uint64) + size.astype(np.uint64) * _STEP
        order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
        start, size = self.first[order], size[order]
        long = int(np.searchsorted(-size, -_LONG, "left"))
        for k in range(long):
            h[order[k]] = np.uint64(xxhash.xxh3_64_intdigest(self.data[start[k] : start[k] + size[k]].tobytes(), seed & 0xFFFFFFFF))
        order, start, size = order[long:], start[long:], size[long:]
        own = h[order]
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))  # words of more than k bytes come first
            own[:n] = (own[:n] ^ self.data[start[:n] + k]) * _M1
            own[:n] ^= own[:n] >> np.uint64(29)
        h[order] = mixed(own)
        return h


def words(column: pa.Array, table: np.ndarray) -> Words:
    """The words of a string column; a null text has none."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    data = table[raw]
    inside = data != 0
    begin = ends - ends[0]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    edge[begin] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1] if len(data) else inside
    after = np.r_[inside[1:], False] & ~edge[1:] if len(data) else inside
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    at = np.searchsorted(first, begin)
    count = np.diff(at)
    return Words(data, first, last, np.repeat(np.arange(n), count), count)


def shingles(w: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``n`` words and the run's text; a text of fewer words is one run itself."""
    total = len(hashes)
    if not total:
        return hashes, w.text
    begins = np.r_[0, np.cumsum(w.count)]
    h = np.full(total, np.uint64(n), dtype=np.uint64)
    at = np.arange(total)
    end = begins[w.text + 1]
    for k in range(n):
        there = at + k
        here = there < end
        h = np.where(here, mixed(h * _STEP + hashes[np.minimum(there, total - 1)]), h)
    keep = (at + n <= end) | (at == begins[w.text])
    return h[keep], w.text[keep]
