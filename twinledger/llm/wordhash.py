"""Words of whole texts as numpy arrays: boundaries and 64-bit hashes, a batch at a time.

A batch of texts is one UTF-8 byte buffer, so a word never becomes a Python object.  A word's
hash is the sum of table[byte] * R**k over its bytes (k from 0), taken from one running sum over
the buffer and mixed at the end; R is odd, so it has an inverse modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_R) + U(seed)) | U(1)


def byte_table(seed: int, fold: bool) -> np.ndarray:
    """A value for each byte; with fold, A-Z have the values of a-z."""
    table = seeded(256, seed)
    if fold:
        table[65:91] = table[97:123]
    return table


#: The six white-space bytes of the word rule `[^\\x20\\x09-\\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte but letters and digits: words are then bare of punctuation.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_R, _RINV)):
            steps = np.full(max(n, CHUNK_BYTES + 1), U(base))
            steps[0] = U(1)
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class Words:
    """The words of some texts. first[d]:first[d + 1] are those of text d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray, space: np.ndarray = SPACE):
        self.buf, self.offs = buf, offs
        inside = ~space[buf]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offs[(offs > 0) & (offs < len(buf))]
        start[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        powers, inverse = _power_tables(len(buf) + 1)
        run = np.zeros(len(buf) + 1, dtype=U)
        with np.errstate(over="ignore"):
            np.cumsum(table[buf] * powers[: len(buf)], out=run[1:])
            self.hash = mix((run[self.end] - run[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))

    def runs(self, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on (fewer at a text's end) and the words left in the text there."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))
        out = np.zeros(len(self.hash), dtype=U)
        with np.errstate(over="ignore"):
            for j, c in enumerate(seeded(k, seed)):
                if j < len(out):
                    part = self.hash[j:] * c
                    out[: len(out) - j] += np.where(left[: len(out) - j] > j, part, U(0))
            return mix(out + np.minimum(left, k).astype(U)), left


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, about CHUNK_BYTES at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offs, offs[row] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, to, buf[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        row = to


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark longs, bit for bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
