"""Vectorised words and word-window hashes of Arrow text columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0d`` of the UTF-8 text
(``[^\\x20\\x09-\\x0D]+``).  Everything runs on NumPy arrays over slabs of a few
megabytes, whatever the size of the Arrow batch; a single longer document is one slab.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 20
_U = np.uint64
_BASE, _WIN = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply, twice)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_ints(values, seed: int = 0) -> np.ndarray:
    v = np.asarray(values).astype(np.uint64)
    return mix(v * _U(0x9E3779B97F4A7C15) + _U((seed * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64))


_BYTE = hash_ints(np.arange(256), 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse powers modulo 2**64, i < n."""
    def run(b: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done = 1
        while done < n:                                    # doubling
            step = min(done, n - done)
            out[done:done + step] = out[:step] * _U(pow(b, done, 2**64))
            done += step
        return out
    return run(base), run(pow(base, -1, 2**64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _known or len(_known[base][0]) < n:
        _known[base] = _powers(base, 1 << max(16, int(n - 1).bit_length()))
    a, b = _known[base]
    return a[:n], b[:n]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ascending spans (polynomial, mixed with the length)."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 18))))
        lo, hi = starts[i], ends[j - 1]
        p, q = powers(_BASE, int(hi - lo))
        s = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * p, out=s[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        size = (b - a).astype(np.uint64)
        out[i:j] = mix((s[b] - s[a]) * q[np.minimum(a, len(q) - 1)] + _U(0x2545F4914F6CDD1D) * size)
        i = j
    return out


def trim() -> None:
    """Give the allocators' free pages back, so that a long-lived worker stays as small as its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):       # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """Words of one slab: ``starts``/``ends`` byte offsets, ``first[d]:first[d+1]`` the words of row d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, lower: bool = False):
        self.row, self.rows = row, len(offsets) - 1
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        here = inside[1:-1]
        self.starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word (polynomial over its bytes, then mixed with its length)."""
        if self._hash is None:
            self._hash = byte_hashes(self.data, self.starts, self.ends)
        return self._hash

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) \
        else np.zeros(1, np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slabs(column, lower: bool = False, size: int = SLAB_BYTES) -> Iterator[Words]:
    """The column's rows in order, as slabs of about ``size`` bytes (never splitting a row)."""
    trim()
    data, off = texts(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield Words(data[off[i]:off[j]], off[i:j + 1] - off[i], i, lower)
        i = j


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of every ``k`` consecutive values of ``h`` (len(h) - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = powers(_WIN, n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(h + _U(seed)) if seed else h) * p, out=s[1:])
    return mix((s[k:] - s[:-k]) * q[:n - k + 1])


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of h[start:end] for each pair; equals :func:`windows` for equal lengths."""
    n = len(h)
    p, q = powers(_WIN, max(n, 1))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(h + _U(seed)) if seed else h) * p[:n], out=s[1:])
    return mix((s[end] - s[start]) * q[start])


def whole(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """True at window starts i < n - k + 1 whose k words lie in one row."""
    m = max(n - k + 1, 0)
    ok = np.ones(m, bool)
    for b in np.unique(first[1:-1]):
        ok[max(0, b - k + 1):b] = False
    return ok


_resident: dict = {}


def resident(key, make):
    """``make()``, kept by the worker until another key is asked for: one large lookup at a time."""
    if "key" not in _resident or _resident["key"] != key:
        _resident.clear()
        _resident.update(key=key, value=make())
    return _resident["value"]


def release() -> None:
    """Drop what earlier tasks of this worker remembered."""
    _resident.clear()
    gc.collect()


class WordTable:
    """Remembers one vector per word: a direct-mapped table of bounded size over word hashes.

    ``score(list of words)`` gives the vectors of words met for the first time (or met again
    after another word took their slot).
    """

    def __init__(self, width: int, score, bits: int = 20):
        self.score, self.bits = score, bits
        self.key = np.zeros(1 << bits, np.uint64)
        self.val = np.zeros((1 << bits, width), np.float32)

    def __call__(self, words: Words) -> np.ndarray:
        h = words.hashes
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        out = self.val[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first, raw = miss[one], words.data.tobytes()
            new = np.asarray(self.score([raw[a:b].decode() for a, b in zip(
                words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]), np.float32)
            self.key[slot[first]], self.val[slot[first]] = h[first], new
            out[miss] = new[back]
        return out


def key_runs(batches, key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``key`` in a stream sorted by it, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
