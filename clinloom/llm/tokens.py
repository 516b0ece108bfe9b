"""Whole-text encoding with the ``tokenizers`` library, one library call per new piece.

Both vocabularies split a text into pre-tokens that never cross the boundaries this module
cuts at, so the ids of a piece do not depend on its neighbours and can be remembered:

* ``spaced`` (byte-level BPE): a run of ASCII blanks with the non-blanks that follow it;
* ``plain`` (BPE with word ends): a run of non-blanks; the library drops the blanks.

Rows of the first kind with other Unicode blanks or the spelling of a special token go to
the library whole.  A worker's memory is bounded: a direct-mapped table of 64-bit piece
hashes over a pool of ids that starts anew when full.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clinloom.llm.words import Words, byte_hashes, resident, slabs

_UNSAFE = (r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}"
           r"\x{3000}\x{feff}]|<\|")
_PLAIN = re.compile("[!-~À-ÿ]*")       # words that composition leaves as they are
_SLOTS, _POOL = 22, 16 << 20


class Encoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib, self.style = Tokenizer.from_file(path), style
        if style == "plain":
            from tokenizers.normalizers import Sequence
            self.bare = Tokenizer.from_file(path)         # for words that need no normalising but lower case
            self.bare.normalizer = Sequence([])
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << _SLOTS, np.uint64)
        self.at = np.zeros(1 << _SLOTS, np.int32)
        self.size = np.zeros(1 << _SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _library(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        easy = [i for i, p in enumerate(pieces) if self.style == "plain" and "<|" not in p and _PLAIN.fullmatch(p)]
        rest = range(len(pieces)) if not easy else sorted(set(range(len(pieces))) - set(easy))
        for at, lib, text in ((easy, getattr(self, "bare", None), str.lower), (rest, self.lib, str)):
            for lo in range(0, len(at), 8192):
                part = at[lo:lo + 8192]
                for i, e in zip(part, lib.encode_batch_fast([text(pieces[i]) for i in part],
                                                            add_special_tokens=False), strict=True):
                    out[i] = e.ids
        return out

    def _add(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes in the pool of the pieces' ids, encoded now."""
        ids = self._library(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(total + (2 << 20), self.ids.dtype)])
        self.ids[self.used:self.used + total] = np.fromiter((x for e in ids for x in e), self.ids.dtype, total)
        at = self.used + np.cumsum(size) - size
        self.used += total
        return at, size

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, sizes) in the pool of the ids of each data[start:end]."""
        h = byte_hashes(data, starts, ends)
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[one]
            raw = data.tobytes()
            got_at, got_size = self._add([raw[a:b].decode() for a, b in zip(starts[first].tolist(),
                                                                            ends[first].tolist(), strict=True)])
            self.key[slot[first]], self.at[slot[first]], self.size[slot[first]] = h[first], got_at, got_size
            at[miss], size[miss] = got_at[back], got_size[back]
        return at, size

    def slab(self, words: Words, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the slab's rows; rows marked ``odd`` go to the library whole."""
        if self.used > _POOL:
            self.clear()
        starts, ends, first = words.starts, words.ends, words.first
        if self.style == "spaced":                        # a piece begins where the last one ended
            begin, stop = words.offsets[:-1], words.offsets[1:]
            last = np.where(first[1:] > first[:-1], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, begin)
            tail = np.flatnonzero(stop > last)            # blanks at a row's end are a piece of their own
            ends = np.concatenate([ends, stop[tail]])
            row = np.concatenate([words.row_of_word(), tail])
            order = np.argsort(ends, kind="stable")
            ends, row = ends[order], row[order]
            starts = np.concatenate([[0], ends[:-1]])[:len(ends)]
            first = np.searchsorted(row, np.arange(words.rows + 1))
            starts[first[:-1][np.diff(first) > 0]] = begin[np.diff(first) > 0]
        at, size = self.pieces(words.data, starts, ends)
        whole = [r for r in np.flatnonzero(odd).tolist()]
        if whole:
            raw = words.data.tobytes()
            w_at, w_size = self._add([raw[words.offsets[r]:words.offsets[r + 1]].decode() for r in whole])
            for r, a, n in zip(whole, w_at, w_size, strict=True):
                size[first[r]:first[r + 1]] = 0
                at[first[r]], size[first[r]] = a, n
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(at - (end - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], end])[first]


def encoder(path: str, style: str) -> Encoder:
    """The worker's encoder for a vocabulary file (kept while the worker lives)."""
    return resident((path, style), lambda: Encoder(path, style))


def documents(column: pa.Array, path: str, style: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, flat uint32 ids, offsets) of slabs of rows; null counts as empty, ``end_id`` ends each row."""
    enc = encoder(path, style)
    odd = np.zeros(len(column), bool) if style == "plain" else pc.fill_null(
        pc.match_substring_regex(column, _UNSAFE), False).to_numpy(zero_copy_only=False)
    for words in slabs(column, size=1 << 20):
        ids, off = enc.slab(words, odd[words.row:words.row + words.rows])
        ends = off[1:] + np.arange(1, words.rows + 1)
        out = np.full(len(ids) + words.rows, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = ids
        yield words.row, out, np.concatenate([[0], ends])


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
