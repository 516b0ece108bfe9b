"""Operator 2: best-fit packing with a swap-based local search.

A document's ids (byte-level BPE, then the end id) stay whole unless they exceed the
sequence length; longer ones are cut so that every piece but the first is full.  Full
pieces are sequences by themselves.  The others are dealt at random into shards of about
``SHARD`` pieces; in each shard best-fit by descending length gives a first packing, and a
local search improves it: the emptiest bin hands documents to other underfull bins by a
move, a one-for-one or a two-for-one exchange, always raising the sum of squared fills,
until it is empty and goes, or no exchange is left.  The search ends early once the shard
has the fewest sequences any packing can have (a lower bound).

The search tries every pair of different lengths of a bin (a bin has at most 44) and passes
follow until one changes nothing; as every step raises the squared fill, that comes to pass.

Shards hold a bounded number of pieces, so work and memory per task stay level at any
input size; each shard can leave at most a few sequences that are not full.

Defined cases: null or empty text is the end id alone (one piece of length 1); a null
``doc_id`` stays null; repeated rows are packed as often as they occur; an empty table
gives no rows; other columns are not read.  Ids and texts never leave their task: a piece
carries its place, length and checksum (``ids=True`` adds the ids themselves).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import partial
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import materialise, small_batches
from clinloom.llm.tokens import documents, vocabulary

CAPACITY = 1024
END_ID = 2
SHARD = 8192
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def _cut(batches, path: str, capacity: int, end_id: int, ids: bool):
    for batch in batches:
        doc = batch.column("doc_id")
        for row, flat, off in documents(batch.column("text"), path, "spaced", end_id):
            size = np.diff(off)
            n = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            short = size - capacity * (n - 1)                       # length of the first piece
            start = np.where(piece == 0, 0, short[owner] + capacity * (piece - 1))
            length = np.where(piece == 0, short[owner], capacity)
            raw = memoryview(flat.astype("<u4").tobytes())
            a = off[owner] + start
            crc = [zlib.crc32(raw[4 * x:4 * (x + y)]) for x, y in zip(a.tolist(), length.tolist(), strict=True)]
            crc = np.array(crc, np.int64)
            # spreads pieces over shards by their content, so a retried task deals them alike
            salt = (crc * 2654435761 + start * 40503 + owner * 7919 + row) & 0x7FFFFFFF
            cols = [doc.take(pa.array(owner + row)), pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc),
                    pa.array(salt.astype(np.int64))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            if ids:
                cols.append(pa.array([flat[x:x + y].tolist() for x, y in zip(a, length, strict=True)],
                                     pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit packing by descending length: item numbers of each bin."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []                                # (free, bin), ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free - size:
            insort(room, (free - size, b))
    return bins


def at_least(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing can have: pieces above half a bin each open one, the small ones
    fill what these leave (the best bound over all limits k of "small")."""
    size = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(size)])
    half = np.searchsorted(size, capacity // 2, side="right")
    best = -(-int(total[-1]) // capacity)
    for k in np.unique(np.concatenate([[0], size[:half]])).tolist():
        large = int(np.searchsorted(size, capacity - k, side="right"))
        small = int(np.searchsorted(size, k))
        room = max(large - half, 0) * capacity - int(total[max(large, half)] - total[half])
        extra = int(total[half] - total[small]) - room
        best = max(best, len(size) - half + max(0, -(-extra // capacity)))
    return best


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search on the underfull bins (see the module text); returns the bins that are left.

    Every step takes length from an emptier bin to a fuller one, so the sum of squared
    fills rises with each.  A pass tries every underfull bin once; passes follow as long as
    one changes something and bins beyond the lower bound are left.
    """
    least = at_least(lengths, capacity)
    before = None
    while len(bins) > least:
        fills = sorted(int(lengths[b].sum()) for b in bins)
        if fills == before:
            break
        before = fills
        bins = one_pass(bins, lengths, capacity, least)
    return bins


def one_pass(bins: list[list[int]], lengths: np.ndarray, capacity: int, least: int) -> list[list[int]]:
    """One round over the underfull bins, emptiest first."""
    fills = [int(lengths[b].sum()) for b in bins]
    done = [b for b, f in zip(bins, fills, strict=True) if f == capacity]
    work = sorted(((f, b) for b, f in zip(bins, fills, strict=True) if f < capacity), key=lambda x: x[0])
    stuck: list[list[int]] = []
    while work and len(done) + len(stuck) + len(work) > least:
        source = list(work[0][1])
        targets = [list(b) for _, b in work[1:]]
        if not targets:
            break
        room = np.array([capacity - f for f, _ in work[1:]], np.int64)
        owner = np.repeat(np.arange(len(targets)), [len(b) for b in targets])
        item = np.array([i for b in targets for i in b], np.int64)
        size = lengths[item]
        moved = True
        while source and moved:
            moved = False
            for i in sorted(source, key=lambda x: -lengths[x]):     # move: tightest room that takes it
                fit = np.where(room >= lengths[i], room, capacity + 1)
                b = int(fit.argmin())
                if fit[b] <= capacity:
                    source.remove(i)
                    room[b] -= lengths[i]
                    owner, item, size = np.append(owner, b), np.append(item, i), np.append(size, lengths[i])
                    moved = True
            if not source:
                break
            best = None                                             # (gain, given items, slot taken)
            one, two = {}, {}                                       # a place for every length, every pair of lengths
            for i in source:
                one.setdefault(int(lengths[i]), []).append(i)
            for x, y in combinations_with_replacement(one, 2):
                if x != y or len(one[x]) > 1:
                    two[x, y] = (one[x][0], one[y][x == y])
            for given in [(i[0],) for i in one.values()] + list(two.values()):     # one-for-one, then two-for-one
                have = int(lengths[list(given)].sum())
                gain = np.where((size < have) & (have - size <= room[owner]), have - size, 0)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > 0 and (best is None or gain[k] > best[0]):
                    best = (int(gain[k]), given, k)
            if best is not None:
                gain, given, k = best
                b, taken = int(owner[k]), int(item[k])
                for i in given:
                    source.remove(i)
                source.append(taken)
                room[b] -= gain
                keep = np.arange(len(item)) != k
                owner = np.concatenate([owner[keep], [b] * len(given)])
                item = np.concatenate([item[keep], given]).astype(np.int64)
                size = lengths[item]
                moved = True
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(1, len(targets)))
        targets = [b.tolist() for b in np.split(item[order], cuts)]
        if source:
            stuck.append(source)
        done += [b for b, r in zip(targets, room, strict=True) if r == 0]
        work = sorted(((capacity - int(r), b) for b, r in zip(targets, room, strict=True) if r), key=lambda x: x[0])
    return done + stuck + [b for _, b in work]


def _pack(key: tuple, group: pa.Table, capacity: int) -> pa.Table:
    length = group.column("length").to_numpy()
    loose = np.flatnonzero(length < capacity)
    full = np.flatnonzero(length == capacity)
    bins = [[int(i)] for i in full]
    if len(loose):
        own = length[loose]
        bins += [loose[b].tolist() for b in improve(best_fit(own, capacity), own, capacity)]
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n, b in enumerate(bins):
        at = 0
        for i in b:
            sequence[i], offset[i] = n, at
            at += int(length[i])
    return (group.drop_columns(["salt", "shard"])
            .append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32)))
            .append_column("offset", pa.array(offset)))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD,
         ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + (", ids array<int>" if ids else "")
    pieces = materialise(rows.mapInArrow(partial(_cut, path=path, capacity=capacity, end_id=end_id, ids=ids),
                                         schema), "op2-pieces")
    shards = -(-pieces.count() // shard) or 1
    def packed(key, group):
        return _pack(key, group, capacity)

    out = schema.replace(", salt long", "") + ", sequence_id long, offset long"
    return (pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)))
            .groupBy("shard").applyInArrow(packed, out))


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in sequences of 1024."""
    return _columns(pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing of all documents that are left."""
    return _columns(pack(docs, vocabulary("byte_bpe_50k.json")))
