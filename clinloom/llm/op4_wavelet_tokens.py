"""Operator 4: token ids in compressed wavelet-matrix shards.

Documents are encoded whole (BPE with word ends, then the end id) in ascending ``doc_id``
order and written as shards.  A shard is one self-contained file image: the ids of its
documents as a wavelet matrix -- one bit-plane per id bit, highest first, each plane
stably partitioned by the one above it -- with sampled ranks, compressed plane by plane.
:class:`WaveletFile` answers from one image: token access, slices, ``rank`` (count of a
token before a place), ``select`` (place of its n-th occurrence), ``count`` and ``locate``.

The images are rows of a Parquet dataset (``part``, ``seq``, ``n_tokens``, ``image``):
Spark's own writer reaches any store the cluster has, commits atomically, and a lost
executor's task is simply written again.  ``part`` follows the ranges of ``doc_id``.

Defined cases: null text is empty (the end id alone); null ids come first; rows that share
an id follow each other in the order of their text's hash, and a range may end between them; an empty table writes no
shard and gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import scratch, small_batches
from clinloom.llm.tokens import documents, vocabulary

END_ID = 2
SHARD_TOKENS = 2 << 20
PARTS = 100_000                                          # ranges of ids at most
MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sIqq")
_RANK = 512                                              # bits between sampled ranks
_IMAGES = "part int, seq int, n_docs long, n_tokens long, image binary"


def encode_image(ids: np.ndarray, doc_ids: pa.Array, sizes: np.ndarray, level: int = 1) -> bytes:
    """The file image of one shard."""
    import zstandard
    press = zstandard.ZstdCompressor(level=level).compress
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    valid = np.asarray(doc_ids.is_valid())
    parts = [press(np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes()), press(np.packbits(valid).tobytes()),
             press(sizes.astype("<i8").tobytes())]
    for b in range(planes - 1, -1, -1):
        bit = (cur >> b).astype(np.uint8) & 1
        one = bit.view(bool)
        packed = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(bit, np.arange(0, len(bit), _RANK), dtype=np.uint32) if len(bit) \
            else np.zeros(0, np.uint32)
        parts += [press(packed.tobytes()), press((np.cumsum(ones) - ones).astype("<u4").tobytes())]
        cur = np.concatenate([cur[~one], cur[one]])
    index = struct.pack(f"<{len(parts)}q", *map(len, parts))
    return _HEAD.pack(MAGIC, planes, len(sizes), len(ids)) + index + b"".join(parts)


class WaveletFile:
    """Token access, counting and occurrence lookup in one shard image."""

    def __init__(self, image: bytes):
        import zstandard
        magic, self.planes, self.n_docs, self.n = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a wavelet token file")
        n_parts, at = 3 + 2 * self.planes, _HEAD.size
        sizes = struct.unpack_from(f"<{n_parts}q", image, at)
        at += 8 * n_parts
        parts = []
        for size in sizes:
            parts.append(zstandard.ZstdDecompressor().decompress(image[at:at + size]))
            at += size
        valid = np.unpackbits(np.frombuffer(parts[1], np.uint8))[:self.n_docs].astype(bool)
        self.doc_ids = pa.array(np.frombuffer(parts[0], "<i8"), mask=~valid)
        self.sizes = np.frombuffer(parts[2], "<i8")
        self.bits = [np.frombuffer(parts[3 + 2 * i], np.uint8) for i in range(self.planes)]
        self.ranks = [np.frombuffer(parts[4 + 2 * i], "<u4") for i in range(self.planes)]
        self.zeros = [self.n - self._ones(i, self.n) for i in range(self.planes)]

    def _bit(self, plane: int, i: int) -> int:
        return (int(self.bits[plane][i >> 3]) >> (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block = min(i // _RANK, len(self.ranks[plane]) - 1)
        if block < 0:
            return 0
        lo, hi = block * _RANK // 8, -(-i // 8)
        got = np.unpackbits(self.bits[plane][lo:hi], bitorder="little")[:i - 8 * lo]
        return int(self.ranks[plane][block]) + int(got.sum())

    def access(self, i: int) -> int:
        out = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, i), self._ones(p, i)
            out = 2 * out + bit
            i = self.zeros[p] + ones if bit else i - ones
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place ``i``."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._find(p, i - self.zeros[p] if bit else i, bit)
        return i

    def _find(self, plane: int, k: int, bit: int) -> int:
        """Place of the k-th ``bit`` in a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * _RANK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        lo = block * _RANK // 8
        got = np.unpackbits(self.bits[plane][lo:lo + _RANK // 8], bitorder="little")[:self.n - 8 * lo]
        return block * _RANK + int(np.flatnonzero(got == bit)[k - int(before[block])])

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest."""
        cur = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self.bits[p], bitorder="little")[:self.n]
            one = bit.view(bool)
            out = np.empty_like(cur)
            out[~one], out[one] = cur[:self.zeros[p]], cur[self.zeros[p]:]
            out |= bit.astype(cur.dtype) << np.array(self.planes - 1 - p, cur.dtype)
            cur = out
        return cur


def _write(batches, path: str, end_id: int, shard_tokens: int):
    part, seq = TaskContext.get().partitionId(), 0
    ids, docs, sizes, have = [], [], [], 0

    def image():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(map(len, sizes))]),
             pa.array([have]), pa.array([encode_image(np.concatenate(ids), pa.concat_arrays(docs),
                                                      np.concatenate(sizes))], pa.binary())],
            names=["part", "seq", "n_docs", "n_tokens", "image"])

    for batch in batches:
        for row, flat, off in documents(batch.column("text"), path, "plain", end_id):
            if have and have + len(flat) > shard_tokens:
                yield image()
                ids, docs, sizes, have, seq = [], [], [], 0, seq + 1
            ids.append(flat)
            docs.append(batch.column("doc_id").slice(row, len(off) - 1))
            sizes.append(np.diff(off))
            have += len(flat)
    if have:
        yield image()


def write_shards(docs: DataFrame, out: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                 partition_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write their shards below ``out`` in ascending id order."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, -(-total // partition_bytes)), PARTS)       # beyond, ranges grow; shards do not
    (rows.repartitionByRange(parts, "doc_id", F.xxhash64("text"), F.rand(4))
     .sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(partial(_write, path=path, end_id=end_id, shard_tokens=shard_tokens), _IMAGES)
     .write.option("compression", "none").parquet(out))


def _read(batches):
    for batch in batches:
        for part, seq, image in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(),
                                    batch.column("image"), strict=True):
            file = WaveletFile(image.as_py())
            raw = memoryview(file.tokens().astype("<u4").tobytes())
            end = np.cumsum(file.sizes)
            start = end - file.sizes
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            n = file.n_docs
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), file.doc_ids,
                 pa.array(start.astype(np.int64)), pa.array(file.sizes.astype(np.int64)),
                 pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards below ``out``."""
    images = spark.read.schema(_IMAGES).parquet(out)
    sums = images.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()   # ``PARTS`` rows at most
    ends = np.cumsum([r["n"] for r in sums], dtype=np.int64)
    parts = spark.createDataFrame(pa.table({"part": pa.array([r["part"] for r in sums], pa.int32()),
                                            "first": pa.array([int(e) - r["n"] for r, e in zip(sums, ends, strict=True)], pa.int64())}))
    in_part = Window.partitionBy("part").orderBy("seq")
    before = (images.select("part", "seq", "n_tokens").join(F.broadcast(parts), "part")
              .select("part", "seq", (F.col("first") + F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("base")))
    read = images.select("part", "seq", "image").mapInArrow(
        _read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return (read.join(before, ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"))


@query("op4_wavelet_tokens")
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through shards in the shared folder."""
    out = scratch(spark, "op4-shards")
    write_shards(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"))
    return read_shards(spark, out)
