"""Operator 13: repeated byte strings removed by the interval tree of an enhanced suffix array.

Every byte covered by a ``window``-byte string (200) that also starts anywhere else -- in another
row or elsewhere in the same row -- is removed.  Strings are judged on the input, never on what
is left; texts are UTF-8 bytes and matches never cross rows.

1.  *Sparse suffixes.*  Of the ``seed``-byte grams in a window those with the smallest hash are its
    anchors; equal windows have equal anchors, so no repeat escapes.  The suffixes that start
    at an anchor stand for all others (about one byte in 77).  An anchor counted once is dropped.
2.  *Suffix array.*  A suffix is kept to ``window`` bytes, together with the ``window - seed`` bytes to
    its left: no window that holds the anchor reaches further.  Equal contexts become one row.
    Spark deals contexts by anchor and sorts each task's suffixes: a suffix array per anchor.
3.  *Interval tree.*  Common prefixes of neighbours are measured on the bytes; a scan with a stack
    turns them into the tree of common-prefix intervals, innermost first.
4.  *Left extension.*  An interval's suffixes agree on ``depth`` bytes to the right.  Sorted by what
    stands to their left they fall into classes that agree on ``window - depth`` bytes and more;
    where left extensions differ a class ends.  A class of two and more is a group of maximal
    repeats with all of its occurrences, not only neighbours in the array; a context is listed
    once, with its outermost group.
5.  *Cover.*  A context is covered as far as it agrees with another one to the left and right; contexts
    that occur twice are covered whole.  What rows hold of them is joined back and removed.

An anchor with more than ``heavy`` occurrences would make one large array; its windows are compared
one by one instead, by a 128-bit hash, counted with partial sums.  Tasks skip anchors by bitmaps
of fixed size that lose none.  Anchors and contexts are 64-bit hashes each, compared together;
common prefixes and left extensions are compared byte by byte.

Defined cases: null and empty texts have no bytes; shorter rows are unchanged; repeated rows (same
id, same text) are separate places, so each loses what the other holds; a null ``doc_id`` stays
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.bits import bit_set, held
from clinloom.llm.catalog import query, table
from clinloom.llm.op7_substring_dedup import _slide
from clinloom.llm.shared import keyed, materialise
from clinloom.llm.words import SLAB_BYTES, hash_ints, mix, release, spans, texts, trim, whole, windows

WINDOW, SEED = 200, 48
HEAVY = 1 << 15                      # occurrences of an anchor whose suffixes one task sorts
BITS = 26
BLOCK = 1 << 14                      # contexts a task works on at a time, unless one anchor has more
_U = np.uint64
_TOP = np.uint64(2**64 - 1)
_BYTE = hash_ints(np.arange(256), 13)


def slabs(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slabs of whole rows."""
    trim()
    data, off = texts(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB_BYTES, side="right")) - 1)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def anchors(data: np.ndarray, off: np.ndarray, window: int, seed: int):
    """(places, hashes, row, bytes to the left, bytes to the right, context hash) of a slab's anchors."""
    n = len(data)
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e.view(_U), e, e, e, e.view(_U)
    h = _BYTE[data]
    v = windows(h, seed)
    w = window - seed + 1
    low = _slide(np.where(whole(off, n, seed), v, _TOP), w, np.minimum)
    low[~whole(off, n, window)] = 0                              # windows across rows select nothing
    edge = np.zeros(w - 1, _U)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum) == v)
    row = np.searchsorted(off, at, side="right") - 1
    left = np.minimum(at - off[row], window - seed)
    right = np.minimum(off[row + 1] - at, window)
    ctx = mix(spans(h, at - left, at + right, 3) + left.astype(_U) * _U(0x9E3779B97F4A7C15) + right.astype(_U))
    return at, mix(v[at]), row, left, right, ctx                 # the smallest hashes, spread over all bits again


def _count(batches, window: int, seed: int):
    release()
    for batch in batches:
        for _, data, off in slabs(batch.column("text")):
            _, node, _, _, _, ctx = anchors(data, off, window, seed)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ctx.view(np.int64))],
                                                 names=["node", "c"])


def _places(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(mix(k1.view(_U)) + k2.view(_U) + pos.astype(_U) * _U(0x9E3779B97F4A7C15))


def _hits(batches, window: int, seed: int, repeated, heavy):
    """Places of repeated anchors; for heavy ones every window instead (``l`` is -1, ``node`` and ``c`` its hash)."""
    release()
    for batch in batches:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for lo, data, off in slabs(batch.column("text")):
            at, node, row, left, right, ctx = anchors(data, off, window, seed)
            ok = held(repeated.value, node)
            at, node, row, left, right, ctx = (x[ok] for x in (at, node, row, left, right, ctx))
            big = held(heavy.value, node)
            if big.any():
                begin = np.maximum(at[big] - (window - seed), off[row[big]])
                end = np.minimum(at[big], off[row[big] + 1] - window) + 1
                mark = np.zeros(len(data) + 1, np.int64)
                np.add.at(mark, begin, 1)
                np.add.at(mark, end, -1)
                s = np.flatnonzero(np.cumsum(mark) > 0)
                h, owner, none = _BYTE[data], np.searchsorted(off, s, side="right") - 1, np.full(len(s), -1, np.int64)
                at, row = np.concatenate([at, s]), np.concatenate([row, owner])
                node, ctx = (np.concatenate([x, spans(h, s, s + window, k)]) for x, k in ((node, 3), (ctx, 5)))
                left, right = np.concatenate([left, none]), np.concatenate([right, none])
            pos, a, b = at - off[row], k1[lo + row], k2[lo + row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(pos.astype(np.int32)), pa.array(node.view(np.int64)),
                 pa.array(ctx.view(np.int64)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                 pa.array(_places(a, b, pos).view(np.int64))],
                names=["k1", "k2", "pos", "node", "c", "l", "r", "place"])


def _contexts(batches, window: int, seed: int, varied, heavy, shown):
    """(node, c, l, r, ctx): the bytes of each different context of an anchor, from its chosen place."""
    release()
    seen = np.zeros(1 << 18, _U)
    for batch in batches:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for lo, data, off in slabs(batch.column("text")):
            at, node, row, left, right, ctx = anchors(data, off, window, seed)
            key = mix(node + ctx * _U(3))
            slot = (key >> _U(46)).astype(np.int64)
            ok = held(varied.value, node) & ~held(heavy.value, node) & (seen[slot] != key)
            ok &= held(shown.value, _places(k1[lo + row], k2[lo + row], at - off[row]))
            i = np.flatnonzero(ok)
            _, first = np.unique(key[i], return_index=True)       # repeated rows share their places
            i = i[np.sort(first)]
            seen[slot[i]] = key[i]
            raw = data.tobytes()
            text = [raw[x:y] for x, y in zip((at - left)[i].tolist(), (at + right)[i].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[i].view(np.int64)), pa.array(ctx[i].view(np.int64)), pa.array(left[i].astype(np.int32)),
                 pa.array(right[i].astype(np.int32)), pa.array(text, pa.binary())], names=["node", "c", "l", "r", "ctx"])


def _aligned(flat: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of up to ``width`` bytes from ``at`` on (backwards for step -1), filled up with 255."""
    out = np.full((len(at), width), 255, np.uint8)                # not a byte of UTF-8
    idx = at[:, None] + step * np.arange(width)[None, :]
    mask = np.arange(width)[None, :] < size[:, None]
    out[mask] = flat[idx[mask]]
    return out


def _agree(m: np.ndarray, size: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in ``order``; -1 where the group changes."""
    a, b = order[:-1], order[1:]
    same = m[a] == m[b]
    run = np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1))
    run = np.minimum(run, np.minimum(size[a], size[b]))
    return np.concatenate([[-1], np.where(group[a] == group[b], run, -1)]).astype(np.int64)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of a suffix array, children before parents.

    ``lcp[i]`` is what suffixes i - 1 and i have in common; below 0 nothing holds them together.
    """
    stack: list[tuple[int, int]] = [(-1, 0)]
    for i in range(1, len(lcp) + 1):
        now, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if stack[-1][0] < now:
            stack.append((now, first))


def _range_min(v: np.ndarray) -> list[np.ndarray]:
    out, k = [v], 1
    while 2 * k <= len(v):
        out.append(np.minimum(out[-1][:-k], out[-1][k:]))
        k *= 2
    return out


def _least(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of v[a + 1 .. b] for a < b."""
    size = b - a
    k = np.frexp(size.astype(float))[1] - 1
    out = np.zeros(len(a), np.int64)
    for j in np.unique(k):
        at = k == j
        out[at] = np.minimum(levels[j][a[at] + 1], levels[j][b[at] - (1 << int(j)) + 1])
    return out


def repeat_classes(group: np.ndarray, flat: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray,
                   window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(members, cover to the left, to the right, class, its depth, agreement to the left with the one before).

    Contexts come in the order of (group, suffix); context i is ``flat[begin[i]:begin[i] + left[i] +
    right[i]]`` with its suffix from ``left[i]`` on.  Members are the contexts in any group of
    maximal repeats, class the outermost such group, whose members follow each other.
    """
    n, reach = len(group), window - seed
    order = np.arange(n)
    lcp = _agree(_aligned(flat, begin + left, right, window, 1), right, order, group)
    back = _aligned(flat, begin + left - 1, left, reach, -1)
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])).astype(">u4")[:n]
    keys = np.concatenate([number.view(np.uint8).reshape(n, 4), back], axis=1)
    by_left = np.argsort(np.ascontiguousarray(keys).view(f"V{4 + reach}").ravel(), kind="stable")
    levels = _range_min(_agree(back, left, by_left, group))
    rank = np.empty(n, np.int64)
    rank[by_left] = order
    tree = np.array([x for x in intervals(lcp.tolist()) if x[0] >= window - reach], np.int64).reshape(-1, 3)
    far, wide, outer, deep, before = (np.full(n, -1, np.int64) for _ in range(5))
    for depth in np.unique(tree[:, 0])[::-1].tolist():            # inner intervals first
        first, last = tree[tree[:, 0] == depth, 1], tree[tree[:, 0] == depth, 2]
        size = last - first + 1
        owner = np.repeat(np.arange(len(first)), size)
        member = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        at = np.lexsort((rank[member], owner))
        member, owner = member[at], owner[at]
        with_last = np.full(len(member) + 1, -1, np.int64)        # agreement with the one before
        mine = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        with_last[mine] = _least(levels, rank[member[mine - 1]], rank[member[mine]])
        with_last[with_last + depth < window] = -1                # left extensions differ too early
        ext = np.maximum(with_last[:-1], with_last[1:])
        base = int(outer.max(initial=0)) + 1
        label = base + np.cumsum(with_last[:-1] < 0)
        held_ = ext >= 0
        m = member[held_]
        far[m] = np.maximum(far[m], ext[held_])
        wide[m] = np.maximum(wide[m], depth)
        outer[m], deep[m], before[m] = label[held_], depth, with_last[:-1][held_]
    m = np.flatnonzero(outer >= 0)
    m = m[np.lexsort((rank[m], outer[m]))]
    return m, far[m], wide[m], outer[m], deep[m], before[m]


def _blocks(batches) -> Iterator[pa.Table]:
    """The stream in tables of whole anchors of about ``BLOCK`` rows."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.num_rows
        node = batch.column("node").to_numpy()
        if size >= BLOCK and node[0] != node[-1]:
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1
            yield pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)])
            kept = [batch.slice(cut)]
            size = kept[0].num_rows
    if size:
        yield pa.Table.from_batches(kept)


def _tree(batches, window: int, seed: int):
    """(node, c, l, r, repeat, before, size): contexts that share a maximal repeat, what is covered, and their outermost group."""
    release()
    for t in _blocks(batches):
        node, c = t.column("node").to_numpy(), t.column("c").to_numpy()
        _, once = np.unique(mix(node.view(_U) + c.view(_U) * _U(3)), return_index=True)
        once = np.sort(once)                                      # a context may come from several tasks
        node, c = node[once], c[once]
        ctx = t.column("ctx").combine_chunks().take(pa.array(once)).cast(pa.large_binary())
        if isinstance(ctx, pa.ChunkedArray):
            ctx = ctx.combine_chunks()
        begin = np.frombuffer(ctx.buffers()[1], np.int64, len(ctx) + 1, ctx.offset * 8)[:-1]
        flat = np.frombuffer(ctx.buffers()[2], np.uint8)
        left, right = t.column("l").to_numpy()[once].astype(np.int64), t.column("r").to_numpy()[once].astype(np.int64)
        m, far, wide, label, deep, before = repeat_classes(node, flat, begin, left, right, window, seed)
        head = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(m) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([head, [len(m)]]))
        inner = before.copy()
        inner[head] = window
        common = np.minimum.reduceat(inner, head) if len(m) else inner   # what the whole class shares to the left
        raw = [hashlib.blake2b(flat[begin[i] + left[i] - x:begin[i] + left[i] + d].tobytes(), digest_size=16).digest()
               for i, x, d in zip(m[head].tolist(), common.tolist(), deep[head].tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [pa.array(node[m]), pa.array(c[m]), pa.array(far.astype(np.int32)), pa.array(wide.astype(np.int32)),
             pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(head)), size))),
             pa.array(np.repeat(common, size).astype(np.int32)), pa.array(np.repeat(size, size).astype(np.int32))],
            names=["node", "c", "l", "r", "repeat", "before", "size"])
        yield out


def _result(batches, with_kept: bool):
    for batch in batches:
        gone = batch.column("gone")
        cut = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(gone), 0).to_numpy())]).astype(np.int64)
        flat = gone.flatten()
        start, size = (flat.field(f).to_numpy() for f in ("start", "len"))
        rows = batch.num_rows
        n_bytes, removed, runs, sha, kept = (np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64),
                                             [None] * rows, [None] * rows)
        for lo, data, off in slabs(batch.column("text")):
            for r in range(len(off) - 1):
                i, own = lo + r, data[off[r]:off[r + 1]]
                n_bytes[i] = len(own)
                a, b = cut[i], cut[i + 1]
                if b > a:
                    mark = np.zeros(len(own) + 2, np.int64)
                    np.add.at(mark, start[a:b] + 1, 1)
                    np.add.at(mark, start[a:b] + size[a:b] + 1, -1)
                    out = np.cumsum(mark)[:-1] > 0                # out[0] is the place before the first byte
                    removed[i], runs[i] = out.sum(), (out[1:] & ~out[:-1]).sum()
                    own = own[~out[1:]]
                    kept[i] = own.tobytes() if with_kept else None
                sha[i] = hashlib.sha256(own.tobytes()).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(n_bytes), pa.array(removed),
             pa.array(runs), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            names=["k1", "k2", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


class Repeats:
    """Steps 1 to 4 over ``docs``: ``hits`` (places of contexts), ``groups`` (maximal repeats), ``loose`` (heavy windows)."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, seed: int = SEED, heavy: int = HEAVY,
                 id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < seed <= window:
            raise ValueError("seed must be within 1 .. window")
        spark = docs.sparkSession
        share = spark.sparkContext.broadcast
        self.rows, self.window = keyed(docs, id_col, text_col), window
        texts_, keyed_texts = self.rows.select("text"), self.rows.select("k1", "k2", "text")
        nodes = materialise(
            texts_.mapInArrow(partial(_count, window=window, seed=seed), "node long, c long")
            .groupBy("node").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("varied"))
            .filter("n > 1"), "op13-nodes")
        large = share(bit_set(nodes.filter(F.col("varied") & (F.col("n") > heavy)), "node", 20))
        repeated = share(bit_set(nodes, "node", BITS))
        varied = share(bit_set(nodes.filter("varied"), "node", BITS))
        found = materialise(keyed_texts.mapInArrow(
            partial(_hits, window=window, seed=seed, repeated=repeated, heavy=large),
            "k1 long, k2 long, pos int, node long, c long, l int, r int, place long"), "op13-hits")
        self.hits = found.filter("l >= 0")
        self.classes = materialise(self.hits.groupBy("node", "c").agg(
            F.count(F.lit(1)).alias("n"), F.max("l").alias("l"), F.max("r").alias("r"), F.min("place").alias("place")),
            "op13-classes")
        shown = share(bit_set(self.classes, "place", BITS))
        suffix = F.expr("substring(ctx, l + 1)")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        arrays = (keyed_texts.mapInArrow(
            partial(_contexts, window=window, seed=seed, varied=varied, heavy=large, shown=shown),
            "node long, c long, l int, r int, ctx binary").repartition(parts, "node").sortWithinPartitions("node", suffix))
        self.groups = materialise(arrays.mapInArrow(
            partial(_tree, window=window, seed=seed),
            "node long, c long, l int, r int, repeat binary, before int, size int"), "op13-groups")
        self.loose = None
        if large.value.any():
            single = found.filter("l < 0").select("k1", "k2", F.col("pos").alias("start"), F.col("node").alias("h1"), F.col("c").alias("h2"))
            twice = materialise(single.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "op13-twice")
            self.loose = single.join(twice, ["h1", "h2"], "left_semi").select(
                "k1", "k2", "start", F.lit(window).cast("int").alias("len"))

    def cover(self) -> DataFrame:
        """(k1, k2, start, len): repeated spans of the rows (they may overlap)."""
        copies = self.classes.filter(F.expr(f"n > 1 AND l + r >= {self.window}")).select("node", "c", "l", "r")
        covered = materialise(copies.union(self.groups.select("node", "c", "l", "r"))
                              .groupBy("node", "c").agg(F.max("l").alias("l"), F.max("r").alias("r")), "op13-covered")
        out = (self.hits.select("k1", "k2", "pos", "node", "c").join(covered, ["node", "c"])
               .select("k1", "k2", (F.col("pos") - F.col("l")).alias("start"), (F.col("l") + F.col("r")).alias("len")))
        return out if self.loose is None else out.union(self.loose)

    def occurrences(self) -> DataFrame:
        """(repeat, k1, k2, start, size): every place where a group of maximal repeats starts; ``size`` counts its contexts.

        Each context counts under its outermost group, the one with most occurrences.
        """
        return (self.groups.join(self.hits.select("node", "c", "k1", "k2", "pos"), ["node", "c"])
                .select("repeat", "k1", "k2", (F.col("pos") - F.col("before")).alias("start"), "size").distinct())


def suffix_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, heavy: int = HEAVY, with_kept: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per input row.

    ``kept`` holds the remaining bytes where ``with_kept`` is set and something was removed, else null.
    """
    found = Repeats(docs, window, seed, heavy, id_col, text_col)
    gone = materialise(found.cover().groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("gone")), "op13-gone")
    return found.rows.join(gone, ["k1", "k2"], "left").mapInArrow(
        partial(_result, with_kept=with_kept), "k1 long, k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, "
                                               "kept_sha256 string, kept binary")


# the definition itself, byte by byte, on the hexadecimal text
_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT rid, s, md5(substr(x, 2 * s + 1, 400)) AS h
  FROM (SELECT rid, x, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS s FROM d)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, s FROM w JOIN again USING (h)),
b AS (SELECT rid, pos, substr(x, 2 * pos + 1, 2) AS byte FROM (SELECT rid, x, unnest(range(0, len(x) // 2)) AS pos FROM d)),
f AS (
  SELECT b.rid, b.pos, b.byte, max(CASE WHEN hit.s IS NULL THEN 0 ELSE 1 END)
         OVER (PARTITION BY b.rid ORDER BY b.pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
  FROM b LEFT JOIN hit ON hit.rid = b.rid AND hit.s = b.pos),
r AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS begins FROM f),
k AS (SELECT rid, sum(gone) AS n_removed, sum(begins) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0) AS kept
      FROM r GROUP BY rid)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       coalesce(k.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""


@query("op13_suffix_dedup", _SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; 200-byte strings."""
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
