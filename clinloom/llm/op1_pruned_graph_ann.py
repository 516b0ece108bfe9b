"""Operator 1: nearest neighbours by inner product on robust-pruned directed graphs.

1.  *Rows to nodes.*  Equal vectors are one node that keeps its 21 smallest ids, enough for
    20 neighbours of any query; the ranking limit cuts every map task's rows to that number
    before the shuffle, so a vector held by a third of all rows stays one small node.
2.  *Shards.*  Nodes are dealt by hash into shards of about ``SHARD``; every shard gets a directed
    graph.  Inner products become distances by one added coordinate that brings all vectors
    to the longest one's length.  Greedy searches over the graph so far propose neighbours
    for each node, robust pruning keeps at most ``DEGREE`` of them (a candidate goes when a
    kept neighbour is nearer to it, by the factor ``alpha``, than the node), and back edges are
    added and pruned alike; two passes, with alpha 1 and ``ALPHA``.
3.  *Search.*  A beam search of width ``BEAM`` from spread entry nodes queries each shard, queries in blocks of at most
    ``BLOCK`` a task, and the shards' best are merged.  Scores are inner products of the
    original vectors in double precision.

Result: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the 20 nearest found, ties to the
smaller id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do those of another dimension than the most frequent one (the smaller of
equals); rows that repeat with the same id and vector count once; rows with the same id and
different vectors are different candidates; a null id takes no part; fewer than 20
candidates are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import materialise

K = 20
SHARD, DEGREE, BUILD, BEAM, ALPHA, BLOCK, BATCH, WIDE, DOORS = 4096, 32, 64, 96, 1.2, 4096, 256, 4, 31
_INDEX = ("shard int, n int, dim int, start int, vectors binary, graph binary, nodes binary, member_off binary, "
          "members binary")


class Graph:
    """A directed neighbour graph over the rows of ``x``; -1 pads short neighbour lists."""

    def __init__(self, x: np.ndarray, graph: np.ndarray | None = None, start: int = 0):
        norm = np.einsum("ij,ij->i", x, x)
        top = norm.max() if len(x) else 0.0
        self.lift = np.concatenate([x, np.sqrt(np.maximum(top - norm, 0))[:, None]], axis=1).astype(np.float32)
        self.top = float(top)
        self.graph, self.start = graph, start

    def doors(self) -> np.ndarray:
        """Where searches start: the centre and ``DOORS`` fixed nodes spread over the shard.

        A dense cloud of vectors can fill its members' lists with each other; searches that
        start outside of it as well still reach everything else.
        """
        spread = np.random.default_rng(11).permutation(len(self.lift))[:DOORS]
        return np.unique(np.append(spread, self.start))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of a beam search for each row of ``q`` (lifted), nearest first; -1 pads.

        All searches advance together; each step expands up to ``WIDE`` nodes of every beam.
        """
        m, n = len(q), len(self.lift)
        ids = np.full((m, width), -1, np.int32)
        dist = np.full((m, width), np.inf, np.float32)
        open_ = np.zeros((m, width), bool)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True                                          # the padding's place
        doors = self.doors()[:width]
        first = self.top - q @ self.lift[doors].T
        order = np.argsort(first, axis=1, kind="stable")
        ids[:, :len(doors)], open_[:, :len(doors)] = doors[order], True
        dist[:, :len(doors)] = np.take_along_axis(first, order, 1)
        seen[:, doors] = True
        live = np.arange(m)
        while len(live):
            turn = np.cumsum(open_[live], axis=1)
            pick = open_[live] & (turn <= WIDE)
            r, c = np.nonzero(pick)
            open_[live[r], c] = False
            near = self.graph[ids[live[r], c]]                     # (expanded, degree)
            cand = np.full((len(live), WIDE, near.shape[1]), n, np.int32)
            cand[r, turn[r, c] - 1] = np.where(near < 0, n, near)
            cand = cand.reshape(len(live), -1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n           # once each
            fresh = ~seen[live[:, None], cand]
            seen[live[:, None], cand] = True
            rows, cols = np.nonzero(fresh)
            far = np.full(cand.shape, np.inf, np.float32)
            far[rows, cols] = self.top - np.einsum("ij,ij->i", q[live[rows]], self.lift[cand[rows, cols]])
            all_d = np.concatenate([dist[live], far], axis=1)
            all_i = np.concatenate([ids[live], cand], axis=1)
            all_o = np.concatenate([open_[live], fresh], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            take = np.take_along_axis
            dist[live], ids[live] = take(all_d, best, 1), take(all_i, best, 1)
            open_[live] = take(all_o, best, 1) & np.isfinite(dist[live])
            live = live[open_[live].any(axis=1)]
        ids[~np.isfinite(dist)] = -1
        return ids, dist

    def prune(self, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Robust pruning of each node's candidates (-1 pads): at most ``degree`` diverse ones."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        vec = self.lift[np.maximum(cand, 0)]
        d = np.where(cand < 0, np.inf, self._gap(np.einsum("bcd,bd->bc", vec, self.lift[nodes])))
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        vec = self.lift[np.maximum(cand, 0)]
        mutual = self._gap(vec @ vec.transpose(0, 2, 1)) * alpha
        alive = np.isfinite(d)
        out = np.full((len(nodes), degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(degree):
            first = alive.argmax(axis=1)
            have = alive[rows, first]
            if not have.any():
                break
            out[:, k] = np.where(have, cand[rows, first], -1)
            alive &= mutual[rows, first] > d
            alive[rows, first] = False
        return out

    def _gap(self, inner: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (self.top - inner), 0))

    @staticmethod
    def build(x: np.ndarray, degree: int = DEGREE, width: int = BUILD, alpha: float = ALPHA, seed: int = 7) -> Graph:
        self, n = Graph(x), len(x)
        rng = np.random.default_rng(seed)
        if n <= degree:
            full = np.tile(np.arange(n, dtype=np.int32), (n, 1))
            self.graph = np.where(full == np.arange(n)[:, None], -1, full) if n else np.zeros((0, degree), np.int32)
            return self
        mean = self.lift.mean(axis=0)
        self.start = int(((self.lift - mean) ** 2).sum(axis=1).argmin())
        half = degree // 2
        self.graph = np.full((n, degree), -1, np.int32)
        self.graph[:, :half] = rng.integers(0, n, (n, half))
        for a in (1.0, alpha):
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                p = order[lo:lo + BATCH]
                found, _ = self.search(self.lift[p], width)
                self.graph[p] = self.prune(p, np.concatenate([found, self.graph[p]], axis=1), degree, a)
                src, dst = np.repeat(p, degree), self.graph[p].ravel()
                ok = dst >= 0
                self._back(src[ok], dst[ok], degree, a)
        return self

    def _back(self, src: np.ndarray, dst: np.ndarray, degree: int, alpha: float) -> None:
        """Edges dst -> src; lists that overflow are pruned."""
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, first, size = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(node), BATCH):
            part, f, s = node[lo:lo + BATCH], first[lo:lo + BATCH], size[lo:lo + BATCH]
            add = np.full((len(part), s.max()), -1, np.int64)
            r = np.repeat(np.arange(len(part)), s)
            add[r, np.arange(len(r)) - np.repeat(np.cumsum(s) - s, s)] = src[np.repeat(f, s) + np.arange(len(r))
                                                                          - np.repeat(np.cumsum(s) - s, s)]
            both = np.concatenate([self.graph[part], add], axis=1)
            both = np.where(both == part[:, None], -1, both)
            both = -np.sort(-both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, axis=1)
            over = (both >= 0).sum(axis=1) > degree
            self.graph[part[~over]] = both[~over, :degree]
            if over.any():
                self.graph[part[over]] = self.prune(part[over], both[over], degree, alpha)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _build(key, group):
    x = _matrix(group.column("embedding"))
    g = Graph.build(x.astype(np.float64))
    ids = group.column("ids").combine_chunks()
    off = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())]).astype("<i8")
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int32()),
        "dim": pa.array([x.shape[1]], pa.int32()), "start": pa.array([g.start], pa.int32()),
        "vectors": [x.astype("<f4").tobytes()], "graph": [g.graph.astype("<i4").tobytes()],
        "nodes": [group.column("node").to_numpy().astype("<i8").tobytes()], "member_off": [off.tobytes()],
        "members": [np.asarray(ids.flatten()).astype("<i8").tobytes()]})


_FOUND = pa.schema([("qnode", pa.int64()), ("node", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(key, index, asked, k: int, beam: int):
    """The k + 1 best members of one shard for each query of a block."""
    if not index.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    row = {c: index.column(c)[0].as_py() for c in index.schema.names}
    x = np.frombuffer(row["vectors"], "<f4").reshape(row["n"], row["dim"])
    graph = np.frombuffer(row["graph"], "<i4").reshape(row["n"], -1)
    node = np.frombuffer(row["nodes"], "<i8")
    off, member = np.frombuffer(row["member_off"], "<i8"), np.frombuffer(row["members"], "<i8")
    x64 = x.astype(np.float64)
    g = Graph(x64, graph, row["start"])
    q, qnode = _matrix(asked.column("embedding")).astype(np.float64), asked.column("qnode").to_numpy()
    lift = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    out = []
    for lo in range(0, len(q), BATCH):
        ids, _ = g.search(lift[lo:lo + BATCH], beam)
        for i in range(len(ids)):
            hit = ids[i][ids[i] >= 0]
            score = (x64[hit] * q[lo + i]).sum(axis=1)
            size = off[hit + 1] - off[hit]
            owner = np.repeat(np.arange(len(hit)), size)
            vec = np.concatenate([member[off[h]:off[h + 1]] for h in hit])
            best = np.lexsort((vec, -score[owner]))[:k + 1]
            out.append((np.full(len(best), qnode[lo + i]), node[hit[owner[best]]], vec[best], score[owner[best]]))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_FOUND)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, each id and vector once."""
    v = F.col("embedding")
    inf = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding"))
    rows = rows.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size(v) == (dims[0]["d"] if dims else 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, shard: int = SHARD, beam: int = BEAM,
            block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows for each row of ``queries``.

    ``queries`` are rows of ``vectors`` (default: ids divisible by 20).
    """
    rows = valid_vectors(vectors, id_col, vec_col)
    asked = rows.filter("vec_id % 20 = 0") if queries is None else rows.join(
        queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = (rows.groupBy("embedding", "vec_id").agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
             .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = materialise(nodes, "op1-nodes")
    shards = max(1, -(-nodes.count() // shard))
    index = materialise(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
                        .groupBy("shard").applyInArrow(_build, _INDEX), "op1-index")
    asked = materialise(asked.distinct().join(nodes.select("embedding", "node"), "embedding")
                        .select(F.col("vec_id").alias("query_id"), F.col("node").alias("qnode")), "op1-queries")
    different = asked.select("qnode").distinct()
    different = materialise(different.join(nodes.select(F.col("node").alias("qnode"), "embedding"), "qnode"), "op1-asked")
    blocks = max(1, -(-different.count() // block))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = index.withColumn("qblock", all_blocks)
    right = different.withColumn("qblock", F.pmod(F.xxhash64("qnode"), F.lit(blocks)).cast("int")) \
        .withColumn("shard", all_shards)

    def search(key, index, asked):
        return _search(key, index, asked, k, beam)

    found = left.groupBy("shard", "qblock").cogroup(right.groupBy("shard", "qblock")).applyInArrow(
        search, "qnode long, node long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id"), F.asc("node")]
    top = materialise(found.withColumn("r", F.row_number().over(Window.partitionBy("qnode").orderBy(*order)))
                      .filter(F.col("r") <= k + 1), "op1-top")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("node") == F.col("qnode"))
    per_query = Window.partitionBy("query_id", "qnode").orderBy("r")
    return (asked.join(top, "qnode").filter(~own)
            .withColumn("rank", F.row_number().over(per_query).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op1_pruned_graph_ann")
def op1_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 20 against the whole ``embeddings`` table."""
    return nearest(table(spark, sf_dir, "embeddings"))
