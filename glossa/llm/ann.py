"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are indexed once, with the smallest of their ids. Vectors are dealt to shards by hash;
each shard builds its graph as flat arrays of neighbours (-1 for none), which are stored, a row for each
shard. Nodes are inserted from the highest layer down; a node's candidates are its nearest among those
inserted before, by matrix products, which in a shard of bounded size cost less than searching the graph.
Stored graphs are searched for blocks of queries, many queries at a time; the shards' results are merged,
and scores are Euclidean distances in double precision on the original vectors.

Nulls and odd inputs: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do null ids; vectors of another length than the query's are no candidates for it; rows that
repeat an id and vector count once; an id with several vectors is as near as the nearest of them, as query
and as candidate; fewer candidates than `k` are all returned, as a graph of few nodes is read in full; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import materialize, release

LINKS = 16  # neighbours a node keeps above the lowest layer; twice as many there
BUILD_WIDTH, SEARCH_WIDTH = 64, 128
BATCH, EXPAND = 256, 4  # nodes inserted or queries searched at a time; candidates that each expands in a step
SHARD_ROWS, MOST_ROWS = 16_384, 131_072  # vectors of a shard: a 512th of all, between these
QUERIES = 4096  # of a block


class Graph:
    """neighbours[layer] is (nodes of the layer or all, slots) of node numbers; layer 0 holds all nodes."""

    def __init__(self, vectors: np.ndarray, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        n = len(self.x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        self.top = int(level.max()) if n else 0
        self.neighbours = [np.full((n, 2 * LINKS if layer == 0 else LINKS), -1, np.int32) for layer in range(self.top + 1)]
        self.entry, self.entry_level = (int(level.argmax()), self.top) if n else (-1, -1)
        # High nodes first, so that the nodes of a layer that are there are always the first ones of the order.
        self.order = np.argsort(-level, kind="stable")
        self.sizes = [int((level >= layer).sum()) for layer in range(self.top + 1)]
        at, size = 0, 1
        while at < n:
            self._insert(at, min(at + size, n), level)
            at += size
            size = min(BATCH, max(1, at))

    def distance(self, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of ids."""
        return qn[:, None] + self.norm[ids] - 2 * np.einsum("ijk,ik->ij", self.x[ids], q)

    def search_layer(self, q: np.ndarray, qn: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes met from `start` (queries by nodes, -1 for none), nearest first: ids (-1 for none) and squared distances."""
        links, rows = self.neighbours[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        ids = np.full((len(q), width), -1, np.int32)
        dist = np.full((len(q), width), np.inf, np.float32)
        done = np.ones((len(q), width), bool)

        def add(new: np.ndarray, which: np.ndarray) -> None:
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            row, at = np.nonzero(~seen[which[:, None], new])
            node, query = new[row, at], which[row]
            seen[query, node] = True
            counts = np.bincount(row, minlength=len(which))
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            fresh, d = np.full((len(which), counts.max()), -1, np.int32), np.full((len(which), counts.max()), np.inf, np.float32)
            fresh[row, place] = node
            d[row, place] = qn[query] + self.norm[node] - 2 * np.einsum("ij,ij->i", self.x[node], q[query])
            all_d = np.concatenate([dist[which], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            pick = np.arange(len(which))[:, None]
            dist[which] = all_d[pick, order]
            ids[which] = np.concatenate([ids[which], fresh], axis=1)[pick, order]
            done[which] = np.concatenate([done[which], fresh < 0], axis=1)[pick, order]

        add(start, rows)
        while len(rows := np.flatnonzero(~done.all(axis=1))):
            best = np.argsort(done[rows], axis=1, kind="stable")[:, :EXPAND]  # the nearest not yet expanded
            none = done[rows[:, None], best]
            done[rows[:, None], best] = True
            new = links[ids[rows[:, None], best]]
            new[none] = -1
            add(new.reshape(len(rows), -1), rows)
        return ids, dist

    def _pick(self, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of each row of candidates, nearest first, those nearer to the node than to any candidate picked before; then the nearest rest."""
        n, c = ids.shape
        there = ids >= 0
        x = self.x[np.maximum(ids, 0)]
        norm = self.norm[np.maximum(ids, 0)]
        between = norm[:, :, None] + norm[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
        picked, nearest = np.zeros((n, c), bool), np.full((n, c), np.inf, np.float32)
        left = np.full(n, most)
        for j in range(c):
            take = there[:, j] & (dist[:, j] <= nearest[:, j]) & (left > 0)
            picked[:, j] = take
            left -= take
            np.minimum(nearest, between[:, j], out=nearest, where=take[:, None])
        rank = np.where(picked, 0, np.where(there, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(ids, order, 1), -1)

    def _nearest(self, first: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For the nodes from `first` to `end` in order, the BUILD_WIDTH nearest of the first `size` but itself: ids (-1 for none) and squared distances, nearest first."""
        batch, others = self.order[first:end], self.order[:size]
        d = self.norm[batch][:, None] + self.norm[others] - 2 * self.x[batch] @ self.x[others].T
        own = np.arange(first, min(end, size))
        d[own - first, own] = np.inf
        if size > BUILD_WIDTH:
            near = np.argpartition(d, BUILD_WIDTH - 1, axis=1)[:, :BUILD_WIDTH]
            d = np.take_along_axis(d, near, 1)
        else:
            near = np.broadcast_to(np.arange(size), d.shape)
        by = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, by, 1)
        return np.where(np.isfinite(d), others[np.take_along_axis(near, by, 1)], -1), d

    def _insert(self, first: int, end: int, level: np.ndarray) -> None:
        """Link some nodes to those there before and to one another; a shard is small enough to find their nearest by matrix products."""
        for layer in range(int(level[self.order[first]]), -1, -1):
            last = min(end, self.sizes[layer])
            if last > first:
                self._link(self.order[first:last], *self._nearest(first, last, last), layer)

    def _link(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, layer: int) -> None:
        links = self.neighbours[layer]
        chosen = self._pick(self.x[nodes], ids, dist, LINKS)
        links[nodes, : chosen.shape[1]] = chosen
        a, b = np.nonzero(chosen >= 0)
        source, target = nodes[a], chosen[a, b]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first = np.unique(target, return_index=True)
        counts = np.diff(first, append=len(target))
        back = np.full((len(touched), counts.max() if len(counts) else 0), -1, np.int64)
        back[np.repeat(np.arange(len(touched)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        for i in range(0, len(touched), BATCH):
            t = touched[i : i + BATCH]
            new = back[i : i + BATCH, : counts[i : i + BATCH].max()]
            new = np.where((new[:, :, None] == links[t][:, None, :]).any(axis=2), -1, new)
            both = np.concatenate([links[t].astype(np.int64), new], axis=1)
            free = (both >= 0).sum(axis=1) <= links.shape[1]
            kept = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
            full = np.flatnonzero(~free)
            if len(full):
                d = np.where(both[full] >= 0, self.distance(self.x[t[full]], self.norm[t[full]], np.maximum(both[full], 0)), np.inf)
                order = np.argsort(d, axis=1, kind="stable")
                kept[full] = self._pick(self.x[t[full]], np.take_along_axis(both[full], order, 1), np.take_along_axis(d, order, 1), links.shape[1])
            links[t] = kept

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """(queries, k) node numbers, -1 for none; a graph of at most `width` nodes is read in full."""
        n = len(self.x)
        if n <= width:
            return np.tile(np.arange(n), (len(queries), 1))
        found = []
        for i in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[i : i + BATCH], np.float32)
            qn = np.einsum("ij,ij->i", q, q)
            at = np.full((len(q), 1), self.entry, np.int64)
            for layer in range(self.entry_level, 0, -1):
                at = self.search_layer(q, qn, at, layer, 4)[0]
            found.append(self.search_layer(q, qn, at, 0, max(width, k))[0][:, :k])
        return np.concatenate(found)

    def flat(self) -> dict:
        """The graph as a row: vectors and lowest layer whole, of each higher layer its nodes and their neighbours."""
        nodes = [np.flatnonzero((links >= 0).any(axis=1)).astype(np.int32) for links in self.neighbours[1:]]
        return {
            "dim": self.x.shape[1], "entry": self.entry, "vectors": self.x.tobytes(), "neighbours": self.neighbours[0].tobytes() if self.neighbours else b"",
            "upper_nodes": [n.tobytes() for n in nodes], "upper_neighbours": [links[n].tobytes() for n, links in zip(nodes, self.neighbours[1:], strict=True)],
        }

    @classmethod
    def stored(cls, row) -> Graph:
        """The graph of a row that `flat` made."""
        graph = cls.__new__(cls)
        graph.x = np.frombuffer(row.vectors, np.float32).reshape(-1, row.dim)
        graph.norm = np.einsum("ij,ij->i", graph.x, graph.x)
        graph.neighbours = [np.frombuffer(row.neighbours, np.int32).reshape(len(graph.x), -1)]
        for nodes, links in zip(row.upper_nodes, row.upper_neighbours, strict=True):
            layer = np.full((len(graph.x), LINKS), -1, np.int32)
            layer[np.frombuffer(nodes, np.int32)] = np.frombuffer(links, np.int32).reshape(-1, LINKS)
            graph.neighbours.append(layer)
        graph.entry, graph.entry_level = row.entry, len(row.upper_nodes)
        return graph


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<float>) of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & ~zero).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


INDEX = "shard int, dim int, entry int, ids binary, id_ends binary, vectors binary, neighbours binary, upper_nodes array<binary>, upper_neighbours array<binary>"


def index_rows(rows: DataFrame, k: int, shard_rows: int | None = None) -> DataFrame:
    """The stored index of (vec_id, v): a row of flat arrays for each shard and vector length.

    `ids` holds the ids of all nodes, those of node i before `id_ends[i]`; a vector's copies are alike and
    ties go to smaller ids, so the k + 1 smallest of them are enough for any query of up to k.
    """
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    firsts = rows.dropDuplicates().withColumn("copy", copy).where(F.col("copy") <= k + 1)
    vectors = materialize(firsts.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    n = vectors.count()
    shards = max(1, -(-n // (shard_rows or min(MOST_ROWS, max(SHARD_ROWS, n // 512)))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(pdf.v.map(len)):
            own = own.sort_values("first")
            ids = own.ids.to_list()
            ends = np.cumsum([len(x) for x in ids]).astype(np.int64)
            graph = Graph(np.stack(own.v.to_list()))
            out.append({"shard": own["shard"].iloc[0], "ids": np.concatenate(ids).astype(np.int64).tobytes(), "id_ends": ends.tobytes(), **graph.flat()})
        return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])

    first = F.col("ids")[0]
    dealt = vectors.select(F.pmod(F.xxhash64(first), F.lit(shards)).cast("int").alias("shard"), first.alias("first"), "ids", "v")
    index = dealt.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(build, INDEX)  # a task for each shard, small as its data may be
    index = materialize(index, "ann-index")
    release(vectors)
    return index


def index_table(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """The stored index of a table of vectors, for search_index."""
    return index_rows(usable(df, id_col, vector_col), k, shard_rows)


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH) -> DataFrame:
    """For queries (vec_id, v) the k nearest other ids of the index: query_id, rank, vec_id, score.

    Queries go through the shards in blocks of about QUERIES: a task holds one shard and one block.
    """
    queries = materialize(queries.dropDuplicates(), "ann-queries")
    shards, blocks = index.count(), max(1, -(-queries.count() // QUERIES))
    blocked = queries.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(blocked, "block")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            asked = [(r["vec_id"], r["v"]) for r in row.queries if len(r["v"]) == row.dim]
            if not asked:
                continue
            graph, ids, ends = Graph.stored(row), np.frombuffer(row.ids, np.int64), np.frombuffer(row.id_ends, np.int64)
            q = np.stack([v for _, v in asked])
            for (query, v), near in zip(asked, graph.search(q, k + 1, width), strict=True):
                near = near[near >= 0]
                score = np.sqrt(((graph.x[near].astype(np.float64) - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                best: dict[int, float] = {}
                for s, j in sorted(zip(score.tolist(), near.tolist(), strict=True)):
                    for i in ids[ends[j - 1] if j else 0 : ends[j]].tolist():
                        if i != query:
                            best.setdefault(i, s)
                out += [(query, i, s) for s, i in sorted((s, i) for i, s in best.items())[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = pairs.repartition(max(1, 4 * shards * blocks), "shard", "block").groupBy("shard", "block").applyInPandas(search, "query_id long, vec_id long, score double")
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, shard_rows: int | None = None, width: int = SEARCH_WIDTH) -> DataFrame:
    """The `k` nearest other rows of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = materialize(usable(df, id_col, vector_col), "ann-rows")
    return search_index(index_rows(rows, k, shard_rows), rows.where(F.col("vec_id") % every == 0), k, width)
