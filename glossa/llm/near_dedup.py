"""Near-duplicate documents by SetSketch registers.

A document's set of 5-word shingles is sketched in `M` registers: each is the least of the set's
exponential variates for that register, on an exponentially spaced scale of base `B`. Bands of `ROWS`
registers give candidates, a joint likelihood of the register order estimates their similarity, and
those not clearly under the threshold are confirmed on full sets.

Large groups never become all pairs, and no group is gathered in one task: joins deal the rows of a
frequent set, bucket, leader, neighbour or component over parts. Equal sets are one vertex. In each band bucket the smallest vertex
leads and only (leader, member) pairs are confirmed; links are joined to components; then buckets that
still hold several components are compared by registers in tiles of bounded size, and components that
may be linked are held against each other on full sets, again in tiles. Tiles emit a spanning forest,
never all pairs. So every pair of linked texts that shares a band ends in one component (a pair at the
threshold misses all 32 bands with a chance of 5e-6).

Nulls and odd inputs: null, empty and blank texts have no shingles and no links, each is its own
component; rows that repeat an id are one vertex; rows with a null id are never linked and keep a null
component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import materialize, release, spread_join
from glossa.llm.words import mix, shingle_sets, text_batches

M, ROWS, B, RATE = 128, 4, 1.001, 20.0
BANDS = M // ROWS
TILE, TEXTS = 1024, 256
#: Estimates this far under the threshold are not confirmed: six standard errors of 128 registers at 0.75.
MARGIN = 0.23
_rng = np.random.default_rng(77)
_LOW = _rng.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _rng.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TOP = (1 << 16) - 2


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of 64-bit hashes; merged sets take the larger of each register."""
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (low[i : i + 1024, None] * _LOW + high[i : i + 1024, None] * _HIGH).min(axis=0))
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(B)), 0, _TOP).astype(np.uint16)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of sizes na, nb from rows of registers."""
    return estimate_from_counts((a > b).sum(axis=1), (a < b).sum(axis=1), na, nb)


def estimate_from_counts(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The maximum of the joint likelihood over a grid of similarities; the two sizes are known exactly."""
    u, v = na / (na + nb), nb / (na + nb)
    best, found = np.full(len(u), -np.inf), np.zeros(len(u))
    highest = np.minimum(u, v) / np.maximum(u, v)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    for step in np.linspace(0, 1, 81):
        j = highest * step
        up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        like = more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.maximum(1 - up - down, 1e-9))
        found = np.where(like > best, j, found)
        best = np.maximum(best, like)
    return found


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, regs): set size, 128-bit fingerprint of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1):
            sets = shingle_sets(texts)
            f1 = [int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            f2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            regs = [registers(s).astype(">u2").tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "regs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, regs binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u2").reshape(len(column), M)


def _likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series(joint_estimate(_matrix(a), _matrix(b), na.to_numpy(float), nb.to_numpy(float)) if len(a) else [], dtype=float)


def _sizes_fit(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _row_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs that sizes and registers don't rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = spread_join(pairs, side("a"), ["a"], _row_counts(pairs, "a"), "b").join(side("b"), "b").where(_sizes_fit(percent))
    likely = F.pandas_udf(_likely, "double")
    return both.where(likely("regs_a", "regs_b", "n_a", "n_b") >= percent / 100 - MARGIN).select("a", "b")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs whose full shingle sets reach the threshold; texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            held: dict[int, np.ndarray] = {}
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if len(held) > 256:
                    held.clear()
                for k, t in ((a[i], ta[i]), (b[i], tb[i])):
                    if k not in held:
                        held[k] = shingle_sets([(t or "").encode()])[0]
                x, y = held[a[i]], held[b[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    joined = spread_join(pairs.join(side("b"), "b"), side("a"), ["a"], _row_counts(pairs, "a"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): the smallest vertex that each vertex reaches.

    Every round a vertex takes the least label of its neighbours and then that label's own label, so
    chains shorten by doubling; rounds are written out, and end when no label changes.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "dedup-edges")
    degrees = materialize(_row_counts(edges, "b"), "dedup-degrees")
    held = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "dedup-labels")
    labels, n_edges, n_nodes = held, edges.count(), held.count()
    while True:
        told = spread_join(edges, labels.select(F.col("node").alias("b"), "label"), ["b"], degrees, "a", total=n_edges)
        seen = told.select(F.col("a").alias("node"), "label").union(labels)
        low = materialize(seen.groupBy("node").agg(F.min("label").alias("low")), "dedup-low")
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("__next"))
        moved = spread_join(low, hop, ["low"], _row_counts(low, "low"), "node", total=n_nodes).select("node", F.least("low", "__next").alias("label"))
        old = labels.select("node", F.col("label").alias("__old"))
        moved = materialize(moved.join(old, "node"), "dedup-labels")
        release(low, held)
        labels, held = moved.select("node", "label"), moved
        if not moved.where(F.col("label") != F.col("__old")).limit(1).count():
            release(edges, degrees)
            return labels


class Groups:
    """Union-find over the distinct values of an array, kept as one group number per position."""

    def __init__(self, labels: np.ndarray) -> None:
        self.at = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, js: np.ndarray) -> list[int]:
        """Join i's group with those of js; one j for each group that was another."""
        others, first = np.unique(self.at[js], return_index=True)
        new = [int(js[f]) for g, f in zip(others, first, strict=True) if g != self.at[i]]
        self.at[np.isin(self.at, others)] = self.at[i]
        return new


def _deal(n: Column) -> Column:
    """The one of n parts that a vertex belongs to."""
    return F.pmod(F.xxhash64("node"), n).cast("int")


def _each(n: Column) -> Column:
    """A row for each of n parts."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def bridge_tiles(shared: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, row, column, is_row, label, n_shingles, regs): the rows that bridge_labels holds against each other.

    A bucket's leader has been confirmed with all its members, so it takes no part. In each bucket every
    member outside its largest component is held against all members, TILE by TILE at a time: a bucket
    whose members are nearly all linked already costs rows in proportion to its size.
    """
    members = shared.where("node != leader").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = materialize(members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")), "dedup-held")
    mixed = held.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("main_size"), F.sum("n").alias("size"))
    mixed = materialize(mixed.where("size > main_size").select("key", "main", "size", (F.col("size") - F.col("main_size")).alias("minor_size")), "dedup-mixed")
    full = spread_join(members, mixed, ["key"], mixed.select("key", F.col("size").alias("__n")), "node").join(nodes, "node")
    rows, columns = F.ceil(F.col("minor_size") / TILE).cast("int"), F.ceil(F.col("size") / TILE).cast("int")
    at = lambda row, column, is_row: F.struct(row.alias("row"), column.alias("column"), F.lit(is_row).alias("is_row"))
    as_row = F.transform(F.sequence(F.lit(0), columns - 1), lambda x: at(_deal(rows), x, True))
    as_column = F.transform(F.sequence(F.lit(0), rows - 1), lambda x: at(x, _deal(columns), False))
    places = F.when(F.col("label") != F.col("main"), F.concat(as_row, as_column)).otherwise(as_column)
    return full.withColumn("place", F.explode(places)).select("key", "place.*", "label", "n_shingles", "regs")


def bridge_labels(shared: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of different components that some bucket's registers may link, as a spanning forest for each tile."""
    tiles = bridge_tiles(shared, labels, nodes)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        is_row, label = pdf.is_row.to_numpy(bool), pdf.label.to_numpy()
        regs, size = _matrix(pdf.regs), pdf.n_shingles.to_numpy(float)
        groups, found = Groups(label), []
        columns = np.flatnonzero(~is_row)
        for i in np.flatnonzero(is_row):
            js = columns[(groups.at[columns] != groups.at[i]) & (100 * np.minimum(size[columns], size[i]) >= percent * np.maximum(size[columns], size[i]))]
            if len(js):
                js = js[(regs[i] == regs[js]).sum(axis=1) >= (percent / 100 - MARGIN) * M]  # fewer are as unlikely as an estimate that low
            if len(js):
                more, less = (regs[i] > regs[js]).sum(axis=1), (regs[i] < regs[js]).sum(axis=1)
                likely = estimate_from_counts(more, less, np.full(len(js), size[i]), size[js]) >= percent / 100 - MARGIN
                found += [(label[i], label[j]) for j in groups.join(i, js[likely])]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    spread = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(spread, "key", "row", "column").groupBy("key", "row", "column").applyInPandas(tile, "a long, b long").distinct()


def exact_bridges(bridges: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links between components that bridges put together, as a spanning forest for each tile.

    In each cluster of components every vertex outside the largest one is held against all vertices on
    full sets, TEXTS by TEXTS at a time; at most one link for each pair of components leaves a tile.
    """
    clusters = components(bridges).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    named = nodes.select("node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "dedup-named")
    held = materialize(_row_counts(named, "label"), "dedup-sizes")
    sizes = held.join(clusters, "label").withColumnRenamed("__n", "n")
    largest = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"))
    minors = sizes.join(largest, "cluster").where("label != main").groupBy("cluster").agg(F.sum("n").alias("minor_size"))
    about = sizes.drop("n").join(largest, "cluster").join(minors, "cluster").withColumn("minor", F.col("label") != F.col("main"))
    named = spread_join(named, about, ["label"], held, "node")
    full = materialize(named.join(texts, "node"), "dedup-named-texts")
    rows, columns = F.ceil(F.col("minor_size") / TEXTS).cast("int"), F.ceil(F.col("size") / TEXTS).cast("int")
    left = full.where("minor").withColumn("row", _deal(rows)).withColumn("column", _each(columns)).withColumn("is_row", F.lit(True))
    right = full.withColumn("column", _deal(columns)).withColumn("row", _each(rows)).withColumn("is_row", F.lit(False))
    tiles = left.unionByName(right).select("cluster", "row", "column", "is_row", "node", "label", "text")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        is_row, node = pdf.is_row.to_numpy(bool), pdf.node.to_numpy()
        groups, found = Groups(pdf.label.to_numpy()), []
        columns = np.flatnonzero(~is_row)
        if len(columns) and is_row.any():
            sets = shingle_sets([(t or "").encode() for t in pdf.text])
            sizes = np.array([len(s) for s in sets])
            columns = columns[sizes[columns] > 0]
            pool = np.concatenate([sets[j] for j in columns]) if len(columns) else np.empty(0, np.uint64)
            universe, at = np.unique(pool, return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes[columns])[:-1]]) if len(columns) else []
            mark = np.zeros(len(universe), np.int32)
            for i in np.flatnonzero(is_row):
                if not len(columns) or not (groups.at[columns] != groups.at[i]).any():
                    continue
                hits = np.minimum(np.searchsorted(universe, sets[i]), len(universe) - 1)
                hits = hits[universe[hits] == sets[i]]
                mark[hits] = 1
                both = np.add.reduceat(mark[at], starts)
                mark[hits] = 0
                linked = 100 * both >= percent * (sizes[i] + sizes[columns] - both)
                js = columns[linked & (groups.at[columns] != groups.at[i])]
                found += [(min(node[i], node[j]), max(node[i], node[j])) for j in groups.join(i, js)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    spread = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(spread, "cluster", "row", "column").groupBy("cluster", "row", "column").applyInPandas(tile, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    sketched = materialize(sketch(docs, id_col, text_col), "dedup-sketch")
    able = sketched.where("n_shingles > 0 and doc_id is not null")
    firsts = materialize(able.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("__n")), "dedup-firsts")
    members = spread_join(able, firsts.drop("__n"), ["f1", "f2"], firsts.drop("rep"), "doc_id")
    members = materialize(members.select("doc_id", "rep", "f1", "f2", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("regs")).alias("regs")), "dedup-members")
    nodes = members.where("doc_id = rep").dropDuplicates(["f1", "f2"]).select(F.col("rep").alias("node"), "n_shingles", "regs")
    nodes = materialize(nodes, "dedup-nodes")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(regs, {i * width + 1}, {width})")) for i in range(BANDS)])
    keyed = nodes.select("node", F.explode(keys).alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"), "dedup-buckets")
    shared = spread_join(keyed, buckets.drop("size"), ["key"], buckets.select("key", F.col("size").alias("__n")), "node")
    shared = materialize(shared.select("key", "node", "leader"), "dedup-shared")
    star = materialize(shared.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "dedup-star")
    pairs = materialize(likely_pairs(star, nodes, percent), "dedup-pairs")
    rows = members.select("doc_id", "rep").distinct()
    same_id = rows.join(rows.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a < rep").select("a", F.col("rep").alias("b"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(shared.select("node").distinct(), "node", "left_semi")
    texts = materialize(texts, "dedup-texts")
    links = materialize(confirm(pairs, texts, percent).union(same_id), "dedup-links")
    labels = components(links)
    bridges = materialize(bridge_labels(shared, labels, nodes, percent), "dedup-bridges")
    if bridges.limit(1).count():
        joined = materialize(links.union(exact_bridges(bridges, labels, nodes, texts, percent)), "dedup-links")
        labels = components(joined)
        release(joined)
    release(firsts, nodes, buckets, shared, star, pairs, texts, links, bridges)
    known = members.select("doc_id", F.col("rep").alias("node")).distinct()
    known = spread_join(known, labels, ["node"], _row_counts(members.select(F.col("rep").alias("node")), "node"), "doc_id", "left")
    known = known.groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("__component"))
    out = sketched.select("doc_id", "n_shingles").join(known, "doc_id", "left")
    component = F.coalesce("__component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of `docs`, all their columns, that come first in their group; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col("doc_id").alias("__glossa_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__glossa_gone"), "left_anti").select(*docs.columns)
