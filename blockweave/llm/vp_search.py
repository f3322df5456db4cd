"""Nearest neighbours by vantage-point trees, a tree for each shard of the vectors.

A bounded sample of the vectors are the shards' vantage points. Every vector belongs to the nearest one, and a shard's
radius is the distance of its farthest member. A query first asks the shard of its own nearest vantage point; the
distance of the k-th row found there bounds what it still looks for, and by the triangle inequality it goes on only to
shards whose radius reaches into that bound, the bound being divided by a factor of 1 or more. Inside a shard a tree
prunes likewise. Factor 1 is exact search, ties included; a larger one prunes more.

A shard with more vectors than a task should hold (equal vectors have one nearest vantage point) is split, and its
queries go to all of its parts; queries of one shard are dealt in parts as well, so no task holds an unbounded number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, table, written

#: Neighbours of a query; the pruning factor; vectors in a shard, about, and in a part of one, at most about; queries in a task; vectors in a leaf.
K, FACTOR, SHARD, PART, QUERIES, LEAF = 10, 1.0, 8_192, 32_768, 16_384, 128
#: Vantage points of the shards, at most.
POINTS = 4_096
#: Query ids are divisible by this.
EVERY = 100
#: What a bound allows for rounding.
SLACK = 1e-9
#: What products of vectors may be off by, against the sum of their squared lengths.
ROUNDED = 1e-9
#: Distances estimated at once; those computed at once.
AT_ONCE, IN_CACHE = 1 << 20, 1 << 15


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``a`` to each row of ``b``; components are added in their order, so equal pairs give equal distances wherever they stand."""
    out = np.zeros((len(a), len(b)))
    columns, rows = np.ascontiguousarray(b.T), np.ascontiguousarray(a.T)
    step = max(1, IN_CACHE // max(1, len(b)))
    gap = np.empty((min(step, len(a)), len(b)))
    for at in range(0, len(a), step):
        total = out[at : at + step]
        own = gap[: len(total)]
        for j in range(a.shape[1]):
            np.subtract(rows[j, at : at + step, None], columns[j], out=own)
            np.multiply(own, own, out=own)
            total += own
        np.sqrt(total, out=total)
    return out


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``a`` to the row of ``b`` beside it, equal to those of ``distances``."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        total += (x - y) ** 2
    return np.sqrt(total)


def squares(v: np.ndarray) -> np.ndarray:
    """The squared length of each row."""
    return np.einsum("ij,ij->i", v, v)


def vectors_of(column) -> np.ndarray:
    """The rows of an Arrow list column whose lists are equally long, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Tree:
    """A vantage-point tree over ascending ids and their vectors, double precision. Nodes are grown and visited from a stack."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.v = ids, vectors
        self.nodes: list = []  # a leaf's rows, or (vantage row, farthest inside, nearest outside, inner node, outer node)
        waiting = [(np.arange(len(ids)), 0, None)]
        while waiting:
            own, depth, above = waiting.pop()
            at = len(self.nodes)
            if above is not None:
                self.nodes[above[0]][above[1]] = at
            split = None if len(own) <= leaf else self._split(own, depth)
            if split is None:
                self.nodes.append(own)
                continue
            row, d, inside = split
            self.nodes.append([row, float(d[inside].max()), float(d[~inside].min()), None, None])
            waiting += [(own[inside], depth + 1, (at, 3)), (own[~inside], depth + 1, (at, 4))]

    def _split(self, own: np.ndarray, depth: int):
        """A vantage row, its distances and which rows are inside; None if no tried row tells them apart in useful parts."""
        for k in range(4):
            row = own[(depth * 2_654_435_761 + k * 40_503) % len(own)]
            d = distances(self.v[row : row + 1], self.v[own])[0]
            radius = float(np.median(d))
            for inside in (d <= radius, d < radius):
                if min(n := int(inside.sum()), len(own) - n) * 16 >= len(own):
                    return int(row), d, inside
        return None  # equal or equidistant vectors: a leaf, however large

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids and distances of the k nearest of each query but itself, by (distance, id), as far as they lie within
        each query's ``bound``; missing ones have distance inf."""
        best_d, best_i = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        bound = np.full(len(queries), np.inf) if bound is None else bound
        everyone, home = np.arange(len(queries)), np.full(len(queries), -1)
        # First each query goes down the nearer sides to one leaf, which bounds the search; then all go through the tree together.
        stack = [(0, everyone)] if len(queries) else []
        while stack:
            at, rows = stack.pop()
            if isinstance(node := self.nodes[at], np.ndarray):
                home[rows] = at
                self._leaves(node, rows, q_ids, queries, bound, best_d, best_i)
                continue
            to_inner, to_outer = self._sides(node, queries[rows])
            near = to_inner <= to_outer
            stack += [(to, rows[side]) for to, side in ((node[3], near), (node[4], ~near)) if side.any()]
        stack = [(0, everyone, np.zeros(len(queries)))] if len(queries) else []
        while stack:
            at, rows, least = stack.pop()
            reach = least * factor <= np.minimum(best_d[rows, -1], bound[rows]) * (1 + SLACK)
            rows, least = rows[reach], least[reach]
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                self._leaves(node, rows[home[rows] != at], q_ids, queries, bound, best_d, best_i)
            elif len(rows):
                to_inner, to_outer = self._sides(node, queries[rows])
                stack += [(node[4], rows, np.maximum(least, to_outer)), (node[3], rows, np.maximum(least, to_inner))]
        return best_i, best_d

    def _sides(self, node: list, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least distances of queries to a node's inner and outer rows by the triangle inequality, less what rounding may add."""
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows rules nothing out
            d = np.sqrt(squares(queries - self.v[node[0]]))
            return np.fmax(d - node[1] - (d + node[1]) * ROUNDED, 0), np.fmax(node[2] - d - (d + node[2]) * ROUNDED, 0)

    def _leaves(self, node: np.ndarray, rows: np.ndarray, *more) -> None:
        """Hold queries against a leaf's vectors, some at a time."""
        step = max(1, AT_ONCE // len(node))
        for low in range(0, len(rows), step):
            self._leaf(node, rows[low : low + step], *more)

    def _leaf(self, node: np.ndarray, rows: np.ndarray, q_ids, queries, bound, best_d, best_i) -> None:
        """Hold queries against a leaf's vectors: products tell which can be among the k best, those are measured."""
        k, own, v = best_d.shape[1], queries[rows], self.v[node]
        with np.errstate(over="ignore", invalid="ignore"):
            length = squares(own)[:, None] + squares(v)
            about = length - 2 * (own @ v.T)
            slack = length * ROUNDED
            most = np.minimum(best_d[rows, -1], bound[rows]) ** 2
            if len(node) > k:  # one more, for the query's own row
                most = np.fmin(most, np.partition(about + slack, k, axis=1)[:, k])
            # What overflows isn't ruled out.
            near = ~(about - slack > (most * (1 + ROUNDED))[:, None]) & (self.ids[node] != q_ids[rows, None])
        at, to = np.nonzero(near)
        if not len(at):
            return
        d = pair_distances(own[at], v[to])
        met, at = np.unique(at, return_inverse=True)
        held = rows[met]
        at = np.concatenate([np.repeat(np.arange(len(met)), k), at])
        d, ids = np.concatenate([best_d[held].ravel(), d]), np.concatenate([best_i[held].ravel(), self.ids[node][to]])
        order = np.lexsort((ids, d, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(len(met)))[at]
        best = place < k
        best_d[held[at[best]], place[best]], best_i[held[at[best]], place[best]] = d[order][best], ids[order][best]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (floats as they are, all else as doubles), dim: rows with an id and a vector that isn't null, zero, or of null or non-finite components."""
    v, kind = F.col("v"), dict(rows.dtypes)[vector_col]
    kind = kind if kind == "array<float>" else "array<double>"  # half as many bytes to move, and the same numbers
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
        .filter(F.exists(v, lambda x: x != 0))
        .withColumn("dim", F.size("v"))
    )


def _nearest(points: dict[int, np.ndarray]):
    """An Arrow function: rows (vec_id, v, dim) with shard, the nearest of the points of their length, and gap, its distance."""

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b if (dims == dim).all() else b.filter(pa.array(dims == dim))
                p, v = points[dim], vectors_of(own.column(1))
                with np.errstate(over="ignore", invalid="ignore"):
                    shard = np.concatenate([(squares(p) - 2 * (v[low : low + 1024] @ p.T)).argmin(1) for low in range(0, len(v), 1024)])
                # The nearest point may be another by what products are off; its distance is this one's in any case.
                new = [pa.array(shard.astype(np.int64)), pa.array(pair_distances(v, p[shard]))]
                yield pa.RecordBatch.from_arrays([*own.columns, *new], names=["vec_id", "v", "dim", "shard", "gap"])

    return run


def _asked(data: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, factor: float, queries: int) -> DataFrame:
    """query_id, vec_id, score: the k best rows of each part of a shard for each query (query_id, q, bound, dim, shard) sent to it."""
    n = asked.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("lots"))
    share = F.broadcast(sizes.join(n, ["dim", "shard"]).select("dim", "shard", "parts", "lots"))  # a row for each shard
    mine = data.join(share, ["dim", "shard"]).select("dim", "shard", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "vec_id", "v")
    theirs = asked.join(share, ["dim", "shard"]).select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int").alias("lot"), "query_id", "q", "bound")

    def local(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(mine) or not len(theirs):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        own, ids = mine["vec_id"].to_numpy(), theirs["query_id"].to_numpy()
        order = np.argsort(own)
        tree = Tree(own[order], vectors_of(mine["v"])[order])
        i, d = tree.search(ids, vectors_of(theirs["q"]), k, factor, theirs["bound"].to_numpy())
        found = np.isfinite(d)
        return pa.table([pa.array(np.repeat(ids, found.sum(1))), pa.array(i[found]), pa.array(d[found])], names=names)

    mine, theirs = mine.toDF("d", "s", "p", "l", "vec_id", "v"), theirs.toDF("dim", "shard", "part", "lot", "query_id", "q", "bound")
    # A fixed number of partitions: searching few bytes takes long, so they mustn't be put together.
    n = max(2 * data.sparkSession.sparkContext.defaultParallelism, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mine, theirs = mine.repartition(n, "d", "s", "p", "l"), theirs.repartition(n, "dim", "shard", "part", "lot")
    return mine.groupBy("d", "s", "p", "l").cogroup(theirs.groupBy("dim", "shard", "part", "lot")).applyInArrow(local, "query_id long, vec_id long, score double")


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, factor: float = FACTOR, shard: int = SHARD, part: int = PART, queries: int = QUERIES) -> DataFrame:
    """For each query (a row whose id is divisible by ``every``): query_id, rank, vec_id, score of its k nearest rows.

    - A row without an id, or whose vector is null, zero or holds null, NaN or infinite components, takes no part.
    - Only vectors of equal length are near each other. A query with fewer than k candidates gets all of them.
    - Candidates are the rows with another id than the query's; of rows that repeat an id, with whatever vectors, one is
      used. Ties go to the smaller id. An empty table gives no rows. Other columns are not read.
    """
    good = written(usable(rows, id_col, vector_col))
    kind = dict(good.dtypes)["v"]
    twice = written(good.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if not twice.isEmpty():  # only rows whose id another has are dealt out for it
        twice = sized(twice)
        good = written(good.join(twice, "vec_id", "left_anti").unionByName(good.join(twice, "vec_id", "left_semi").dropDuplicates(["vec_id"])))
    points: dict[int, np.ndarray] = {}
    for dim, n in sorted((r["dim"], r["n"]) for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        most = min(POINTS, -(-n // shard))
        chosen = good.filter(F.col("dim") == dim).orderBy(F.xxhash64(F.lit("point"), "vec_id"), "vec_id").limit(most).collect()
        points[dim] = np.unique(np.array([r["v"] for r in chosen], np.float64), axis=0)
    if not points:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    data = written(good.mapInArrow(_nearest(points), f"vec_id long, v {kind}, dim int, shard long, gap double"))
    sizes = written(data.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"), F.max("gap").alias("radius")))
    own = data.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("inf")).alias("bound"), "dim", "shard")
    near = written(_asked(data, own, sizes, k, factor, queries))
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).otherwise(float("inf")).alias("kth"))
    radius = {(r["dim"], r["shard"]): r["radius"] for r in sizes.collect()}  # at most POINTS rows for each length of vectors

    def beyond(batches):
        """The other shards that each query must ask, with its bound."""
        for pdf in batches:
            for dim, group in pdf.groupby("dim"):
                p = points[int(dim)]
                r = np.array([radius.get((int(dim), x), -np.inf) for x in range(len(p))])
                for low in range(0, len(group), 1024):
                    some = group.iloc[low : low + 1024]
                    gap = distances(np.stack(some["q"].to_numpy()).astype(np.float64), p) - r
                    bound = some["kth"].fillna(np.inf).to_numpy()
                    reach = (gap * factor <= bound[:, None] * (1 + SLACK) + SLACK) & (np.arange(len(p)) != some["shard"].to_numpy()[:, None])
                    at, to = np.nonzero(reach)
                    yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[at], "q": some["q"].to_numpy()[at], "bound": bound[at], "dim": int(dim), "shard": to})

    more = written(own.drop("bound").join(kth, "query_id", "left").mapInPandas(beyond, f"query_id long, q {kind}, bound double, dim int, shard long"))
    found = near if more.isEmpty() else near.union(_asked(data, more, sizes, k, factor, queries))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of ``embeddings`` for every hundredth one."""
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
