"""Nearest neighbours by inner product, with a vantage-point tree per shard.

Vectors become points of a metric space in which the nearest point has the
largest inner product: each gets one more coordinate, the root of what its
squared length lacks to the largest squared length; queries get a zero there.
The upper levels of one tree, built from a bounded sample, deal every row to one
shard; a shard far larger than asked (equal or crowded vectors) is dealt on by
row numbers. A query goes to the shards whose ball its bound reaches, with the
bound that the sample gives it. A shard's task builds the shard's own tree once
and streams the queries through it, so it holds the shard's rows only. A ball is
skipped when the triangle inequality, its gap multiplied by ``factor``, says that
nothing in it comes nearer than the k found so far; factor 1 is exact, a larger
one skips more. Per query at most k rows a shard are merged into the answer.

Scores are summed in double precision over the dimensions in order, so equal
vectors have equal scores and ties go to the smaller id.

Rows: vectors that are null, empty, zero, of another length than most of the
sample, or that hold a null or non-finite component take no part, as do null
ids. Repeated ids keep their rows; a query skips all rows of its own id. Queries
of one id share one answer's places, so ids of queries should differ. Other
columns are never read; with no rows there are no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
#: Rows whose distances give each query its first bound.
SAMPLE = 2048
SHARD_ROWS = 4096
#: Shards of a table too small for that many of ``SHARD_ROWS``, so that its work spreads; none under 256 rows.
LEAST_SHARDS = 16
#: Shards that the sample's tree makes; further ones by row numbers.
MOST_SHARDS = 256
LEAF = 128
FACTOR = 1.0
_STRIDE = 1 << 22


def paired(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, each summed over the dimensions in order."""
    out = np.zeros(len(queries))
    for q, r in zip(queries.T, rows.T):
        out += q * r
    return out


class Tree:
    """A vantage-point tree over one shard; points are rows of ``points`` with the added coordinate."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: float):
        self.ids, self.rows = ids, rows
        self.points = np.column_stack((rows, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", rows, rows), 0))))
        self.root = self._build(np.argsort(ids, kind="stable"))

    def _build(self, at: np.ndarray):
        """(vantage, radius, near, far, bounds of both) or the places of a leaf."""
        if len(at) <= LEAF:
            return at
        centre = self.points[at].mean(axis=0)
        vantage = self.points[at[np.linalg.norm(self.points[at] - centre, axis=1).argmax()]]
        d = np.linalg.norm(self.points[at] - vantage, axis=1)
        radius = float(np.median(d))
        near = d <= radius
        if near.all():
            near = d < radius
            if not near.any():  # all at one distance: repeated rows
                return at
        return vantage, (d[near].min(), d[near].max()), (d[~near].min(), d[~near].max()), self._build(at[near]), self._build(at[~near])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows found for each query, best first; unused places hold -inf.

        ``worst``: a score that k rows are known to reach (-inf: none are).
        """
        n = len(queries)
        self.score, self.found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.worst, self.k, self.factor = worst.copy(), k, factor
        self.query_ids, self.queries = query_ids, queries
        self.wide = np.column_stack((queries, np.zeros(n)))
        self.base = np.einsum("ij,ij->i", queries, queries)
        self.top = float(np.einsum("ij,ij->i", self.points, self.points).max(initial=0))
        self.slack = 1e-9 * max(1.0, self.top, float(self.base.max(initial=0)))
        self._visit(self.root, np.arange(n))
        return self.score, self.found

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """The distance that a row must come within to matter; slightly enlarged for rounding."""
        squared = np.maximum(self.base[who] + self.top - 2 * self.worst[who], 0)
        return np.sqrt(squared) * (1 + 1e-9) + 1e-9

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            step = max(1, _STRIDE // max(len(who), 1))
            for low in range(0, len(node), step):
                self._leaf(node[low : low + step], who)
            return
        vantage, near_span, far_span, near, far = node
        d = np.sqrt(np.maximum(self.base[who] + vantage @ vantage - 2 * (self.wide[who] @ vantage), 0))
        gap = [np.maximum(np.maximum(span[0] - d, d - span[1]), 0) * self.factor for span in (near_span, far_span)]
        first_near = gap[0] <= gap[1]
        for child, mine, away in ((near, first_near, gap[0]), (far, ~first_near, gap[1]), (far, first_near, gap[1]), (near, ~first_near, gap[0])):
            some = who[mine]
            self._visit(child, some[away[mine] <= self._reach(some)])

    def _leaf(self, at: np.ndarray, who: np.ndarray) -> None:
        k = self.k
        rough = self.queries[who] @ self.rows[at].T  # rounded otherwise than the scores: only sifts
        i, j = np.nonzero((rough >= self.worst[who][:, None] - self.slack) & (self.ids[at][None, :] != self.query_ids[who][:, None]))
        if not len(i):
            return
        exact = paired(self.queries[who[i]], self.rows[at[j]])
        fine = exact >= self.worst[who[i]]
        i, j, exact = i[fine], j[fine], exact[fine]
        touched, i = np.unique(i, return_inverse=True)
        new = np.full((len(touched), len(at)), -np.inf)
        new[i, j] = exact
        rows = who[touched]
        score = np.concatenate((self.score[rows], new), axis=1)
        found = np.concatenate((self.found[rows], np.broadcast_to(self.ids[at], new.shape)), axis=1)
        order = np.lexsort((found, -score))[:, :k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.found[rows] = np.take_along_axis(found, order, 1)
        self.worst[rows] = np.maximum(self.worst[rows], self.score[rows, -1])


class Part:
    """A split of the upper tree: vantage point, radius, both sides; a leaf has only its number."""

    __slots__ = ("leaf", "vantage", "radius", "near", "far")

    def __init__(self):
        self.leaf, self.vantage, self.radius, self.near, self.far = 0, None, 0.0, None, None


def upper_tree(points: np.ndarray, leaves: int) -> Part:
    """About ``leaves`` parts of like numbers of sample points; the largest is split first. Points that stand in one place stay together."""
    root = Part()
    parts, done = [(root, points)], []
    while parts and len(parts) + len(done) < leaves:
        parts.sort(key=lambda p: len(p[1]))
        part, some = parts.pop()
        far = np.linalg.norm(some - some.mean(axis=0), axis=1).argmax() if len(some) >= 8 else 0
        d = np.linalg.norm(some - some[far], axis=1) if len(some) else np.zeros(0)
        radius = float(np.median(d)) if len(d) else 0.0
        near = d <= radius
        if near.all() or len(some) < 8:
            near = d < radius
            radius = float(d[near].max()) if near.any() else radius
        if not near.any() or near.all() or len(some) < 8:
            done.append((part, some))
            continue
        part.vantage, part.radius, part.near, part.far = some[far], radius, Part(), Part()
        parts += [(part.near, some[near]), (part.far, some[~near])]
    for i, (part, _) in enumerate(parts + done):
        part.leaf = i
    return root


def reached(root: Part, points: np.ndarray, reach: np.ndarray | None, factor: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places in ``points``): the one leaf of each point, or all whose balls lie within its ``reach``."""
    stack = [(root, np.arange(len(points)))]
    while stack:
        part, who = stack.pop()
        if not len(who):
            continue
        if part.vantage is None:
            yield part.leaf, who
            continue
        d = np.linalg.norm(points[who] - part.vantage, axis=1)
        if reach is None:
            near, far = d <= part.radius, d > part.radius
        else:  # a little wider, for rounding
            limit = reach[who] * (1 + 1e-9) + 1e-9
            near, far = (d - part.radius) * factor <= limit, (part.radius - d) * factor <= limit
        stack += [(part.near, who[near]), (part.far, who[far])]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), v.alias(vector)).where(F.coalesce(fine, F.lit(False)))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", factor: float = FACTOR, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, key, score): for each query its k rows of largest inner product, its own id's rows left out."""
    rows, queries = usable(rows, key, vector), usable(queries, key, vector)
    total, top, dims = rows.agg(F.count("*"), F.max(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)), F.mode(F.size(vector))).first()
    top, dims = top or 0.0, dims or 0
    rows, queries = rows.where(F.size(vector) == dims), queries.where(F.size(vector) == dims)
    share = int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < share).groupBy(key).agg(F.first(vector).alias(vector)).collect()  # about sample_rows, one of each id
    sample_ids = np.array([r[key] for r in drawn], np.int64)
    sample = np.array([r[vector] for r in drawn], float).reshape(len(drawn), dims)

    def placed(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))))

    each = min(shard_rows, max(256, -(-total // LEAST_SHARDS)))
    tree = upper_tree(placed(sample), min(MOST_SHARDS, max(1, -(-total // each))))

    def deal_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                for leaf, at in reached(tree, placed(np.stack(pdf[vector].to_numpy())), None, factor):
                    yield pdf.iloc[at].assign(leaf=np.int32(leaf))

    def deal_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), 1024):
                some = pdf.iloc[low : low + 1024]
                x = np.stack(some[vector].to_numpy())
                score = x @ sample.T
                score[some[key].to_numpy()[:, None] == sample_ids] = -np.inf
                bound = np.full(len(x), -np.inf)
                if score.shape[1] >= k:
                    bound = np.partition(score, -k, axis=1)[:, -k] - 1e-9 * max(1.0, top)  # rounding
                reach = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) + top - 2 * bound, 0))
                for leaf, at in reached(tree, np.column_stack((x, np.zeros(len(x)))), reach, factor):
                    yield some.iloc[at].assign(bound=bound[at], leaf=np.int32(leaf))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, points, made = None, [], [], None
        for pdf in batches:
            for (leaf, part, asks), some in pdf.groupby(["leaf", "part", "asks"], sort=True):
                if held != (leaf, part):
                    held, ids, points, made = (leaf, part), [], [], None
                if not asks:
                    ids.append(some[key].to_numpy())
                    points.append(np.stack(some[vector].to_numpy()))
                elif ids:
                    made = made or Tree(np.concatenate(ids), np.concatenate(points), top)
                    who = some[key].to_numpy()
                    score, found = made.search(who, np.stack(some[vector].to_numpy()), some["bound"].to_numpy(float), k, factor)
                    q, place = np.nonzero(score > -np.inf)
                    yield pd.DataFrame({"query_id": who[q], key: found[q, place], "score": score[q, place]})

    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    homes = numbered.mapInPandas(deal_rows, f"{key} long, {vector} array<double>, number long, leaf int")
    large = {r.leaf: -(-r.n // each) for r in homes.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * each).collect()}  # at most MOST_SHARDS rows
    parts = F.coalesce(F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("leaf")], F.lit(1)) if large else F.lit(1)
    left = homes.select("leaf", F.pmod(F.xxhash64("number"), parts).cast("int").alias("part"), F.lit(0).alias("asks"), key, vector, F.lit(0.0).alias("bound"))
    asked = queries.mapInPandas(deal_queries, f"{key} long, {vector} array<double>, bound double, leaf int")
    right = asked.select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("asks"), key, vector, "bound")
    met = left.unionByName(right).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks")
    found = met.mapInPandas(search, f"query_id long, {key} long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
