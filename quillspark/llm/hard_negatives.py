"""Hard negatives of anchors, by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster every candidate has an upper bound of its inner product with any anchor
of unit length in the cluster: its length times the cosine of its angle to the cluster's centre less the cluster's widest
angle. Candidates are sorted by that bound once; every anchor of the cluster walks the list from the top and stops when the
bound of all that is left, times its own length, is below what it still needs: the last of its places is better than that.

Two searches of this kind follow each other. The first finds an anchor's positives, the nearest rows of its label. Each
positive gives a range of scores, and the second finds the best rows of other labels within each range.

Rows are dealt to shards of like size by their row number, so no label, id or vector makes a shard large. An anchor visits
one shard first and then more and more in rounds (``GROWTH`` times as many each), taking along the scores that its places have
reached, so that most shards give it nothing: the rows that rounds bring together grow with the number of rounds, not of
shards. Every anchor meets every row of the table in blocks; none is left out.

Rows: a null id or label, a null vector, one with a null or non-finite component, one of another length than most, and one
whose squared length isn't below 2^62 (its scores don't fit a long) take no part. A repeated id is a candidate for each of
its rows, and never one of its own; of an anchor's repeated id the row of the least label and vector asks. Ties in score go
to the smaller id. Zero vectors take part, with scores of zero. Other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.scratch import stored

POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score in hundredths of its positive's.
LOW, HIGH = 50, 95
SHARD_ROWS = 16_384
#: Shards of a table too small for that many of ``SHARD_ROWS``, so that its work spreads; none under 1024 rows.
LEAST_SHARDS = 16
GROWTH = 16
#: Anchors of a cluster, clusters at most, and anchors whose directions give the clusters.
MEMBERS, MOST_CLUSTERS, SAMPLE = 128, 256, 4096
BLOCK = 512
_EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, whole-number vector) of the rows that take part; ``vector`` is an array of whole numbers or of fractions, which are cut."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31)) & (F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) < 2.0**62)
    kept = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))
    return kept.select(F.col(key).cast("long").alias(key), F.col(label).alias(label), F.transform(F.col(vector), lambda x: x.cast("long")).alias(vector))


def centres(sample: np.ndarray, clusters: int, rounds: int = 6) -> np.ndarray:
    """Unit directions of ``clusters`` groups of the sample, by spherical means from evenly drawn starts."""
    length = np.linalg.norm(sample, axis=1)
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    out = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
    for _ in range(rounds):
        own = (unit @ out.T).argmax(axis=1)
        total = np.zeros_like(out)
        np.add.at(total, own, unit)
        norm = np.linalg.norm(total, axis=1)
        out = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], out)
    return out


def angles(x: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Angles between rows and one unit direction (or one for each row); a row of zeros has an angle of zero."""
    length = np.linalg.norm(x, axis=1)
    along = np.einsum("ij,ij->i", x, np.broadcast_to(direction, x.shape))
    return np.arccos(np.clip(np.divide(along, length, out=np.ones(len(x)), where=length > 0), -1, 1))


class Shard:
    """Candidates of a shard, with the list of the cluster that was asked for last."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.real = x.astype(float)
        self.length = np.linalg.norm(self.real, axis=1)
        self.longest = float(self.length.max(initial=0))
        self.cluster = None

    def sort_for(self, cluster: int, centre: np.ndarray | None, widest: float) -> None:
        """The list of a cluster, made once: ``centre`` None bounds by length alone."""
        if self.cluster == cluster:
            return
        self.cluster = cluster
        gap = 0.0 if centre is None else np.maximum(angles(self.real, centre) - widest, 0)
        bound = self.length * np.cos(gap)
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]

    def scores(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if np.linalg.norm(u.astype(float), axis=1).max(initial=0) * self.longest < _EXACT:
            return (u.astype(float) @ self.real[at].T).astype(np.int64)
        return np.einsum("ik,jk->ij", u, self.x[at])

    def walk(self, own: np.ndarray, labels: np.ndarray, u: np.ndarray, high: np.ndarray, need: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(member, slot, score, id): for each member and slot the k best rows whose score lies between ``need`` and ``high``.

        ``need``: a score that a row must reach, given or reached by k rows elsewhere; a slot whose need is above its high asks for nothing.
        """
        members, slots = need.shape
        need = need.copy()
        length = np.linalg.norm(u.astype(float), axis=1)
        who, slot, score, found = (np.zeros(0, np.int64) for _ in range(4))
        for low in range(0, len(self.order), BLOCK):
            asks = need <= high
            least = np.where(asks, need, np.iinfo(np.int64).max).min(axis=1)
            reach = length * self.bound[low] * (1 + 1e-9) + 1e-6
            live = np.flatnonzero(asks.any(axis=1) & (reach >= least))
            if not len(live):
                break
            at = self.order[low : low + BLOCK]
            s = self.scores(at, u[live])
            fine = (s >= least[live, None]) & ((self.labels[at][None, :] == labels[live, None]) == same) & (self.ids[at][None, :] != own[live, None])
            i, j = np.nonzero(fine)
            if not len(i):
                continue
            s, ids = s[i, j], self.ids[at[j]]
            i = live[i]
            met = (s[:, None] >= need[i]) & (s[:, None] <= high[i])
            row, w = np.nonzero(met)
            who, slot = np.concatenate((who, i[row])), np.concatenate((slot, w))
            score, found = np.concatenate((score, s[row])), np.concatenate((found, ids[row]))
            order = np.lexsort((found, -score, slot, who))
            group = who[order] * slots + slot[order]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            order, group, place = order[place < k], group[place < k], place[place < k]
            who, slot, score, found = who[order], slot[order], score[order], found[order]
            full = place == k - 1
            flat = need.reshape(-1)
            flat[group[full]] = np.maximum(flat[group[full]], score[full])
            need = flat.reshape(members, slots)
        return who, slot, score, found


def _searched(shards: DataFrame, asked: DataFrame, n_shards: int, slots: int, k: int, same: bool, middle: np.ndarray, widest: dict[int, float]) -> DataFrame:
    """(anchor_id, slot, score, vec_id): for each anchor and slot the k best rows of all shards, in rounds.

    ``asked``: id, label, v, cluster, high and need (arrays over slots).
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, shard = None, [], None
        for pdf in batches:
            for (number, asks, cluster), some in pdf.groupby(["shard", "asks", "cluster"], sort=True):
                if held != number:
                    held, waiting, shard = number, [], None
                if not asks:
                    waiting.append((some["id"].to_numpy(), some["label"].to_numpy(), np.stack(some["v"].to_numpy())))
                elif waiting:
                    if shard is None:
                        shard = Shard(*(np.concatenate(x) for x in zip(*waiting)))
                    shard.sort_for(cluster, middle[cluster] if cluster >= 0 else None, widest.get(cluster, np.pi))
                    own = some["id"].to_numpy()
                    who, slot, score, found = shard.walk(own, some["label"].to_numpy(), np.stack(some["v"].to_numpy()), np.stack(some["high"].to_numpy()), np.stack(some["need"].to_numpy()), k, same)
                    yield pd.DataFrame({"anchor_id": own[who], "slot": slot.astype(np.int32), "score": score, "vec_id": found})

    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    nothing = F.array().cast("array<long>")
    left = shards.select("shard", F.lit(0).alias("asks"), F.lit(-2).alias("cluster"), "id", "label", "v", nothing.alias("high"), nothing.alias("need"))
    found, low, high = None, 0, 1
    while low < n_shards:
        now = asked
        if found is not None:  # the score of a full slot's last place is what further rows must reach
            reached = found.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
            raised = F.transform("need", lambda n, i: F.greatest(n, F.coalesce(F.col("reached")[i], n)))
            now = asked.join(reached, asked["id"] == F.col("anchor_id"), "left").withColumn("need", F.when(F.col("reached").isNull(), F.col("need")).otherwise(raised)).drop("anchor_id", "reached")
        visits = F.sequence(F.lit(low), F.lit(min(high, n_shards) - 1))
        right = now.withColumn("visit", F.explode(visits)).select(((F.pmod(F.xxhash64("id"), F.lit(n_shards)) + F.col("visit")) % n_shards).cast("int").alias("shard"), F.lit(1).alias("asks"), "cluster", "id", "label", "v", "high", "need")
        met = left.unionByName(right).repartition(n_shards, "shard").sortWithinPartitions("shard", "asks", "cluster")
        new = met.mapInPandas(search, "anchor_id long, slot int, score long, vec_id long")
        every = new if found is None else found.drop("rank").unionByName(new)
        found = stored(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        low, high = high, high * GROWTH + high
    return found


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its nearest rows of the same
    label the best rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.

    ``anchors``: which rows ask, by a condition on the key.
    """
    spark = rows.sparkSession
    every = usable(rows, key, vector, label).select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), anchors.alias("asks"))
    n, dims, n_anchors = every.agg(F.count("*"), F.mode(F.size("v")), F.count_if("asks")).first()
    every = every.where(F.size("v") == (dims or 0))
    each = min(shard_rows, max(1024, -(-n // LEAST_SHARDS)))
    n_shards = max(1, -(-n // each))
    numbered = every.withColumn("number", F.monotonically_increasing_id())
    shards = stored(numbered.select(F.pmod(F.xxhash64("number"), F.lit(n_shards)).cast("int").alias("shard"), "id", "label", "v"))

    one = every.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    share = int(min(1.0, SAMPLE / max(n_anchors, 1)) * (1 << 30))
    drawn = one.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share).select("v").collect()  # about SAMPLE rows
    middle = centres(np.array([r.v for r in drawn], float).reshape(len(drawn), dims or 0), min(MOST_CLUSTERS, max(1, -(-n_anchors // MEMBERS))))

    def clustered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                own = (x @ middle.T).argmax(axis=1) if len(middle) else np.zeros(len(x), int)
                zero = ~x.any(axis=1)
                wide = angles(x, middle[own]) if len(middle) else np.zeros(len(x))
                yield pdf.assign(cluster=np.where(zero, -1, own).astype(np.int32), angle=np.where(zero, 0.0, wide))

    dealt = stored(one.mapInPandas(clustered, "id long, label long, v array<long>, cluster int, angle double"))
    widest = {r.cluster: r.angle + 1e-7 for r in dealt.groupBy("cluster").agg(F.max("angle").alias("angle")).collect()}  # a row a cluster

    top, least = F.lit(np.iinfo(np.int64).max), F.lit(_NONE + 1)
    asked = dealt.select("id", "label", "v", "cluster", F.array(top).alias("high"), F.array(least).alias("need"))
    near = _searched(shards, asked, n_shards, 1, positives, True, middle, widest)
    places = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    hundredths = lambda part: F.col("positive_score").cast("decimal(20,0)") * F.lit(part).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    spans = places.withColumns({"least": F.ceil(hundredths(low)).cast("long"), "most": F.floor(hundredths(high)).cast("long")})
    listed = spans.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("least", "most")))).alias("span"))
    slots = F.sequence(F.lit(0), F.lit(positives - 1))
    none_low, none_high = F.lit(1).cast("long"), F.lit(0).cast("long")  # a slot that asks for nothing
    asked = dealt.join(listed, dealt["id"] == listed["anchor_id"]).select(
        "id", "label", "v", "cluster",
        F.transform(slots, lambda i: F.coalesce(F.col("span")[i]["most"], none_high)).alias("high"),
        F.transform(slots, lambda i: F.coalesce(F.col("span")[i]["least"], none_low)).alias("need"))
    hard = _searched(shards, asked, n_shards, positives, negatives, False, middle, widest)
    return places.join(hard.select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

