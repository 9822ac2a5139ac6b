"""Vector operators: cosine matching against small registries, leader clustering, vector moves and consistency."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, floor: float = 1e-8) -> Column:
    norm = F.greatest(F.lit(floor), F.sqrt(dot(v, v)))
    return F.transform(v, lambda x: x.cast("double") / norm)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key the sum, the number and the normalised mean of its vectors."""
    long = df.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    out = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_n").alias("n"))
    total = F.transform("_v", lambda e: e["_s"])
    return out.select(key, total.alias("total"), "n", normalized(total).alias("centroid"))


#: Owners of a registry that are broadcast at once; larger registries come block by block.
OWNERS = 10_000


def blocks(registry: DataFrame, owner: str, centroid: str, most: int) -> list[DataFrame]:
    """The registry (columns _owner, _c) in parts of about `most` owners by hash, each to be broadcast; one part if it is no larger."""
    r = registry.select(F.col(owner).alias("_owner"), F.col(centroid).alias("_c"))
    parts = -(-r.count() // most) or 1
    if parts == 1:
        return [r]
    return [r.filter(F.pmod(F.xxhash64("_owner"), F.lit(parts)) == i) for i in range(parts)]


def match(df: DataFrame, key: str, vector: str, registry: DataFrame, owner: str, centroid: str, high: float, low: float, margin: float, most: int = OWNERS) -> DataFrame:
    """Best and second owner of each vector by cosine, and a decision.

    matched: at least `high` and `margin` above the second; suggested: at least
    `low`; else new.  Vectors stay where they are; each block of the registry
    comes to them, and the best two of every block meet at the end.
    """
    unit = df.select(key, normalized(F.col(vector)).alias("_u"))
    nearest, near = Window.partitionBy(key).orderBy(F.desc("sim"), "_owner"), None
    for part in blocks(registry, owner, centroid, most):
        pairs = unit.join(F.broadcast(part), F.size("_u") == F.size("_c")).select(key, "_owner", F.round(dot(F.col("_u"), F.col("_c")), 9).alias("sim"))
        pairs = pairs.withColumn("_r", F.row_number().over(nearest)).filter("_r <= 2").drop("_r")
        near = pairs if near is None else near.unionByName(pairs)
    ranked = near.withColumn("_r", F.row_number().over(nearest)).filter("_r <= 2")
    best = ranked.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col("_owner"))).alias("owner"), F.max(F.when(F.col("_r") == 1, F.col("sim"))).alias("sim"), F.max(F.when(F.col("_r") == 2, F.col("sim"))).alias("second"))
    sure = (F.col("sim") >= high) & (F.col("sim") - F.coalesce("second", F.lit(-1.0)) >= margin)
    return best.withColumn("decision", F.when(sure, "matched").when(F.col("sim") >= low, "suggested").otherwise("new"))


def same_and_other(df: DataFrame, key: str, vector: str, owner: str, registry: DataFrame, centroid: str, most: int = OWNERS) -> DataFrame:
    """Cosine of each vector with its own centroid, and the best with any other."""
    unit, out = df.select(key, F.col(owner).alias("_own"), normalized(F.col(vector)).alias("_u")), None
    sim = dot(F.col("_u"), F.col("_c"))
    for part in blocks(registry, registry.columns[0] if owner not in registry.columns else owner, centroid, most):
        pairs = unit.join(F.broadcast(part), F.size("_u") == F.size("_c"))
        found = pairs.groupBy(key, "_own").agg(F.max(F.when(F.col("_owner") == F.col("_own"), sim)).alias("same"), F.max(F.when(F.col("_owner") != F.col("_own"), sim)).alias("other"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy(key).agg(F.max("same").alias("same"), F.max("other").alias("other"))


def move(totals: DataFrame, key: str, moves: DataFrame) -> DataFrame:
    """Apply signed vector moves (key, sign, vector) to running sums (key, total, n)."""
    base = totals.select(key, F.posexplode("total").alias("_i", "_x"), F.lit(0).alias("_n"))
    change = moves.select(key, F.posexplode("vector").alias("_i", "_y"), "sign").select(key, "_i", (F.col("_y").cast("double") * F.col("sign")).alias("_x"), F.col("sign").alias("_n"))
    sums = base.unionByName(change).groupBy(key, "_i").agg(F.sum("_x").alias("_s"), F.sum("_n").alias("_d"))
    out = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_d").alias("_d"))
    return out.join(totals.select(key, "n"), key).select(key, F.transform("_v", lambda e: e["_s"]).alias("total"), (F.col("n") + F.col("_d")).alias("n"))


def consistency(df: DataFrame, key: str, vector: str, of: DataFrame) -> DataFrame:
    """Smallest cosine of each key's vectors with the key's mean."""
    joined = df.select(key, normalized(F.col(vector)).alias("_u")).join(of.select(key, "centroid"), key)
    return joined.groupBy(key).agg(F.min(dot(F.col("_u"), F.col("centroid"))).alias("consistency"))


class Centroids:
    """Vector sums under numbers that never change, compared by cosine all at once; sums that gave way count as far off."""

    def __init__(self, width: int) -> None:
        self.total, self.scale, self.used = np.zeros((8, width)), np.ones(8), 0

    def open(self, vector: np.ndarray) -> int:
        if self.used == len(self.total):
            self.total, self.scale = np.vstack((self.total, np.zeros_like(self.total))), np.concatenate((self.scale, np.ones_like(self.scale)))
        self.used += 1
        self.put(self.used - 1, vector)
        return self.used - 1

    def put(self, at: int, total: np.ndarray) -> None:
        self.total[at], self.scale[at] = total, max(1e-8, float(np.sqrt(total @ total)))

    def close(self, at: int) -> None:
        self.total[at], self.scale[at] = 0.0, np.inf

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        """Cosine of unit vectors with each sum, -2 with those that gave way."""
        out = vectors @ (self.total[: self.used] / self.scale[: self.used, None]).T
        out[..., np.isinf(self.scale[: self.used])] = -2.0
        return out


def _join_close(sums: Centroids, threshold: float) -> None:
    """Join the closest two sums until none are within the threshold, from a heap of close pairs; a changed sum makes its pairs stale."""
    age, heap = [0] * sums.used, []

    def offer(at: int, others: range) -> None:
        near = sums.cosines(sums.total[at] / sums.scale[at])
        for other in others:
            if other != at and near[other] >= threshold:
                a, b = min(at, other), max(at, other)
                heapq.heappush(heap, (-near[other], a, b, age[a], age[b]))

    for at in range(sums.used):
        offer(at, range(at))
    while heap:
        _, a, b, *seen = heapq.heappop(heap)
        if seen == [age[a], age[b]]:
            sums.put(a, sums.total[a] + sums.total[b])
            sums.close(b)
            age[a], age[b] = age[a] + 1, age[b] + 1
            offer(a, range(sums.used))


def cluster(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster of each vector, numbered from 0 by size: leaders in order, close centroids joined, each vector to the nearest centroid."""
    unit = vectors / np.maximum(1e-8, np.linalg.norm(vectors, axis=1, keepdims=True))
    sums = Centroids(unit.shape[1])
    for v in unit:
        near = sums.cosines(v)
        if len(near) and near.max() >= threshold:
            at = int(near.argmax())
            sums.put(at, sums.total[at] + v)
        else:
            sums.open(v)
    _join_close(sums, threshold)
    names, own, count = np.unique(sums.cosines(unit).argmax(axis=1), return_inverse=True, return_counts=True)
    place = np.empty(len(names), np.int64)
    place[np.lexsort((names, -count))] = np.arange(len(names))
    return place[own]


def leader_clusters(df: DataFrame, group: str, key: str, vector: str, threshold: float) -> DataFrame:
    """Leader clustering of each group's vectors in key order, merging of close centroids, and a last reassignment.

    The first pass is order dependent by contract, so a group is a unit of
    work; groups run in parallel.  Columns group, key, cluster (from 0 by size).
    """

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        found = cluster(np.stack(rows["vector"].to_numpy()).astype(float), threshold)
        return pd.DataFrame({group: [name[0]] * len(rows), key: rows[key], "cluster": found})

    return df.select(group, key, F.col(vector).cast("array<double>").alias("vector")).groupBy(group).applyInPandas(run, f"{group} long, {key} long, cluster long")
