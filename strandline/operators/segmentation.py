"""Greedy cutters and pickers whose order is part of their contract: one key is a unit of work, keys run in parallel."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import intervals as I
from strandline.session import materialize


def cut_windows(regions: DataFrame, pauses: DataFrame, key: str, shortest: float, longest: float, grid: float = 0.04) -> DataFrame:
    """Cut each region into windows of shortest to longest seconds, at the longest pause in reach (a later one wins ties), else at the longest length; ends lie on the grid."""

    def run(name: tuple, r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        stops = sorted(zip((p["a"] + p["b"]) / 2, p["b"] - p["a"])) if len(p) else []
        for a, b in sorted(zip(r["a"], r["b"])):
            at = a
            while b - at >= shortest - 1e-9:
                if b - at <= longest + 1e-9:
                    end = b
                else:
                    near = [(round(length, 9), mid) for mid, length in stops if at + shortest <= mid <= at + longest]
                    end = max(near)[1] if near else at + longest
                    end = round(round(end / grid) * grid, 6)
                out.append((name[0], at, end))
                at = end
        return pd.DataFrame(out, columns=[key, "a", "b"])

    fresh = lambda df: df.select(F.col(key).alias(key), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))  # noqa: E731  columns of their own, as both may come from one table
    return fresh(regions).groupBy(key).cogroup(fresh(pauses).groupBy(key)).applyInPandas(run, f"{key} long, a double, b double")


def suppress(proposals: DataFrame, key: str, limit: float, keep: int) -> DataFrame:
    """Non-maximum suppression: best score first (of equal ones the later start, then the later end), dropping what overlaps a kept one by `limit` or more; at most `keep` a key."""

    def run(name: tuple, p: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for a, b, s in sorted(zip(p["a"], p["b"], p["score"]), key=lambda x: (x[2], x[0], x[1]), reverse=True):
            if len(kept) == keep:
                break
            for x, y, _ in kept:
                inter = max(0.0, min(b, y) - max(a, x))
                if inter / max(1e-9, (b - a) + (y - x) - inter) >= limit:
                    break
            else:
                kept.append((a, b, s))
        return pd.DataFrame([(name[0], *x) for x in kept], columns=[key, "a", "b", "score"])

    return proposals.select(key, F.col("a").cast("double"), F.col("b").cast("double"), "score").groupBy(key).applyInPandas(run, f"{key} long, a double, b double, score double")


def proposals(df: DataFrame, key: str, frame: str, score: str, step: float, levels: tuple[int, ...] = (50, 60, 70, 80, 90, 95), least_frames: int = 2, limit: float = 0.7, keep: int = 10) -> DataFrame:
    """Candidate spans: runs of at least `least_frames` at or above each percentile of the key's own scores, with their mean score, after suppression."""
    cuts = df.groupBy(key).agg(F.percentile(score, F.array(*[F.lit(x / 100) for x in levels])).alias("_cuts"))
    cut = materialize(df.join(cuts, key).select(key, frame, score, "_cuts"), "levels")
    found = [I.mask_to_spans(cut, key, frame, F.col(score) >= F.col("_cuts")[i], 1, F.col(score)).filter(F.col("frames") >= least_frames).select(key, "a", "b", "score") for i in range(len(levels))]
    out = suppress(reduce(DataFrame.unionByName, found), key, limit, keep)  # in whole frames, where overlaps are exact
    return out.select(key, (F.col("a") * step).alias("a"), (F.col("b") * step).alias("b"), "score")
