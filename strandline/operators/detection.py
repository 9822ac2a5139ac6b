"""Temporal detection metrics: greedy matching of proposals with truth, precision and recall over the global ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ranking import auc, highest_after, running
from strandline.session import materialize


def match_proposals(proposals: DataFrame, truth: DataFrame, thresholds: list[float], key: str = "sample_id") -> DataFrame:
    """Per threshold and proposal whether it hits: best score first, each truth used once, the best overlap wins, a later truth on a tie.

    A truth is used within its sample only, so samples are matched apart.
    Columns threshold, key, score, seq, hit.
    """

    def run(name: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        p = p.sort_values(["score", "seq"], ascending=[False, True], kind="stable")
        spans = sorted(zip(t["a"], t["b"]))
        for threshold in thresholds:
            used: set[int] = set()
            for a, b, score, seq in zip(p["a"], p["b"], p["score"], p["seq"]):
                best, at = threshold, -1
                for i, (x, y) in enumerate(spans):
                    if i in used:
                        continue
                    inter = max(0.0, min(b, y) - max(a, x))
                    union = (b - a) + (y - x) - inter
                    overlap = inter / union if union > 0 else 0.0
                    if overlap >= best:
                        best, at = overlap, i
                if at >= 0:
                    used.add(at)
                out.append((threshold, name[0], score, seq, at >= 0))
        return pd.DataFrame(out, columns=["threshold", key, "score", "seq", "hit"])

    schema = f"threshold double, {key} long, score double, seq long, hit boolean"
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both may come from one table
    return own(proposals).groupBy(key).cogroup(own(truth).groupBy(key)).applyInPandas(run, schema)


def _interpolated(hits: DataFrame, key: str) -> DataFrame:
    """One row: _sum (the envelope's precision, summed over the hits of the global ranking) and _hits; beyond what one task takes, ranges carry the sums."""
    ranked = running(hits.select(ranked_score(key).alias("_at"), F.col("hit").cast("int").alias("_tp"), F.lit(1).alias("_one")), [], "_at", {"tp": "_tp", "n": "_one"}, descending=True)
    later = highest_after(ranked.select("_at", "_tp", (F.col("tp") / F.col("n")).alias("_p")), "_at", "_p")
    return later.agg(F.coalesce(F.sum(F.when(F.col("_tp") == 1, F.col("_top"))), F.lit(0.0)).alias("_sum"), F.sum(F.col("_tp").cast("long")).alias("_hits"))


def temporal_ap(hits: DataFrame, truths: int, key: str = "sample_id") -> DataFrame:
    """Average precision under the precision envelope, per threshold; 0 without proposals, null without truth."""
    if not truths:
        return hits.select("threshold").distinct().withColumn("ap", F.lit(None).cast("double"))
    hits, out = materialize(hits, "hits"), None
    for (threshold,) in hits.select("threshold").distinct().orderBy("threshold").collect():  # the thresholds asked for
        one = _interpolated(hits.filter(F.col("threshold") == threshold), key)
        one = one.select(F.lit(threshold).alias("threshold"), (F.col("_sum") / truths).alias("ap"), F.col("_hits").alias("matched"))
        out = one if out is None else out.unionByName(one)
    return hits.sparkSession.createDataFrame([], "threshold double, ap double, matched long") if out is None else out


def average_recall(proposals: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 5, 10), key: str = "sample_id") -> DataFrame:
    """One row: segments, and for each N the share of truths that one of their sample's first N proposals (by seq, from 0) meets, averaged over overlaps of 0.5, 0.55, ... 0.95; null without truth."""
    levels = [x / 100 for x in range(50, 100, 5)]
    t = truth.select(F.col(key).alias("_k"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    p = proposals.select(F.col(key).alias("_p"), "a", "b", "seq")
    inter = F.greatest(F.lit(0.0), F.least("b", "_b") - F.greatest("a", "_a"))
    overlap = inter / (F.col("b") - F.col("a") + F.col("_b") - F.col("_a") - inter)
    pairs = t.join(p, F.col("_k") == F.col("_p"), "left").groupBy("_k", "_a", "_b").agg(*[F.max(F.when(F.col("seq") < n, overlap)).alias(f"_{n}") for n in at])
    met = lambda n: sum(F.when(F.col(f"_{n}") >= x, 1).otherwise(0) for x in levels) / len(levels)
    return pairs.agg(F.count("*").alias("segments"), *[F.avg(met(n)).alias(f"ar_{n}") for n in at])


def localization(df: DataFrame, key: str, frame: str, inside: str, score: str, reach: int = 2) -> DataFrame:
    """One row: means over the samples with frames inside and outside of AUC, top frame inside (the first of equal ones), and score within `reach` of the first or last inside frame and between."""
    ends = df.groupBy(key).agg(F.min(F.when(F.col(inside), F.col(frame))).alias("_lo"), F.max(F.when(F.col(inside), F.col(frame))).alias("_hi"), F.every(inside).alias("_all"), F.max_by(inside, F.struct(F.col(score), -F.col(frame))).alias("_top"))
    ends = ends.filter(F.col("_lo").isNotNull() & ~F.col("_all")).select(F.col(key).alias("_k"), "_lo", "_hi", "_top")
    near = F.least(F.abs(F.col(frame) - F.col("_lo")), F.abs(F.col(frame) - F.col("_hi"))) <= reach
    own = df.filter(inside).join(ends, F.col(key) == F.col("_k")).groupBy("_k", "_top").agg(F.avg(F.when(near, F.col(score))).alias("_edge"), F.avg(F.when(~near, F.col(score))).alias("_middle"))
    ranked = auc(df.withColumn("_y", F.col(inside).cast("int")), [key], "_y", score)
    return ranked.join(own, F.col(key) == F.col("_k")).agg(
        F.avg("auc").alias("mean_auc"), F.count("*").alias("clips"), F.avg(F.col("_top").cast("int")).alias("top_inside"), F.avg("_edge").alias("edge"), F.avg("_middle").alias("middle")
    )


def localization_by(df: DataFrame, by: str, key: str, frame: str, inside: str, score: str) -> DataFrame:
    """Per group, over the samples with cells inside and outside: their number, the AUC of all their cells, the mean of inside minus outside, the share with the top cell inside."""
    clips = df.groupBy(by, key).agg(F.avg(F.when(F.col(inside), F.col(score))).alias("_in"), F.avg(F.when(~F.col(inside), F.col(score))).alias("_out"), F.max_by(inside, F.struct(F.col(score), -F.col(frame))).alias("_top")).filter("_in IS NOT NULL AND _out IS NOT NULL")
    means = clips.groupBy(F.col(by).alias("_m")).agg(F.count("*").alias("clips"), F.avg(F.col("_in") - F.col("_out")).alias("lift"), F.avg(F.col("_top").cast("int")).alias("peak_rate"))
    cells = df.join(clips.select(F.col(by).alias("_g"), F.col(key).alias("_k")), (F.col(by) == F.col("_g")) & (F.col(key) == F.col("_k")), "left_semi")
    pooled = auc(cells.select(F.col(by).alias("_a"), F.col(inside).cast("int").alias("_y"), score), ["_a"], "_y", score)
    every = df.select(by).distinct()
    out = every.join(means, F.col(by) == F.col("_m"), "left").join(pooled, F.col(by) == F.col("_a"), "left")
    return out.select(by, F.coalesce("clips", F.lit(0)).alias("clips"), F.col("auc").alias("cell_auc"), "lift", "peak_rate")


def temporal_report(proposals: DataFrame, truth: DataFrame, threshold: float, key: str = "sample_id", short: float = 1.0) -> DataFrame:
    """One row: segments, ap, matched, mean_tiou, start_mae, end_mae, short_recall of proposals (key, a, b, score) against truth (key, a, b).

    In each sample proposals come best score first (then earliest); each takes
    the unused truth it overlaps most, the later one on a tie, and hits if that
    overlap reaches the threshold.  Precision is interpolated over the global
    ranking.  Truths of at most `short` seconds make the short recall.  Samples
    without truth count only if the truth table names them (with null spans).
    All but the counts are null without truth, means without a hit.
    """

    def run(name: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        spans = sorted((x, y) for x, y in zip(t["a"], t["b"]) if x == x and y == y)
        free, out = list(range(len(spans))), []
        if len(t):
            for a, b, score in p.sort_values(["score", "a", "b"], ascending=[False, True, True])[["a", "b", "score"]].itertuples(index=False):
                def overlap(i: int) -> float:
                    inter = max(0.0, min(b, spans[i][1]) - max(a, spans[i][0]))
                    return inter / max(1e-9, b - a + spans[i][1] - spans[i][0] - inter)

                best = max(free, key=lambda i: (overlap(i), i), default=None)
                hit = best is not None and overlap(best) >= threshold
                row = (overlap(best), abs(a - spans[best][0]), abs(b - spans[best][1]), spans[best][1] - spans[best][0] <= short) if hit else (None, None, None, False)
                if hit:
                    free.remove(best)
                out.append((name[0], score, len(out), hit, *row))
        return pd.DataFrame(out, columns=[key, "score", "seq", "hit", "tiou", "start_error", "end_error", "short"])

    schema = f"{key} long, score double, seq long, hit boolean, tiou double, start_error double, end_error double, short boolean"
    own = lambda df: df.select(F.col(key).alias(key), *[F.col(c).cast("double").alias(c) for c in df.columns if c != key])
    hits = materialize(own(proposals).groupBy(key).cogroup(own(truth).groupBy(key)).applyInPandas(run, schema), "hits")
    total = truth.filter("a IS NOT NULL").agg(F.count("*").alias("segments"), F.count_if(F.col("b") - F.col("a") <= short).alias("_short"))
    ap = _interpolated(hits, key).select("_sum")
    means = hits.agg(F.count_if("hit").alias("matched"), F.avg("tiou").alias("mean_tiou"), F.avg("start_error").alias("start_mae"), F.avg("end_error").alias("end_mae"), F.count_if(F.col("hit") & F.col("short")).alias("_hits"))
    out = total.crossJoin(F.broadcast(ap)).crossJoin(F.broadcast(means))
    return out.select("segments", F.when(F.col("segments") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("segments")).alias("ap"), "matched", "mean_tiou", "start_mae", "end_mae", F.when(F.col("_short") > 0, F.col("_hits") / F.col("_short")).alias("short_recall"))


def ranked_score(key: str) -> Column:
    """A value that orders proposals over all samples: by score, then the smaller key, then the earlier in its sample."""
    return F.struct("score", (-F.col(key)).alias("k"), (-F.col("seq")).alias("s"))


def frame_head(heads: dict[str, str], task: str) -> Column:
    """The frame scores that speak for a task: the column `score` if the model has one, else the first head of the task; for "ai" the larger of its visual and audio heads; else null.

    heads: the model's columns of frame scores (arrays) and their tasks.
    """
    if "score" in heads:
        return F.col("score")
    own = [h for h, t in heads.items() if t == task]
    parts = own[:1] or ([h for h, t in heads.items() if t in ("visual", "audio")] if task == "ai" else [])
    if not parts:
        return F.lit(None).cast("array<double>")
    out = F.col(parts[0])
    for other in parts[1:]:
        out = F.zip_with(out, F.col(other), lambda x, y: F.greatest(x, y))
    return out


def flat_report(df: DataFrame, condition: str, score: str, real: Column, threshold: float, label: str = "label", prefix: str = "validation") -> DataFrame:
    """name, value: for each condition of positives the AUC against the real rows, for each other one the share at or above the threshold."""
    kinds = df.filter(F.col(label) == 1).select(F.col(condition).alias("_c")).distinct()
    reals = df.filter(real).select(score, F.lit(0).alias("_y")).crossJoin(F.broadcast(kinds))
    fakes = df.filter(F.col(label) == 1).select(score, F.lit(1).alias("_y"), F.col(condition).alias("_c"))
    curves = auc(reals.unionByName(fakes), ["_c"], "_y", score).select(F.concat(F.lit(f"{prefix}_auc/"), "_c").alias("name"), F.col("auc").alias("value"))
    alarms = df.filter(F.col(label) == 0).groupBy(condition).agg(F.avg((F.col(score) >= threshold).cast("int")).alias("value"))
    return curves.unionByName(alarms.select(F.concat(F.lit(f"{prefix}_false_alarm/"), condition).alias("name"), "value"))
