"""Interval algebra, runs over frame series, and window grids.

Intervals are half-open stretches (a, b) of seconds, one a row with a key, or
an array of structs.  A null array is unknown, an empty one is known to be
empty; the two are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_spans(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", touch: float = 1e-9, digits: int | None = 4) -> DataFrame:
    """Union of each key's intervals: keys, a, b; intervals that touch (within `touch`) become one."""
    before = Window.partitionBy(*keys).orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(a, b).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col(a) > F.max(b).over(before) + touch, F.lit(True)).cast("int")
    runs = df.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(upto))
    out = runs.groupBy(*keys, "_run").agg(F.min(a).alias("a"), F.max(b).alias("b")).drop("_run")
    return out if digits is None else out.withColumns({"a": F.bround("a", digits), "b": F.bround("b", digits)})


def iou(a1: Column, b1: Column, a2: Column, b2: Column, floor: float = 0.0) -> Column:
    """Intersection over union of two intervals; 0 where both are empty."""
    inter = F.greatest(F.lit(0.0), F.least(b1, b2) - F.greatest(a1, a2))
    union = (b1 - a1) + (b2 - a2) - inter
    return F.when(union > floor, inter / union).otherwise(F.lit(0.0))


def apart(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return (b1 <= a2) | (b2 <= a1)


def well_formed(spans: Column, duration: Column, slack: float = 1e-6) -> Column:
    """Sorted, disjoint, inside [0, duration]; null (unknown) is well formed."""
    each = F.forall(spans, lambda s: (s["a"] >= -slack) & (s["b"] > s["a"]) & (s["b"] <= duration + slack))
    pairs = F.zip_with(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), lambda x, y: y["a"] >= x["b"] - slack)
    return spans.isNull() | (each & F.forall(pairs, lambda ok: ok))


def contained(inner: Column, outer: Column, slack: float = 1e-6) -> Column:
    """Every inner interval lies in one of the outer ones."""
    return F.forall(inner, lambda i: F.exists(outer, lambda o: (i["a"] >= o["a"] - slack) & (i["b"] <= o["b"] + slack)))


def cell_targets(df: DataFrame, key: str, spans: str | list[str], duration: str, step: float) -> DataFrame:
    """Covered share of each grid cell, clipped to [0, 1]; -1 throughout where the spans are unknown; the last cell ends with the duration.

    One column of spans gives key, cell, target; several give a column of targets each, under their names.
    """
    n = F.greatest(F.lit(1), F.ceil(F.round(F.col(duration) / step, 9))).cast("int")
    cells = df.withColumn("cell", F.explode(F.sequence(F.lit(0), n - 1)))
    low = F.col("cell") * F.lit(step)
    high = F.least(low + step, F.col(duration))

    def target(kind: str) -> Column:
        covered = F.aggregate(kind, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), F.least(s["b"], high) - F.greatest(s["a"], low)))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), covered / F.greatest(high - low, F.lit(1e-9))))
        return F.when(F.col(kind).isNull(), F.lit(-1.0)).otherwise(share)

    targets = [target(spans).alias("target")] if isinstance(spans, str) else [target(k).alias(k) for k in spans]
    return cells.select(key, F.col("cell").cast("long").alias("cell"), *targets)


def runs(df: DataFrame, key: str, frame: str, keep: Column) -> DataFrame:
    """Rows where `keep` holds, with `run`: a number, from 0, for each stretch of consecutive frames of a key."""
    w = Window.partitionBy(key).orderBy(frame)
    kept = df.filter(keep)
    fresh = F.coalesce(F.col(frame) != F.lag(frame).over(w) + 1, F.lit(True)).cast("int")
    return kept.withColumn("_new", fresh).withColumn("run", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def mask_to_spans(df: DataFrame, key: str, frame: str, keep: Column, step: float, score: Column, duration: Column | None = None, shortest: float = 0.0) -> DataFrame:
    """Each run of kept frames as an interval with its mean score; ends are cut at the duration, short ones dropped."""
    out = runs(df, key, frame, keep).groupBy(key, "run").agg((F.min(frame) * step).alias("a"), ((F.max(frame) + 1) * step).alias("b"), F.avg(score).alias("score"), F.count("*").alias("frames"))
    if duration is not None:
        out = out.withColumn("b", F.least(F.col("b"), duration))
    return out.filter(F.col("b") - F.col("a") >= shortest - 1e-9)


def speech_regions(df: DataFrame, key: str, frame: str, probability: str, step: float, duration: DataFrame, threshold: float = 0.5, silence_s: float = 0.3, pad_s: float = 0.15, shortest: float = 0.25) -> DataFrame:
    """Runs of likely speech: gaps up to silence_s closed, short regions dropped, the rest padded and merged."""
    raw = mask_to_spans(df, key, frame, F.col(probability) >= threshold, step, F.col(probability)).select(key, "a", "b")
    merged = coalesce_spans(raw, [key], touch=silence_s, digits=None).filter(F.col("b") - F.col("a") >= shortest - 1e-9)
    padded = merged.join(duration, key).select(key, F.greatest(F.lit(0.0), F.col("a") - pad_s).alias("a"), F.least(F.col("duration"), F.col("b") + pad_s).alias("b"))
    return coalesce_spans(padded, [key])


def inner_pauses(df: DataFrame, key: str, frame: str, probability: str, step: float, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Runs below the threshold that lie strictly inside a region of the same key."""
    low = mask_to_spans(df, key, frame, F.col(probability) < threshold, step, F.col(probability)).select(key, "a", "b")
    r = regions.select(key, F.col("a").alias("_a"), F.col("b").alias("_b"))
    return low.join(r, key).filter((F.col("a") > F.col("_a")) & (F.col("b") < F.col("_b"))).select(key, "a", "b")


def fixed_windows(df: DataFrame, key: str, length: str, size: int, step: int) -> DataFrame:
    """Windows of `size` frames every `step`, the last one aligned to the end; one window if the series is shorter."""
    regular = F.when(F.col(length) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col(length) - size).cast("int"), F.lit(step)))
    starts = F.when(F.col(length) <= size, regular).otherwise(F.array_union(regular, F.array((F.col(length) - size).cast("int"))))
    return df.select(key, F.col(length).alias("_n"), F.explode(starts).alias("start")).select(key, F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, F.col("_n")).cast("long").alias("stop"))


def overlap_average(windows: DataFrame, key: str, start: str, stop: str, score: str) -> DataFrame:
    """Per frame the mean of the scores of the windows over it."""
    return windows.select(key, score, F.explode(F.sequence(F.col(start), F.col(stop) - 1)).alias("frame")).groupBy(key, "frame").agg(F.avg(score).alias("score"))


def context_windows(df: DataFrame, key: str, length: str, half: int, step: int) -> DataFrame:
    """Centres every `step` frames, with the window round each and whether it lies inside the series."""
    centre = F.explode(F.sequence(F.lit(0), (F.col(length) - 1).cast("int"), F.lit(step)))
    out = df.select(key, F.col(length).alias("_n"), centre.alias("centre")).withColumn("centre", F.col("centre").cast("long"))
    return out.select(key, "centre", F.greatest(F.lit(0), F.col("centre") - half).alias("start"), F.least(F.col("_n"), F.col("centre") + half + 1).alias("stop"), ((F.col("centre") >= half) & (F.col("centre") + half < F.col("_n"))).alias("whole"))


def coverage(windows: DataFrame, points: DataFrame, key: str, at: str, good: Column) -> DataFrame:
    """Share of good points among those with start <= at < stop, per window; a range join inside each key."""
    joined = windows.join(points.withColumn("_good", good), key).filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop")))
    return joined.groupBy(key, "start", "stop").agg(F.avg(F.col("_good").cast("double")).alias("ratio"), F.count("*").alias("points"))


def segments(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Cut each key's line at every boundary of its intervals: consecutive segments (a, b) and how many intervals cover each."""
    marks = df.select(key, F.col(a).alias("x"), F.lit(1).alias("d")).unionByName(df.select(key, F.col(b).alias("x"), F.lit(-1).alias("d")))
    marks = marks.groupBy(key, "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("x")
    out = marks.select(key, F.col("x").alias("a"), F.lead("x").over(w).alias("b"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("covering"))
    return out.filter("b IS NOT NULL")


def word_spans(df: DataFrame, key: str, at: str, a: str, b: str, low: float, high: float) -> DataFrame:
    """Stretches from the start of one word to the end of the same or a later one, with a length in [low, high]."""
    x = df.select(key, F.col(at).alias("first"), F.col(a).alias("a"))
    y = df.select(key, F.col(at).alias("last"), F.col(b).alias("b"))
    length = F.col("b") - F.col("a")
    return x.join(y, key).filter((F.col("first") <= F.col("last")) & (length >= low) & (length <= high))


def frame_targets(df: DataFrame, key: str, kinds: list[str], duration: str, fps: int = 25) -> DataFrame:
    """key, cell (frame), and for each kind of spans the covered share of the frame, -1 where its spans are unknown."""
    return cell_targets(df, key, kinds, duration, 1 / fps)


def on_cells(df: DataFrame, key: str, a: str, b: str, step: float) -> DataFrame:
    """key, cell, covered: each interval (not empty) on the cells of a grid that it meets, and how much of each it covers."""
    cells = F.sequence(F.floor(F.col(a) / step), F.ceil(F.col(b) / step) - 1)
    out = df.filter(F.col(b) > F.col(a)).select(key, a, b, F.explode(cells).alias("cell"))
    covered = F.least(F.col(b), (F.col("cell") + 1) * step) - F.greatest(F.col(a), F.col("cell") * step)
    return out.select(key, F.col("cell").cast("long").alias("cell"), covered.alias("covered"))
