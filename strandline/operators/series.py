"""Operators over frame series in long form: one row a key and frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(key: str, frame: str):
    return Window.partitionBy(key).orderBy(frame)


def run_smooth(df: DataFrame, key: str, frame: str, run: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Centred moving mean of up to `half` frames each way, inside each run."""
    w = Window.partitionBy(key, run).orderBy(frame).rowsBetween(-half, half)
    return df.withColumn(name, F.avg(value).over(w))


def differences(df: DataFrame, key: str, frame: str, value: str, orders: int = 3) -> DataFrame:
    """First to n-th differences d1, d2, ...; 0 before the first frame."""
    w, last = order(key, frame), value
    for i in range(1, orders + 1):
        df = df.withColumn(f"d{i}", F.coalesce(F.col(last) - F.lag(last).over(w), F.lit(0.0)))
        last = f"d{i}"
    return df


def residual(df: DataFrame, key: str, frame: str, value: str, name: str = "residual") -> DataFrame:
    """Value minus the mean of both neighbours; edges repeat."""
    w = order(key, frame)
    return df.withColumn(name, F.col(value) - (F.coalesce(F.lag(value).over(w), F.col(value)) + F.coalesce(F.lead(value).over(w), F.col(value))) / 2)


def fill_gaps(df: DataFrame, key: str, frame: str, value: str, name: str = "filled") -> DataFrame:
    """Missing values on the line between the known neighbours; the nearest known value at the edges."""
    back = order(key, frame).rowsBetween(Window.unboundedPreceding, 0)
    ahead = order(key, frame).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(frame))
    df = df.withColumns({"_v0": F.last(value, True).over(back), "_f0": F.last(known, True).over(back), "_v1": F.first(value, True).over(ahead), "_f1": F.first(known, True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(frame) - F.col("_f0")) / F.greatest(F.col("_f1") - F.col("_f0"), F.lit(1))
    return df.withColumn(name, F.coalesce(line, "_v0", "_v1")).drop("_v0", "_f0", "_v1", "_f1")


def surroundings(values: np.ndarray, half: int, skip: int, shift: int = 0) -> np.ndarray:
    """For each place the values within `half` places, without the one `shift` places on and `skip` each side of it; NaN where there is none."""
    padded = np.concatenate((np.full(half, np.nan), values, np.full(half, np.nan)))
    out = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1).copy()
    out[:, max(0, half + shift - skip) : half + shift + skip + 1] = np.nan
    return out


def median_of(rows: np.ndarray, empty: float = np.nan) -> np.ndarray:
    """Median of each row's known values."""
    known, n = np.sort(rows, axis=1), np.count_nonzero(~np.isnan(rows), axis=1)  # NaN comes last
    at, i = np.maximum(n, 1), np.arange(len(rows))
    return np.where(n > 0, (known[i, (at - 1) // 2] + known[i, at // 2]) / 2, empty)


def robust_distance(values: np.ndarray, half: int = 25, skip: int = 1, shift: int = 0, least: int = 5, floor: float = 1e-4) -> np.ndarray:
    """Distance of the value `shift` places on from the median of a place's surroundings in robust deviations; 0 with fewer than `least` known ones."""
    near = surroundings(values, half, skip, shift)
    values = np.concatenate((np.full(max(0, -shift), np.nan), values[max(0, shift) : len(values) + min(0, shift)], np.full(max(0, shift), np.nan)))
    middle = median_of(near)
    scale = np.fmax(floor, 1.4826 * median_of(np.abs(near - middle[:, None])))
    return np.where(np.count_nonzero(~np.isnan(near), axis=1) >= least, (values - middle) / scale, 0.0)


def robust_z(df: DataFrame, key: str, frame: str, value: str, half: int = 25, skip: int = 1, name: str = "z") -> DataFrame:
    """key, frame, and the distance from the median of the surrounding frames (without the centre and `skip` each side) in robust deviations.

    1.4826 times the median absolute deviation, at least 1e-4; 0 with fewer
    than 5 known values.  A sample's series is a unit of work.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(frame)
        return pd.DataFrame({key: rows[key], frame: rows[frame], name: robust_distance(rows[value].to_numpy(float), half, skip)})

    kinds = dict(df.dtypes)
    return df.select(key, frame, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {frame} {kinds[frame]}, {name} double")


def refractory(df: DataFrame, key: str, frame: str, hit: Column, pause: int) -> DataFrame:
    """Hits of each key in order, without those closer than `pause` frames to the hit kept before: one array fold a key."""
    hits = df.filter(hit).groupBy(key).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    fold = F.aggregate("f", F.expr("cast(array() as array<bigint>)"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= pause), F.concat(kept, F.array(x.cast("long")))).otherwise(kept))
    return hits.select(key, F.explode(fold).alias(frame))


def pooled(df: DataFrame, key: str, frame: str, value: str, valid: str, stride: int) -> DataFrame:
    """Mean value, and whether all frames are valid, of each block of `stride` frames."""
    return df.groupBy(key, F.floor(F.col(frame) / stride).alias("block")).agg(F.avg(value).alias("value"), F.bool_and(valid).alias("valid"))


def lag_profile(a: DataFrame, b: DataFrame, key: str, frame: str, x: str, y: str, most: int, least_overlap: int) -> DataFrame:
    """Mean product of a's series and b's, shifted by each lag in [-most, most]: key, lag, score, overlap."""
    lags = a.select(key, frame, x, F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    shifted = lags.withColumn("_at", F.col(frame) + F.col("lag"))
    other = b.select(key, F.col(frame).alias("_at"), F.col(y).alias("_y"))
    out = shifted.join(other, [key, "_at"]).groupBy(key, F.col("lag").cast("long").alias("lag")).agg(F.avg(F.col(x) * F.col("_y")).alias("score"), F.count("*").alias("overlap"))
    return out.filter(F.col("overlap") >= least_overlap)


def best_lag(profile: DataFrame, key: str) -> DataFrame:
    """The lag with the best score (the smallest of equal ones) and how far it stands above the median."""
    best = F.max_by(F.struct("lag", "score"), F.struct(F.round("score", 12), -F.col("lag")))
    return profile.groupBy(key).agg(best.alias("b"), F.median("score").alias("m")).select(key, F.col("b.lag").alias("lag"), (F.col("b.score") - F.col("m")).alias("peak"))


def shift(df: DataFrame, key: str, frame: str, value: str, lag: int) -> DataFrame:
    """The series moved by `lag` frames, with a mask of frames that have a source."""
    moved = df.select(key, (F.col(frame) + lag).alias(frame), F.col(value).alias("moved"))
    return df.select(key, frame).join(moved, [key, frame], "left").withColumn("has", F.col("moved").isNotNull())


def resample(df: DataFrame, key: str, at: str, value: str, length: DataFrame, step: float, fresh: float) -> DataFrame:
    """A constant grid with the last known value at each point, valid if it is at most `fresh` old."""
    grid = length.select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / step).cast("int"))).alias("i")).select(key, F.round(F.col("i") * step, 6).alias("t"), F.lit(1).alias("g"))
    known = df.select(key, F.col(at).alias("t"), F.col(value).alias("v"), F.lit(0).alias("g"))
    both = known.unionByName(grid, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("t", "g").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"value": F.last("v", True).over(w), "_since": F.last(F.when(F.col("g") == 0, F.col("t")), True).over(w)})
    return both.filter("g = 1").select(key, "t", "value", F.coalesce(F.round(F.col("t") - F.col("_since"), 6) <= fresh, F.lit(False)).alias("valid"))


def top_mean(df: DataFrame, key: str, value: str, fraction: float) -> DataFrame:
    """Mean of each key's largest ceil(fraction * n) values."""
    ranked = df.withColumns({"_r": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value))), "_n": F.count("*").over(Window.partitionBy(key))})
    return ranked.filter(F.col("_r") <= F.ceil(F.col("_n") * fraction)).groupBy(key).agg(F.avg(value).alias("score"))


def pool(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, maximum and shifted log-sum-exp of each key's values."""
    top = df.groupBy(key).agg(F.max(value).alias("_m"), F.count("*").alias("_n"))
    return df.join(top, key).groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), (F.log(F.sum(F.exp(F.col(value) - F.col("_m"))) / F.first("_n")) + F.first("_m")).alias("lse"))


def edge_silence(df: DataFrame, key: str, frame: str, level: str, below: float) -> DataFrame:
    """Frames before the first and after the last that is louder than the key's maximum minus `below`; the whole if none."""
    top = F.max(level).over(Window.partitionBy(key))
    loud = df.withColumn("_loud", F.col(level) > top - below)
    out = loud.groupBy(key).agg(F.min(F.when(F.col("_loud"), F.col(frame))).alias("_f"), F.max(F.when(F.col("_loud"), F.col(frame))).alias("_l"), F.max(frame).alias("_n"), F.avg(F.col("_loud").cast("double")).alias("loud_share"))
    return out.select(key, F.coalesce("_f", F.col("_n") + 1).alias("lead"), F.coalesce(F.col("_n") - F.col("_l"), F.col("_n") + 1).alias("trail"), "loud_share")


def quietest(df: DataFrame, key: str, frame: str, value: str, size: int) -> DataFrame:
    """The window of `size` frames with the smallest root mean square, the first of equal ones."""
    w = Window.partitionBy(key).orderBy(frame).rowsBetween(0, size - 1)
    out = df.withColumns({"_rms": F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)), "_n": F.count("*").over(w)}).filter(F.col("_n") == size)
    return out.groupBy(key).agg(F.min(F.struct(F.round("_rms", 6).alias("rms"), F.col(frame).alias("start"))).alias("b")).select(key, "b.start", "b.rms")


def timeline_state(df: DataFrame, key: str, frame: str, at: str, digits: int = 6) -> DataFrame:
    """key, state of each series: start (its first time isn't 0), step (its steps differ), or ok; and step, its length."""
    steps = df.select(key, at, (F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(frame))).alias("_s"))
    out = steps.groupBy(key).agg(F.min(at).alias("_first"), (F.max("_s") - F.min("_s")).alias("_spread"), F.avg("_s").alias("step"))
    state = F.when(F.col("_first") != 0, "start").when(F.round(F.coalesce("_spread", F.lit(0.0)), digits) > 0, "step").otherwise("ok")
    return out.select(key, state.alias("state"), "step")


def blocks(df: DataFrame, key: str, at: str, value: str, size: int) -> DataFrame:
    """key, block, samples: the series in blocks of `size` places from 0 on; places without a sample are 0, and so is the rest of the last block."""
    held = df.groupBy(key, F.floor(F.col(at) / size).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod(F.col(at), F.lit(size)).cast("int"), F.col(value).cast("double")))).alias("_v"))
    ends = df.groupBy(key).agg(F.max(F.floor(F.col(at) / size)).alias("_end"))
    grid = ends.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "_end")).alias("block"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return grid.join(held, [key, "block"], "left").select(key, "block", F.transform(places, lambda i: F.coalesce(F.try_element_at("_v", i), F.lit(0.0))).alias("samples"))


def aligned(first: DataFrame, second: DataFrame, key: str, frame: str, valid: str) -> DataFrame:
    """Two series of a sample (frames from 0) cut to the shorter one: the columns of both, valid where both are."""
    length = lambda df: df.groupBy(key).agg(F.max(frame).alias("_n"))
    least = length(first).unionByName(length(second)).groupBy(key).agg(F.min("_n").alias("_n"), F.count("*").alias("_c")).filter("_c = 2").drop("_c")
    other = second.withColumnRenamed(valid, "_valid")
    out = first.join(least, key).filter(F.col(frame) <= F.col("_n")).drop("_n").join(other, [key, frame], "left")
    return out.withColumn(valid, F.col(valid) & F.coalesce("_valid", F.lit(False))).drop("_valid")


def scene_changes(df: DataFrame, key: str, frame: str, histogram: str, every: int, least: float) -> DataFrame:
    """key, frame, similarity of each sampled frame (every `every`-th) whose histogram correlates less than `least` with the one sampled before."""
    w = Window.partitionBy(key).orderBy(frame)
    sampled = df.filter(F.col(frame) % every == 0).select(key, frame, F.col(histogram).cast("array<double>").alias("_h"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    centred = sampled.withColumn("_h", F.transform("_h", lambda x: x - mean(F.col("_h")))).withColumn("_p", F.lag("_h").over(w)).filter("_p IS NOT NULL")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    spread = F.sqrt(product("_h", "_h") * product("_p", "_p"))
    similarity = F.when(spread > 0, product("_h", "_p") / spread).otherwise(F.lit(1.0))
    return centred.select(key, frame, similarity.alias("similarity")).filter(F.col("similarity") < least)


def replaced(df: DataFrame, segments: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """The series with the frames of each sample's segment (key, a, b, donor) taken from the donor's same frames, where it has them; replaced says which."""
    donors = df.select(F.col(key).alias("donor"), F.col(frame), F.col(value).alias("_v"))
    out = df.join(segments.select(key, "a", "b", "donor"), key, "left").join(donors, ["donor", frame], "left")
    here = F.col(frame).between(F.col("a"), F.col("b")) & F.col("_v").isNotNull()
    return out.withColumns({"replaced": F.coalesce(here, F.lit(False)), value: F.when(here, F.col("_v")).otherwise(F.col(value))}).drop("a", "b", "donor", "_v")


def loudness(df: DataFrame, key: str, at: str, value: str, size: int, below: float = 40.0, floor: float = 1e-6) -> DataFrame:
    """key, frame, rms and db of each frame of `size` places, and kept: from the first to the last frame above the loudest minus `below`."""
    f = df.groupBy(key, F.floor(F.col(at) / size).alias("frame")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    f = f.withColumn("db", 20 * F.log10(F.greatest("rms", F.lit(floor))))
    top = f.groupBy(key).agg(F.max("db").alias("_top"))
    loud = F.when(F.col("db") > F.col("_top") - below, F.col("frame"))
    ends = f.join(top, key).groupBy(key).agg(F.min(loud).alias("_a"), F.max(loud).alias("_b"))
    return f.join(ends, key).withColumn("kept", F.col("frame").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
