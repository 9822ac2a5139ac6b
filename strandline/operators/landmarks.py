"""Landmark geometry, frame-to-frame change, frame picks and tracks.

Points of a frame are an array of (x, y) arrays, one row a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in the public 68-point layout (fixed values): lips, mouth corners, pairs of inner lips.
LIPS, CORNERS, INNER = (48, 68), (48, 54), ((61, 67), (62, 66), (63, 65))


def point(points: Column, at: int) -> Column:
    return F.element_at(points, at + 1)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))


def normalized_lips(points: Column, floor: float = 1e-3) -> Column:
    """The 20 lip points, from the mouth's centre, in widths of the mouth (at least `floor`)."""
    lips = F.slice(points, LIPS[0] + 1, LIPS[1] - LIPS[0])
    mean = lambda i: F.aggregate(lips, F.lit(0.0), lambda s, p: s + p[i]) / F.size(lips)
    width = F.greatest(distance(point(points, CORNERS[0]), point(points, CORNERS[1])), F.lit(floor))
    return F.transform(lips, lambda p: F.array((p[0] - mean(0)) / width, (p[1] - mean(1)) / width))


def lip_ratios(points: Column, floor: float = 1e-6) -> Column:
    """Mouth opening by face height, mouth width and both cheeks by face width; the face reaches from jaw to brows."""
    jaw, brows = F.slice(points, 1, 17), F.slice(points, 18, 10)
    along = lambda ps, i, f: f(F.transform(ps, lambda p: p[i]))
    width = F.greatest(along(jaw, 0, F.array_max) - along(jaw, 0, F.array_min), F.lit(floor))
    height = F.greatest(along(jaw, 1, F.array_max) - along(brows, 1, F.array_min), F.lit(floor))
    far = lambda a, b: distance(point(points, a), point(points, b))
    return F.array(far(62, 66) / height, far(60, 64) / width, far(48, 4) / width, far(54, 12) / width)


def lip_series(df: DataFrame, points: str, envelope: str, valid: str) -> DataFrame:
    """`df` with aperture (mean inner gap by mouth width), loudness (log of the envelope, at least 1e-5) and seen; both are 0 where not seen."""
    p = F.col(points)
    width = distance(point(p, CORNERS[0]), point(p, CORNERS[1]))
    gap = sum(distance(point(p, a), point(p, b)) for a, b in INNER) / len(INNER) / F.greatest(width, F.lit(1e-3))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    seen = F.coalesce(F.col(valid) & (width > 1) & finite(gap) & finite(F.col(envelope).cast("double")), F.lit(False))
    loud = F.log(F.greatest(F.col(envelope).cast("double"), F.lit(1e-5)))
    return df.withColumns({"aperture": F.when(seen, gap).otherwise(0.0), "loudness": F.when(seen, loud).otherwise(0.0), "seen": seen})


def motion(df: DataFrame, key: str, frame: str, points: str) -> DataFrame:
    """key, frame, motion: mean step of the points by the mean eye distance (points 0 and 1, at least 1) of both frames; 0 at first."""
    w = Window.partitionBy(key).orderBy(frame)
    eyes = F.greatest(distance(point(F.col(points), 0), point(F.col(points), 1)), F.lit(1.0))
    last = df.select(key, frame, points, eyes.alias("_e")).withColumns({"_p": F.lag(points).over(w), "_q": F.lag("_e").over(w)})
    steps = F.zip_with(points, "_p", distance)
    mean = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)
    return last.select(key, frame, F.when(F.col("_p").isNull(), 0.0).otherwise(mean / ((F.col("_e") + F.col("_q")) / 2)).alias("motion"))


def appearance(df: DataFrame, key: str, frame: str, pixels: str, white: float = 255.0) -> DataFrame:
    """key, frame, change: mean absolute difference of the frame's grey levels (a flat array) from the frame before, by `white`; 0 at first."""
    last = F.lag(pixels).over(Window.partitionBy(key).orderBy(frame))
    steps = F.zip_with(pixels, "_p", lambda x, y: F.abs(x.cast("double") - y) / white)
    mean = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)
    return df.select(key, frame, pixels, last.alias("_p")).select(key, frame, F.when(F.col("_p").isNull(), 0.0).otherwise(mean).alias("change"))


def band_change(levels: np.ndarray, half: int = 2) -> np.ndarray:
    """Root mean square difference of the mean log bands of the `half` frames after and before each frame; 0 near the ends."""
    n, out = len(levels), np.zeros(len(levels))
    if n >= 2 * half:
        sums = np.vstack((np.zeros(levels.shape[1]), np.cumsum(levels, axis=0)))
        means = (sums[half:] - sums[:-half]) / half  # of the frames from each on
        change = np.sqrt(((means[half:] - means[:-half]) ** 2).mean(axis=1))
        out[half : half + len(change)] = change[: n - half]
    return out


def log_bands(samples: np.ndarray, frames: int, width: int = 640, bands: int = 32) -> np.ndarray:
    """Log power of each frame's samples (windowed, padded with silence) in bands that grow geometrically."""
    body = np.zeros(frames * width)
    body[: min(len(samples), len(body))] = samples[: len(body)]
    power = np.abs(np.fft.rfft(body.reshape(frames, width) * np.hanning(width), axis=1)) ** 2
    edges = np.unique(np.geomspace(1, power.shape[1] - 1, bands + 1).astype(int))
    return np.log(np.add.reduceat(power[:, : edges[-1]], edges[:-1], axis=1) + 1e-8)


def spectral_change(df: DataFrame, key: str, samples: str, frames: str, half: int = 2) -> DataFrame:
    """key, frame, change of each frame of a sample (a row with its audio at 640 samples a frame)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body, n in zip(batch[key], batch[samples], batch[frames]):
                change = band_change(log_bands(np.asarray(body, float), int(n)), half) if n else np.empty(0)
                yield pd.DataFrame({key: name, "frame": np.arange(len(change)), "change": change})

    return df.select(F.col(key).cast("long").alias(key), samples, frames).mapInPandas(run, f"{key} long, frame long, change double")


def spread_frames(count: Column, seed: Column) -> Column:
    """Distinct frames, in order: the first, a drawn one in the first half, the middle, a drawn one in the second half, the last.

    Draws follow from the hash of the seed, and keep a tenth of the length from both ends.
    """
    last = (count - 1).cast("long")
    half, tenth = F.floor(last / 2), F.floor(last / 10)

    def drawn(word: int, low: Column, high: Column) -> Column:
        value = F.conv(F.substring(F.sha2(seed.cast("string"), 256), 1 + 8 * word, 8), 16, 10).cast("long")
        return low + F.pmod(value, high - low)

    zero, one, two = (F.lit(i).cast("long") for i in (0, 1, 2))
    early = drawn(0, F.greatest(one, tenth), F.greatest(two, half))
    late = drawn(1, half + 1, F.greatest(half + 2, last - tenth))
    return F.array_sort(F.array_distinct(F.array(zero, early, half, late, last)))


def pick_frames(ratios: list, run: int = 5, others: int = 3, closed: float = 0.01, near: int = 3, apart: int = 4) -> tuple[list[int], list[int], bool]:
    """Places of `run` consecutive frames with an open mouth and of `others` frames alike to the last of them, and whether a fallback was used.

    ratios: the frames' opening, width and cheeks.  Alike: all four, in whole
    hundredths, less than `near` apart (as much below counts still).  Frames
    alike are taken in order, `apart` places from one to the next.  A run that finds too few is
    dropped; without any, the widest open run and the nearest frames are taken.
    """
    table = np.asarray(ratios, float).reshape(-1, 4)
    whole, n = (table * 100).astype(np.int64), len(table)
    begin = 0
    for k in range(n):
        if table[k, 0] < closed:
            begin = k + 1
        if k - begin + 1 < run:
            continue
        off = whole - whole[k]  # a candidate's distance
        alike = np.flatnonzero(((off > -near) & (off <= near)).all(axis=1))
        found: list[int] = []
        for j in alike[alike != k].tolist():
            if not found or j >= found[-1] + apart:
                found.append(j)
        if len(found) >= others:
            return list(range(begin, k + 1)), found[:others], False
        begin = k + 1
    if n < run + others:
        return [], [], True
    sums = np.concatenate(([0.0], np.cumsum(table[:, 0])))
    begin = int(np.argmax(np.round(sums[run:] - sums[:-run], 12)))
    local = list(range(begin, begin + run))
    order = [j for j in np.argsort(np.abs(table - table[local[-1]]).sum(axis=1), kind="stable").tolist() if j not in local]
    found = []
    for j in order:
        if len(found) < others and all(abs(j - f) >= apart for f in found):
            found.append(j)
    found += [j for j in order if j not in found][: others - len(found)]
    return local, found, True


def picked(df: DataFrame, key: str, frame: str, ratios: str) -> DataFrame:
    """key, local and similar frames and fallback, of each sample's frames in order."""

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(frame)
        local, similar, fallback = pick_frames(rows[ratios].tolist())
        at = rows[frame].to_numpy()
        return pd.DataFrame({key: [name[0]], "local": [at[local].tolist()], "similar": [at[similar].tolist()], "fallback": [fallback]})

    return df.groupBy(key).applyInPandas(run, f"{key} long, local array<long>, similar array<long>, fallback boolean")


def tracked(df: DataFrame, key: str, frame: str, faces: str, x: str, y: str, w: str, h: str, width: str, height: str, least: float, jump: float = 0.6) -> DataFrame:
    """`df` with valid and reason: one face, in bounds, and continuous with the face of the frame before if that was in bounds.

    A frame without exactly one face in bounds makes the track forget.
    """
    fits = F.coalesce((F.least(w, h) >= least) & (F.col(x) >= 0) & (F.col(y) >= 0) & (F.col(x) + F.col(w) <= F.col(width)) & (F.col(y) + F.col(h) <= F.col(height)), F.lit(False))
    one = F.coalesce(F.col(faces) == 1, F.lit(False))
    box = F.when(one & fits, F.struct((F.col(x) + F.col(w) / 2).alias("x"), (F.col(y) + F.col(h) / 2).alias("y"), F.col(w).alias("w")))
    before = F.lag("_box").over(Window.partitionBy(key).orderBy(frame))
    out = df.withColumn("_box", box).withColumn("_last", before)
    moved = F.sqrt(F.pow(F.col(x) + F.col(w) / 2 - F.col("_last.x"), 2) + F.pow(F.col(y) + F.col(h) / 2 - F.col("_last.y"), 2))
    steady = F.col("_last").isNull() | ((moved < F.greatest(w, h) * jump) & (F.col(w) / F.col("_last.w") > 0.5) & (F.col(w) / F.col("_last.w") < 2))
    good = one & fits & F.coalesce(steady, F.lit(False))
    reason = F.when(F.coalesce(F.col(faces), F.lit(0)) == 0, "no_face").when(~one, "multiple_faces").when(good, "ok").otherwise("face_geometry_or_track_jump")
    return out.withColumns({"valid": good, "reason": reason}).drop("_box", "_last")
