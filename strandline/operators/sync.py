"""Lags between two series of a sample: distance curves, the best constant lag, onset-aligned correlation, detector trials.

A sample's series is a unit of work; samples run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.series import median_of, robust_distance, surroundings

_EPS = 1e-6


def distance_curve(video: np.ndarray, audio: np.ndarray, most: int = 15) -> np.ndarray:
    """Mean distance of each frame to the other series' frame at each offset from -most to most; zeros stand beyond its ends.

    Place i of the curve is the offset most - i of the sound.
    """
    n = min(len(video), len(audio))
    if not n:
        return np.zeros(2 * most + 1)
    v, out = video[:n], np.empty(2 * most + 1)
    for i, offset in enumerate(range(-most, most + 1)):
        other = np.zeros_like(v)
        lo, hi = max(0, -offset), min(n, n - offset)
        if lo < hi:
            other[lo:hi] = audio[lo + offset : hi + offset]
        out[i] = np.sqrt(((other - v + _EPS) ** 2).sum(axis=1)).mean()
    return out


def read_curve(curve: np.ndarray) -> tuple[int, float, float]:
    """Offset of the least distance (the first of equal ones), that distance, and the confidence: median minus least."""
    at = int(np.argmin(curve))
    return len(curve) // 2 - at, float(curve[at]), float(np.median(curve) - curve[at])


def constant_lag(a: np.ndarray, v: np.ndarray, seen: np.ndarray, most: int = 15) -> tuple[int, float]:
    """The constant lag with the largest mean cosine over the frames seen (at least one counts), the smallest of equal ones, and that mean."""
    unit = lambda x: x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    a, v, n = unit(a), unit(v), len(a)
    best, found = (0, -np.inf), max(1, int(seen.sum()))
    for lag in range(-most, most + 1):
        lo, hi = max(0, lag), min(n, n + lag)  # frames whose partner at frame - lag exists
        total = float(((a[lo:hi] * v[lo - lag : hi - lag]).sum(axis=1) * (seen[lo:hi] & seen[lo - lag : hi - lag])).sum()) if lo < hi else 0.0
        if round(total / found, 12) > best[1]:
            best = (lag, round(total / found, 12))
    return best


def onset_profiles(aperture: np.ndarray, loudness: np.ndarray, seen: np.ndarray, window: int, lags: int, quiet: int = 5) -> list[tuple[int, np.ndarray]]:
    """(frame, correlations of aperture with loudness at lags -lags..lags) at each onset of sound inside a seen run.

    An onset is above the run's median after at least `quiet` frames that are
    not.  A series without spread correlates as 0.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([False], seen, [False])).astype(np.int8)))
    out = []
    for begin, end in edges.reshape(-1, 2).tolist():
        x, y = aperture[begin:end], loudness[begin:end]
        n, reach = end - begin, window + lags
        if n < 2 * reach + quiet + 1:
            continue
        loud = y > np.median(y)
        heard = np.concatenate(([0], np.cumsum(loud)))
        at = np.arange(quiet + reach, n - reach)
        at = at[loud[at] & (heard[at] == heard[at - quiet])]
        if not len(at):
            continue
        own = x[at[:, None] + np.arange(-window, window + 1)]
        own = own - own.mean(axis=1, keepdims=True)
        table = np.zeros((len(at), 2 * lags + 1))
        for i, lag in enumerate(range(-lags, lags + 1)):
            other = y[at[:, None] + np.arange(-window, window + 1) + lag]
            other = other - other.mean(axis=1, keepdims=True)
            a, b = np.sqrt((own**2).mean(axis=1)), np.sqrt((other**2).mean(axis=1))
            ok = (a > 1e-6) & (b > 1e-6)
            table[ok, i] = (own * other).mean(axis=1)[ok] / (a * b)[ok]
        out += [(begin + int(t), row) for t, row in zip(at, table)]
    return out


def per_sample(df: DataFrame, key: str, frame: str, columns: list[str], f: Callable, schema: str) -> DataFrame:
    """Rows that f(columns as arrays, in frame order) gives for each sample, with the key in front."""

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(frame)
        series = [np.stack(rows[c].to_numpy()) if rows[c].dtype == object else rows[c].to_numpy() for c in columns]
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        return pd.DataFrame([(name[0], *r) for r in f(*series)], columns=[key, *names])

    return df.select(key, frame, *columns).groupBy(key).applyInPandas(run, f"{key} long, {schema}")


def distances(df: DataFrame, key: str, frame: str, video: str, audio: str, most: int = 15) -> DataFrame:
    """key, offset, distance, confidence of each sample."""
    return per_sample(df, key, frame, [video, audio], lambda v, a: [read_curve(distance_curve(v.astype(float), a.astype(float), most))], "offset long, distance double, confidence double")


def constant_lags(df: DataFrame, key: str, frame: str, audio: str, video: str, seen: str, most: int = 15) -> DataFrame:
    """key, lag, score of each sample."""
    return per_sample(df, key, frame, [audio, video, seen], lambda a, v, s: [constant_lag(a.astype(float), v.astype(float), s.astype(bool), most)], "lag long, score double")


def onsets(df: DataFrame, key: str, frame: str, aperture: str, loudness: str, seen: str, window: int = 12, lags: int = 5, quiet: int = 5) -> DataFrame:
    """key, onset (place in the series), profile of each sample."""
    f = lambda a, l, s: [(t, p.tolist()) for t, p in onset_profiles(a.astype(float), l.astype(float), s.astype(bool), window, lags, quiet)]
    return per_sample(df, key, frame, [aperture, loudness, seen], f, "onset long, profile array<double>")


def overlapped(values: np.ndarray, size: int, step: int, f: Callable) -> np.ndarray:
    """f over chunks of `size` frames that begin every `step`, averaged where they overlap; a chunk's weight falls toward its ends."""
    total, weight = np.zeros(len(values)), np.zeros(len(values))
    for begin in range(0, len(values), step):
        part = values[begin : begin + size]
        w = np.minimum(np.arange(1, len(part) + 1), np.arange(len(part), 0, -1)).astype(float)
        total[begin : begin + len(part)] += w * f(part)
        weight[begin : begin + len(part)] += w
        if begin + size >= len(values):
            break
    return total / np.maximum(weight, 1e-12)


def best_span(level: np.ndarray, below: float, least: int, target: float, room: int) -> tuple[int, int] | None:
    """(begin, end) of the stretch of sound nearest to `target` frames, the longer and then the earlier of equal ones, of at most `room`; or None.

    It begins after a pause or at the start, and ends before a pause.  A pause
    is a run of at least `least` frames (fewer at either end of the series)
    that are not above the loudest minus `below`.
    """
    n = len(level)
    if not n:
        return None
    loud = level > level.max() - below
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ~loud, [False])).astype(np.int8))).reshape(-1, 2)
    pauses = edges[(edges[:, 1] - edges[:, 0] >= least) | (edges[:, 0] == 0) | (edges[:, 1] == n)]
    begins = np.concatenate(([0] if loud[0] else [], pauses[pauses[:, 1] < n, 1])).astype(np.int64)
    ends = pauses[pauses[:, 0] > 0, 0]
    best = None
    for o in begins.tolist():  # the nearest end on either side of the target decides, so no pairs are made
        last = int(np.searchsorted(ends, o + room, side="right"))
        at = int(np.searchsorted(ends, o + target))
        for i in (min(at, last - 1), min(at, last) - 1):
            if 0 <= i < last and ends[i] > o:
                here = (abs(int(ends[i]) - o - target), o - int(ends[i]), o)
                best = min(best or here, here)
    return None if best is None else (best[2], best[2] - best[1])


def best_spans(df: DataFrame, key: str, frame: str, level: str, below: float, least: int, target: float, room: int) -> DataFrame:
    """key, onset, stop of each sample that has such a stretch."""

    def find(values: np.ndarray) -> list[tuple]:
        found = best_span(values.astype(float), below, least, target, room)
        return [] if found is None else [found]

    return per_sample(df, key, frame, [level], find, "onset long, stop long")


def mel_energies(samples: np.ndarray, rate: int = 16_000, width: int = 400, step: int = 160, size: int = 512, bands: int = 80, low: float = 20.0) -> np.ndarray:
    """Log energies of each frame in bands even on the mel scale (1127 ln(1 + f / 700)); the mean is taken off, high tones are raised, and the window is Hamming's.  Too short a sound has no frames."""
    if len(samples) < width:
        return np.empty((0, bands))
    mel = lambda f: 1127.0 * np.log1p(np.asarray(f, float) / 700.0)
    edges = np.linspace(mel(low), mel(rate / 2), bands + 2)
    place = mel(np.arange(size // 2 + 1) * rate / size)
    rise = (place - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - place) / (edges[2:] - edges[1:-1])[:, None]
    banks = np.clip(np.minimum(rise, fall), 0.0, None)
    banks[:, -1] = 0.0
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float) * 32768.0, width)[::step]
    x = x - x.mean(axis=1, keepdims=True)
    x = x - 0.97 * np.concatenate((x[:, :1], x[:, :-1]), axis=1)
    power = np.abs(np.fft.rfft(x * np.hamming(width), n=size, axis=1)) ** 2
    return np.log(np.maximum(power @ banks.T, np.finfo(np.float32).eps))


def mel_bands(df: DataFrame, key: str, samples: str) -> DataFrame:
    """key, frame, energies of each sound (a row with its samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body in zip(batch[key], batch[samples]):
                rows = mel_energies(np.asarray(body, float))
                yield pd.DataFrame({key: name, "frame": np.arange(len(rows)), "energies": list(rows)})

    return df.select(F.col(key).cast("long").alias(key), samples).mapInPandas(run, f"{key} long, frame long, energies array<double>")


@dataclass(frozen=True)
class JumpRules:
    """Thresholds of the jump detector (fixed values, in eye distances, multiples of the background, and robust deviations)."""

    context: int = 25
    least: float = 0.06
    ratio: float = 6.0
    calm: float = 3.0
    appearance: float = 6.0
    audio: float = 5.0
    pause: int = 3


def jumps(motion: np.ndarray, appearance: np.ndarray, audio: np.ndarray | None = None, rules: JumpRules = JumpRules()) -> list[tuple[int, str]]:
    """(frame, level) of cuts inside a series of changes from frame to frame; the first frame has no change and counts nowhere.

    A spike of motion stands `ratio` times above its background (the context
    without two frames each side) and by calm frames.  With a jump in
    appearance or sound (of this frame or one beside it) it is confident;
    alone, or where both jump without it, suspect.  Within `pause` frames of a
    mark no other is made.
    """
    n = len(motion)
    if n < 2:
        return []
    known = lambda x: np.concatenate(([np.nan], np.asarray(x, float)[1:n]))
    m = known(motion)
    base = np.fmax(median_of(surroundings(m, rules.context, 2), 0.0), rules.least / rules.ratio)
    beside = np.nan_to_num(surroundings(m, 2, 0), nan=-np.inf).max(axis=1)
    spike = (m >= np.maximum(rules.least, rules.ratio * base)) & (beside <= rules.calm * base)
    seen = robust_distance(known(appearance), rules.context) >= rules.appearance
    heard = np.zeros(n, bool)
    if audio is not None and len(audio):
        heard = np.fmax.reduce([robust_distance(known(audio), rules.context, shift=d) for d in (-1, 0, 1)]) >= rules.audio
    confident, suspect, out = spike & (seen | heard), spike | (seen & heard), []
    for t in np.flatnonzero(suspect[1:]).tolist():
        if not out or t + 1 - out[-1][0] > rules.pause:
            out.append((t + 1, "confident" if confident[t + 1] else "suspect"))
    return out


def jump_marks(df: DataFrame, key: str, frame: str, motion: str, appearance: str, audio: str | None = None, rules: JumpRules = JumpRules()) -> DataFrame:
    """key, jump (place in the series), level of each sample."""
    columns = [motion, appearance] + ([audio] if audio else [])
    return per_sample(df, key, frame, columns, lambda *x: jumps(*x, rules=rules), "jump long, level string")


def deletion_trials(df: DataFrame, key: str, frame: str, value: str, detect: Callable, trials: int = 40, seed: int = 0, fps: int = 25, seconds: tuple[float, float] = (4.0, 7.0), gaps: tuple[float, float] = (0.2, 3.0), near: float = 0.12) -> DataFrame:
    """Try a jump detector on each series: half of the trials leave a stretch whole, half delete one inside it.

    detect(values) gives the seconds of jumps.  Columns key, trial, gap (null
    where nothing was deleted), bucket, found (jumps), hit (one within `near`
    of the cut).  Series too short for the longest stretch and gap give none.
    """

    def trial(values: np.ndarray, key_: int) -> Iterator[tuple]:
        if len(values) < (seconds[1] + gaps[1] + 0.2) * fps:
            return
        rng = np.random.default_rng([seed, abs(int(key_))])
        for i in range(trials):
            length, gap = int(rng.uniform(*seconds) * fps), int(rng.uniform(*gaps) * fps) if i % 2 else 0
            begin = int(rng.integers(0, len(values) - length - gap))
            cut = int(rng.integers(fps, length - fps))
            body = values[begin : begin + length + gap]
            found = detect(np.concatenate((body[:cut], body[cut + gap :])) if gap else body)
            bucket = None if not gap else "<0.5s" if gap < 0.5 * fps else "0.5-1.5s" if gap < 1.5 * fps else ">=1.5s"
            yield i, gap if gap else None, bucket, len(found), bool(gap) and any(abs(t - cut / fps) <= near for t in found)

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(frame)[value].to_numpy(float)
        out = pd.DataFrame([(name[0], *r) for r in trial(values, name[0])], columns=[key, "trial", "gap", "bucket", "found", "hit"])
        return out.astype({"gap": "Int64"})

    return df.select(key, frame, value).groupBy(key).applyInPandas(run, f"{key} long, trial long, gap long, bucket string, found long, hit boolean")
