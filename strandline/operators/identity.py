"""Identification of clips against a registry of speakers that grows as it goes.

Each match changes the registry that the next one sees, so a registry's inputs
are worked on in order; registries run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.vectors import Centroids, cluster, dot, normalized


def voice_fits(speaker: Column, voice: Column, least: float) -> Column:
    """Whether two voices are alike; a voice that is absent on either side fits any."""
    return F.coalesce(dot(normalized(speaker), normalized(voice)) >= least, F.lit(True))


@dataclass(frozen=True)
class Rules:
    """Thresholds of identification."""

    cluster: float = 0.45
    high: float = 0.55
    low: float = 0.35
    margin: float = 0.05
    voice: float = 0.4
    outlier: float = 0.3
    voice_outlier: float = 0.2
    least_clips: int = 2


@dataclass
class Speakers:
    """The registry: sums of faces and of voices, and channels, by number."""

    width: int
    faces: Centroids = field(init=False)
    voices: dict = field(default_factory=dict)
    channels: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.faces = Centroids(self.width)

    def match(self, face: np.ndarray, voice, channels: set, rules: Rules) -> tuple[int | None, str, int | None, float | None]:
        """(speaker or None, how, suggested speaker, its cosine): a known channel first, then a clear best, else new."""
        near = self.faces.cosines(face)
        if not len(near):
            return None, "new", None, None
        known = [i for i, own in enumerate(self.channels) if own & channels]
        best = max(known, key=near.__getitem__, default=None)
        if best is not None and near[best] >= rules.high and self.heard(best, voice, rules):
            return best, "auto_channel", None, None
        best = int(np.argmax(near))
        clear = near[best] - max((x for i, x in enumerate(near.tolist()) if i != best), default=-1.0) >= rules.margin
        if near[best] >= rules.high and clear and self.heard(best, voice, rules):
            return best, "auto", None, None
        return (None, "new", best, round(float(near[best]), 3)) if near[best] >= rules.low else (None, "new", None, None)

    def heard(self, at: int, voice, rules: Rules) -> bool:
        own = self.voices.get(at)
        return own is None or voice is None or float(own @ voice) / max(1e-8, float(np.linalg.norm(own))) >= rules.voice

    def add(self, at: int | None, face: np.ndarray, voice, channels: set) -> int:
        if at is None:
            self.channels.append(set())
            at = self.faces.open(face)
        else:
            self.faces.put(at, self.faces.total[at] + face)
        self.channels[at] |= channels
        if voice is not None:
            self.voices[at] = self.voices.get(at, 0) + voice
        return at


def identify(clips: pd.DataFrame, rules: Rules, single: str = "single") -> pd.DataFrame:
    """speaker (number, or none), how, suggestion, suggestion_sim and flags of the clips (input, clip, face, voice, channel, single), input by input."""
    clips = clips.sort_values(["input", "clip"], kind="stable")
    stack = lambda rows, c: np.stack(rows[c].to_numpy()).astype(float)
    unit = lambda x: x / np.maximum(1e-8, np.linalg.norm(x, axis=-1, keepdims=True))
    speakers, out = Speakers(len(clips["face"].iloc[0])), []
    for _, rows in clips.groupby("input", sort=True):
        label = np.zeros(len(rows), int) if rows[single].all() else cluster(stack(rows, "face"), rules.cluster)
        for k in range(label.max() + 1):
            part = rows[label == k]
            faces = unit(stack(part, "face"))
            face, total = unit(faces.sum(axis=0)), faces.sum(axis=0)
            heard = part[part["voice"].notna()]
            said = unit(stack(heard, "voice")) if len(heard) else None
            voice = unit(said.sum(axis=0)) if said is not None else None
            channels = {c for c in part["channel"] if c is not None and c == c}
            at, how, hint, sim = speakers.match(face, voice, channels, rules)
            if at is None and len(part) < rules.least_clips:
                out += [(c, None, "unassigned", None, None, "") for c in part["clip"]]
                continue
            at = speakers.add(at, total, None if said is None else said.sum(axis=0), channels)
            for c, own, v in zip(part["clip"], faces, part["voice"]):
                flags = ["face_outlier"] if own @ face < rules.outlier else []
                if v is not None and voice is not None and unit(np.asarray(v, float)) @ voice < rules.voice_outlier:
                    flags.append("voice_outlier")
                out.append((c, at, how, hint, sim, ",".join(flags)))
    return pd.DataFrame(out, columns=["clip", "speaker", "how", "suggestion", "suggestion_sim", "flags"])


def identify_batch(df: DataFrame, registry: str, clip: str, input_: str, face: str, voice: Column | None = None, channel: Column | None = None, single: Column | None = None, rules: Rules = Rules()) -> DataFrame:
    """registry, clip, speaker (number within the registry; null where a small cluster matched nobody), how, suggestion, suggestion_sim, flags."""
    rows = df.select(
        F.col(registry).alias("registry"), F.col(clip).cast("long").alias("clip"), F.col(input_).alias("input"), F.col(face).cast("array<double>").alias("face"),
        (F.lit(None) if voice is None else voice).cast("array<double>").alias("voice"), (F.lit(None) if channel is None else channel).cast("string").alias("channel"), (F.lit(False) if single is None else single).alias("single"),
    )

    def run(name: tuple, clips: pd.DataFrame) -> pd.DataFrame:
        found = identify(clips, rules).astype({"speaker": "Int64", "suggestion": "Int64"})
        found.insert(0, "registry", name[0])
        return found

    kind = dict(df.dtypes)[registry]
    return rows.groupBy("registry").applyInPandas(run, f"registry {kind}, clip long, speaker long, how string, suggestion long, suggestion_sim double, flags string")
