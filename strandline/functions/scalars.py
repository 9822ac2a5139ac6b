"""Scalar functions, all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def video_id(url: Column) -> Column:
    """The 11-character id in the usual shapes of a video link, or null."""
    found = F.regexp_extract(F.trim(url), r"(?:v=|/(?:shorts|embed|live|v)/|youtu\.be/|^)([A-Za-z0-9_-]{11})(?:[?&#/]|$)", 1)
    return F.when(found != "", found)


def classify_link(url: Column) -> Column:
    """video, playlist, channel or other, by the link's shape."""
    u = F.lower(F.trim(url))
    return (
        F.when(u.rlike(r"[?&]list=") & ~u.rlike(r"[?&]v="), "playlist")
        .when(u.rlike(r"/(channel|c|user)/|/@"), "channel")
        .when(video_id(url).isNotNull(), "video")
        .otherwise("other")
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def path_head(url: Column) -> Column:
    """The first part of a link's path."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([^/?#]*)", 1)


def estimate_mb(size: Column, bitrate: Column, seconds: Column, gb_per_hour: float = 0.5) -> Column:
    """File size in MB from the size, else the bitrate (kbit/s), else a rate by hour; one decimal."""
    return F.round(F.coalesce(size / 1e6, bitrate * seconds / 8 / 1000, seconds / 3600 * gb_per_hour * 1000), 1)


def target(task: str, label: Column, visual: Column, audio: Column, mismatch: Column) -> Column:
    """Binary target of a task; null flags count as 0."""
    if task == "mismatch":
        return F.when(F.coalesce(F.size(mismatch), F.lit(0)) > 0, 1).otherwise(0)
    return F.coalesce({"ai": label, "visual": visual, "audio": audio}[task].cast("int"), F.lit(0))


def condition(diagnostic: Column, sham: Column, label: Column, generator: Column, mode: Column) -> Column:
    return F.when(diagnostic.isNotNull(), F.concat(F.lit("diag/"), diagnostic)).when(sham, "sham").when(label == 0, "real").otherwise(F.concat_ws("/", generator, mode))


def labels(cell: Column, duration: Column, begin: Column, end: Column) -> Column:
    """Label, flags and fake intervals of a sample from its cell and span (null span: the whole)."""
    span = F.array(F.struct(F.coalesce(begin, F.lit(0.0)).alias("a"), F.coalesce(end, duration).alias("b")))
    none = F.slice(span, 1, 0)
    visual, audio = cell.isin("video", "both"), cell.isin("audio", "both")
    fake = visual | audio
    return F.struct(
        F.when(fake, 1).otherwise(0).alias("label"), visual.alias("synthetic_visual"), audio.alias("synthetic_audio"),
        F.when(fake, span).otherwise(none).alias("fake_intervals"), F.when(visual, span).otherwise(none).alias("visual_fake_intervals"), F.when(audio, span).otherwise(none).alias("audio_fake_intervals"),
    )


def glob_like(value: Column, pattern: str) -> Column:
    """Shell-style pattern (* and ?) on the whole value."""
    import re

    return value.rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$")


def effective_lag(status: Column, lag: Column) -> Column:
    """The lag where it was measured well enough, else 0; a missing status is 'unmeasured'."""
    return F.when(F.coalesce(status, F.lit("unmeasured")).isin("ok", "few"), lag).otherwise(F.lit(0))


def error_kind(message: Column) -> Column:
    """Triage of an error text by the first known part it holds; unknown errors stop the run."""
    m = F.lower(message)
    return F.when(m.contains("face"), "no_face").when(m.contains("memory"), "memory").when(m.contains("timeout"), "timeout").otherwise("stop")


def draft_gate(height: Column, fps: Column, has_audio: Column, least_height: int = 480, least_fps: float = 24.0) -> Column:
    """Whether a draft is tall and fast enough and has sound; what is unknown doesn't pass."""
    return F.coalesce((height >= least_height) & (fps >= least_fps) & has_audio, F.lit(False))


def chosen_formats(formats: Column) -> Column:
    """Of a list of formats (vcodec, acodec, width, height, language, ...; "none" or null for what one lacks) in order of preference:

    largest_side (the shorter side of the largest picture), vertical (of that
    one), video and audio (the first with a picture, and with sound), tracks
    (distinct languages, an unknown one included, of formats with sound alone; null without any).
    """
    has = lambda c: F.coalesce(c, F.lit("none")) != "none"
    side = lambda f: F.least(F.coalesce(f["width"], F.lit(0)), F.coalesce(f["height"], F.lit(0)))
    pictures = F.filter(formats, lambda f: has(f["vcodec"]))
    sounds = F.filter(formats, lambda f: ~has(f["vcodec"]) & has(f["acodec"]))
    best = F.array_max(F.transform(pictures, side))
    largest = F.get(F.filter(pictures, lambda f: side(f) == best), F.lit(0))
    audio = F.filter(formats, lambda f: has(f["acodec"]))
    return F.struct(
        best.alias("largest_side"), (F.coalesce(largest["height"], F.lit(0)) > F.coalesce(largest["width"], F.lit(0))).alias("vertical"),
        F.get(pictures, F.lit(0)).alias("video"), F.get(audio, F.lit(0)).alias("audio"),
        F.when(F.size(sounds) > 0, F.size(F.array_distinct(F.transform(sounds, lambda f: f["language"])))).alias("tracks"),
    )


def synchronised_real(label: Column, control: Column, diagnostic: Column, status: Column) -> Column:
    """A real row that is no control or diagnostic and whose sync, where reviewed, was found to match."""
    unset = lambda c: c.isNull() | (c == "")
    return F.coalesce((label == 0) & unset(control) & ~F.coalesce(diagnostic, F.lit(False)) & (F.coalesce(status, F.lit("reviewed_match")) == "reviewed_match"), F.lit(False))


def known_mismatch(label: Column, control: Column, spans: Column) -> Column:
    """The spans out of sync of a real row: none for a plain one that names none; null where they are unknown, and for others."""
    plain = control.isNull() | (control == "")
    return F.when(label == 0, F.coalesce(spans, F.when(plain, F.slice(spans, 1, 0)), F.when(plain, F.from_json(F.lit("[]"), "array<struct<a:double,b:double>>"))))


def edited_words(phrase: Column, swaps: dict[str, str], numbers: list[str], seed: Column) -> Column:
    """text and kind of a phrase (words in lower case, one space apart) after one edit, or nulls if none fits.

    The longest phrase of `swaps` that occurs is replaced where it stands
    first; else the first number, in digits, moves by a drawn step, or, in words,
    gives way to another drawn one.  Draws follow from the hash of the seed.
    """
    drawn = F.conv(F.substring(F.sha2(seed.cast("string"), 256), 1, 8), 16, 10).cast("long")
    padded = F.concat(F.lit(" "), phrase, F.lit(" "))
    text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    words = F.split(phrase, " ")
    is_number = lambda w: w.rlike("^[0-9]{1,15}$") | w.isin(*numbers)
    at = F.array_position(F.transform(words, is_number), F.lit(True)).cast("int")
    word = F.get(words, at - 1)
    steps = F.array(*[F.lit(x) for x in (-3, -2, -1, 1, 2, 3, 5, 10)])
    moved = F.abs(word.try_cast("long") + F.get(steps, F.pmod(drawn, F.lit(8)).cast("int"))).cast("string")
    others = F.array_except(F.array(*[F.lit(n) for n in numbers]), F.array(word))
    other = F.get(others, F.pmod(drawn, F.greatest(F.size(others), F.lit(1))).cast("int"))
    new = F.when(word.rlike("^[0-9]+$"), moved).otherwise(other)
    text = F.when(at > 0, F.array_join(F.concat(F.slice(words, 1, F.greatest(at - 1, F.lit(0))), F.array(new), F.slice(words, at + 1, F.size(words))), " "))
    kind = F.when(at > 0, F.lit("number"))
    for old in sorted(swaps, key=lambda x: (len(x), x)):  # the longest is asked last, so it decides
        place = F.instr(padded, f" {old} ")
        swapped = F.trim(F.concat(F.substr(padded, F.lit(1), place), F.lit(swaps[old]), F.substr(padded, place + len(old) + 1)))
        text = F.when(place > 0, swapped).otherwise(text)
        kind = F.when(place > 0, F.lit(f"swap:{old}->{swaps[old]}")).otherwise(kind)
    return F.struct(text.alias("text"), kind.alias("kind"))


def training_cost(samples: Column, batch: Column, step_s: Column, seeds: Column, train: float = 1.0, evaluate: float = 1.0) -> Column:
    """steps of an epoch, epoch_s (its steps trained once and evaluated twice, `train` and `evaluate` times a step's seconds), hours over all seeds."""
    steps = F.ceil(samples / batch).cast("long")
    epoch = steps * step_s * (train + 2 * evaluate)
    return F.struct(steps.alias("steps"), epoch.alias("epoch_s"), (epoch * seeds / 3600).alias("hours"))


def sync_verdict(decision: Column, flags: Column, status: Column, reject: tuple[str, ...] = ("bad",)) -> Column:
    """decision and flags of a clip after its video's sync status: a bad one rejects it, anything but ok adds a flag."""
    state = F.coalesce(status, F.lit("unmeasured"))
    added = F.when(state != "ok", F.concat(F.lit("sync_"), state))
    return F.struct(F.when(state.isin(*reject), "reject").otherwise(decision).alias("decision"), F.concat_ws(",", F.when(flags != "", flags), added).alias("flags"))
