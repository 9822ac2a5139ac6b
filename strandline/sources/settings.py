"""Settings files with inheritance, checked options, evaluation locks, and the text of status and reports.  Driver-side helpers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from pathlib import PurePosixPath

from strandline.operators.contracts import ContractError

#: Where a fake's sound may come from (fixed values).
AUDIO_MODES = ("source", "donor")


def merged(base: Mapping, over: Mapping) -> dict:
    """`base` with the values of `over`; where both hold mappings these are merged in turn, other values replace."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def read_settings(name: str, load: Callable[[str], Mapping], parent_key: str = "extends") -> dict:
    """Settings and those they extend, the nearest last; a parent's name is relative to its child's.  A cycle raises."""
    chain: list[Mapping] = []
    seen: list[str] = []
    while name:
        if name in seen:
            raise ContractError("settings extend each other: " + " -> ".join([*seen, name]))
        seen.append(name)
        body = dict(load(name))
        parent = body.pop(parent_key, None)
        chain.append(body)
        name = str(PurePosixPath(name).parent / parent) if parent else ""
    out: dict = {}
    for body in reversed(chain):
        out = merged(out, body)
    return out


def clip_range(settings: Mapping) -> tuple[int, int]:
    """(least, most) clips a speaker may have in a part."""
    low, high = settings["min_clips_per_speaker"], settings["max_clips_per_speaker"]
    if not 0 < low <= high:
        raise ContractError("the range of clips must be 0 < least <= most")
    return low, high


def split_targets(settings: Mapping, kinds: Iterable[str]) -> dict[str, dict[str, int]]:
    """Split -> kind -> members, of settings that list the numbers in the order of the kinds."""
    kinds = list(kinds)
    if any(len(v) != len(kinds) for v in settings["split"].values()):
        raise ContractError("a split's targets need a number for each kind")
    return {name: dict(zip(kinds, numbers)) for name, numbers in settings["split"].items()}


def audio_modes(options: Mapping, split: str) -> list[str]:
    """The audio modes of a split's fakes: a non-empty choice of AUDIO_MODES without repeats; older options name one for all."""
    by_split = options.get("fake_audio_modes_by_split")
    modes = [options.get("audio_mode", AUDIO_MODES[0])] if by_split is None else list(by_split.get(split) or [])
    if not modes or sorted(set(modes)) != sorted(modes) or not set(modes) <= set(AUDIO_MODES):
        raise ContractError(f"{split}: audio modes must be a choice of {AUDIO_MODES} without repeats")
    return modes


def paired_sessions(plans: Mapping[str, str], outputs: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """(session, plan folder, output folder) of every session; those that lack either raise, all named."""
    missing = [f"{name}: no {what}" for what, there, other in (("output", outputs, plans), ("plan", plans, outputs)) for name in sorted(other) if name not in there]
    if missing:
        raise ContractError("; ".join(missing))
    return [(name, plans[name], outputs[name]) for name in sorted(plans)]


def stamp(**parts: bytes | str) -> dict[str, str]:
    """SHA-256 of each named part of an evaluation: manifest, index, checkpoints."""
    return {name: hashlib.sha256(body.encode() if isinstance(body, str) else body).hexdigest() for name, body in sorted(parts.items())}


def hold_lock(stored: str | None, now: Mapping[str, str]) -> str:
    """The text of the lock to keep: the first evaluation's stamp; a later one with another stamp is refused, with the parts that differ."""
    if stored is None:
        return json.dumps(dict(now), sort_keys=True)
    before = json.loads(stored)
    other = sorted(k for k in {*before, *now} if before.get(k) != now.get(k))
    if other:
        raise ContractError("the test set was evaluated with other " + ", ".join(other))
    return stored


def check_meta(found: Mapping, expected: Mapping, name: str = "cache") -> Mapping:
    """What was found, if every expected value is as expected; else an error with the keys that are stale."""
    other = sorted(k for k, v in expected.items() if found.get(k) != v)
    if other:
        raise ContractError(f"{name} is stale: " + ", ".join(other))
    return found


def status_text(status: Mapping[str, object], indent: int = 0) -> str:
    """A status document as aligned lines; mappings are indented, numbers have thousands marks."""
    width = max((len(str(k)) for k in status), default=0)
    lines = []
    for key, value in status.items():
        if isinstance(value, Mapping):
            lines += [" " * indent + f"{key}:", status_text(value, indent + 2)]
        else:
            shown = "-" if value is None else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else f"{value:,.2f}" if isinstance(value, float) else str(value)
            lines.append(" " * indent + f"{str(key):<{width}}  {shown}")
    return "\n".join(x for x in lines if x)


def report_text(title: str, tables: Mapping[str, list[Mapping]]) -> str:
    """A Markdown report: a heading and a table for each list of rows; missing values as a dash."""
    cell = lambda v: "–" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = [f"# {title}"]
    for name, rows in tables.items():
        columns = list(dict.fromkeys(k for r in rows for k in r))
        out += ["", f"## {name}", ""]
        out += ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)] if columns else ["No rows."]
        out += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(out) + "\n"


def gates_text(gates: Mapping[str, Mapping]) -> str:
    """Gates as JSON; numbers that JSON doesn't know become null."""
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, Mapping) else [plain(x) for x in v] if isinstance(v, list | tuple) else None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v
    return json.dumps(plain(gates), sort_keys=True, indent=1, allow_nan=False)
