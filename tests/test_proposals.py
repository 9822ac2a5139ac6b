"""Multi-level proposals and the detection metrics that read them, against plain Python."""

import random

import numpy as np
import pytest

from strandline.operators import segmentation as C

LEVELS = (50, 60, 70, 80, 90, 95)


def overlap(p, q):
    inter = max(0, min(p[1], q[1]) - max(p[0], q[0]))
    return inter / (p[1] - p[0] + q[1] - q[0] - inter)


def plain_proposals(scores):
    found = []
    for level in LEVELS:
        above = [*(scores >= np.percentile(scores, level)), False]
        start = None
        for i, x in enumerate(above):
            if x and start is None:
                start = i
            elif not x and start is not None:
                if i - start >= 2:
                    found.append((float(np.mean(scores[start:i])), start, i))
                start = None
    kept = []
    for s, a, b in sorted(found, reverse=True):
        if len(kept) < 10 and all(overlap((a, b), k[1:]) < 0.7 for k in kept):
            kept.append((s, a, b))
    return kept


@pytest.fixture(scope="module")
def series():
    rng = random.Random(8)
    walk = lambda low: np.clip(np.cumsum([rng.choice((-1, 0, 1, 2, -2)) for _ in range(60)]) / 64 + low, low - 1, None)  # noqa: E731  steps of 1/64 have exact means
    return {0: walk(0.0), 1: walk(9.0), 2: walk(-9.0), 3: np.array([0.5, 0.0, 0.5, 0.0, 0.25])}


def test_proposals(spark, series):
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k long, f long, s double")
    got = C.proposals(df, "k", "f", "s", 0.5).collect()
    for k, v in series.items():
        want = sorted((a * 0.5, b * 0.5, round(s, 9)) for s, a, b in plain_proposals(v))
        assert sorted((r["a"], r["b"], round(r["score"], 9)) for r in got if r["k"] == k) == want
    assert {r["k"] for r in got} == {0, 1, 2}  # whatever the level of the scores; no run of a single frame


def test_suppress_prefers_the_later_of_equal_scores(spark):
    props = spark.createDataFrame([(1, 0.0, 10.0, 0.5), (1, 1.0, 10.0, 0.5)], "k long, a double, b double, score double")
    assert C.suppress(props, "k", 0.7, 10).first()["a"] == 1.0


def plain_metrics(props, truth):
    total = sum(map(len, truth.values()))
    out = {}
    pool = sorted(((s, k, a, b) for k, v in props.items() for s, a, b in v), key=lambda p: -p[0])
    for threshold in (0.5, 0.75, 0.95):
        used, hits = set(), []
        for _, k, a, b in pool:
            best, at = threshold, None
            for i, span in enumerate(truth[k]):
                if (k, i) not in used and overlap((a, b), span) >= best:
                    best, at = overlap((a, b), span), (k, i)
            used.add(at)
            hits.append(at is not None)
        precision = np.cumsum(hits) / np.arange(1, len(hits) + 1)
        out[threshold] = sum(max(precision[i:]) for i, x in enumerate(hits) if x) / total
    for n in (1, 5, 10):
        out[n] = np.mean([sum(any(overlap(p[1:], s) >= x / 100 for p in props[k][:n]) for k, v in truth.items() for s in v) / total for x in range(50, 100, 5)])
    return out


def test_temporal_ap_and_recall_of_proposals(spark, monkeypatch, series):
    from strandline.plans import groups

    rows, truth = [], {}
    for k, v in series.items():
        own = (v >= np.percentile(v, 75)) | (np.arange(len(v)) % 13 < 4)
        edges = np.flatnonzero(np.diff([0, *own.astype(int), 0]))
        truth[k] = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        rows += [(k, i, float(x), "click" if y else "error") for i, (x, y) in enumerate(zip(v, own))]
    monkeypatch.setattr(groups, "frames", lambda spark, d: spark.createDataFrame(rows, "sample_id long, frame long, score double, event_type string"))
    want = plain_metrics({k: plain_proposals(v) for k, v in series.items()}, truth)
    got = groups.m17(spark, "").collect()
    assert {r["threshold"]: r["ap"] for r in got} == {x: pytest.approx(want[x], abs=1e-6) for x in (0.5, 0.75, 0.95)}
    assert {r["segments"] for r in got} == {sum(map(len, truth.values()))}
    assert 0 < want[5] < want[10]
    for n in (1, 5, 10):
        assert all(r[f"ar_{n}"] == pytest.approx(want[n], abs=1e-6) for r in got)
