"""The cluster bootstrap against copied rows, and the number of replicates that the queries draw."""

import random

import numpy as np
import pytest

from strandline.operators import resample as B
from strandline.plans import registry


def pair_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_bootstrap_equals_copied_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "_CHUNK", chunk)
    rng = random.Random(1)
    rows = [(c, rng.randint(0, 1), rng.randint(0, 5) / 5, rng.random()) for c in range(6) for _ in range(rng.randint(1, 9))]
    got = {(r["name"], r["replicate"]): r["auc"] for r in B.bootstrap_auc(spark.createDataFrame(rows, "c long, label int, s double, u double"), "c", ["s", "u"], replicates=30).collect()}
    assert len(got) == 60
    drawn = np.random.default_rng(42)
    for k in range(1, 31):
        members = [r for c in drawn.integers(6, size=6) for r in rows if r[0] == c]
        for name, at in (("s", 2), ("u", 3)):
            assert got[name, k] == pytest.approx(pair_auc([(r[1], r[at]) for r in members]))


def test_every_replicate_draws_as_many_clusters_as_there_are():
    assert {int(x.sum()) for x in B.draws(3, 11, 200)} == {11}


@pytest.mark.parametrize(("name", "replicates"), [("b1_paired_delta", 1000), ("b2_auc_interval", 1000), ("b3_component_bootstrap", 1000), ("b4_clip_bootstrap", 2000)])
def test_queries_draw_all_replicates(spark, small_data, name, replicates):
    assert registry.QUERIES[name](spark, small_data).first()["replicates"] == replicates
