"""The full lag window: offsets that the window of five lags can't hold."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import series as S
from strandline.plans import temporal


@pytest.mark.parametrize("offset", [-15, -9, 6, 15])
def test_full_window_finds_far_offsets(spark, monkeypatch, offset):
    rng = random.Random(offset)
    values = [rng.uniform(0, 100) for _ in range(80)]
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "sample_id long, frame long, value double")
    monkeypatch.setattr(temporal, "frames", lambda spark, d: frames)
    monkeypatch.setattr(F, "lag", lambda c, n, real=F.lag: real(c, offset) if n == 2 else real(c, n))
    got = temporal.ts8_full(spark, "").first()
    assert got["lag"] == offset
    assert temporal.ts8(spark, "").first()["lag"] != offset


def test_peak_is_over_31_lags(spark):
    a = spark.createDataFrame([(1, i, float(i % 7)) for i in range(60)], "k long, f long, x double")
    assert S.lag_profile(a, a.withColumnRenamed("x", "y"), "k", "f", "x", "y", 15, 10).count() == 31
