"""The driver's memory: the models' fit makes nothing as large as its sample again, and free native memory goes back."""

import tracemalloc

import numpy as np

from strandline.llm import quality
from strandline.session import trim


def _sample(n: int):
    rng = np.random.default_rng(5)
    label = (rng.random(n) < 0.3).astype(np.int64)
    shape = rng.random((n, quality.SHAPE)) + label[:, None] * 0.1
    buckets = [np.unique(np.where(rng.random(150) < 0.2 + 0.2 * y, rng.integers(0, 400, 150), rng.integers(0, 1 << quality.HASH_BITS, 150))).astype(np.int32) for y in label]
    return shape, buckets, label


def test_fit_in_parts():
    shape, buckets, label = _sample(20_000)
    tracemalloc.start()
    model = quality.Model.fit(shape, buckets, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.telling) > 200
    assert peak < 40e6  # the whole matrix alone would have 44 MB
    x = np.zeros((len(label), 1 + quality.SHAPE + len(model.telling)))
    x[:, 0], x[:, 1 : 1 + quality.SHAPE] = 1, np.clip((shape - model.mean) / model.scale, -8, 8)
    for row, b in zip(x, buckets):
        row[1 + quality.SHAPE :] = np.isin(model.telling, b)
    p = 1 / (1 + np.exp(-x @ model.weights))
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, 0.3)]
    assert np.abs(x.T @ (p - label) + penalty * model.weights).max() < 1e-4  # the penalised likelihood is at its maximum
    assert np.allclose(model.logits(shape, buckets), x @ model.weights)


def test_native_memory_goes_back(spark):
    assert trim(spark)
