"""Packing: what finds no gap after the first sequences are full ends in few rounds, whole and in as few sequences."""

import random

from strandline.llm import packing


def test_rest_of_short_pieces_takes_few_rounds(spark, monkeypatch):
    rng, sweep, rounds = random.Random(1), packing.sweep, []
    monkeypatch.setattr(packing, "sweep", lambda state: rounds.append(1) or sweep(state))
    sizes = [rng.randint(43, 45) for _ in range(300)] + [rng.randint(6, 11) for _ in range(1500)]
    rng.shuffle(sizes)
    by, got = {}, packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long"), 100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(sizes))
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(by) <= 1.03 * -(-sum(sizes) // 100)
    assert len(rounds) <= 16
