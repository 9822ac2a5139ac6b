"""Operators on small hand-made tables: ties, missing classes, nulls and the fixtures' expected results."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import contracts as Q
from strandline.operators import detection as D
from strandline.operators import graph as G
from strandline.operators import intervals as I
from strandline.operators import ranking as R
from strandline.operators import segmentation as C
from strandline.operators import selection as S
from strandline.operators import series as T


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 1), rng.randint(0, 6) / 7) for g in range(6) for _ in range(40)] + [(9, 1, 0.5), (9, 1, 0.2)]
    got = {r["g"]: r["auc"] for r in R.auc(spark.createDataFrame(rows, "g long, label int, score double"), ["g"]).collect()}
    for g in got:
        want = brute_auc([(y, s) for k, y, s in rows if k == g])
        assert got[g] == pytest.approx(want) if want is not None else got[g] is None


def test_best_f1_is_exhaustive(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(50)]
        total = sum(y for y, _ in rows)
        best = max((2 * sum(y for y, s in rows if s >= t) / max(1, sum(y for y, s in rows if s >= t) + total + sum(1 - y for y, s in rows if s >= t)), t) for t in {s for _, s in rows})
        got = R.best_f1_threshold(spark.createDataFrame(rows, "label int, score double")).first()
        assert (got["f1"], got["threshold"]) == (pytest.approx(best[0]), best[1])


def test_nan_scores_take_no_part(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (0, None)], "label int, score double")
    assert R.auc(df).first()["auc"] == 1.0


def test_speaker_weights_null_when_equal(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "s long, c long")
    assert {r["weight"] for r in R.weights_by_group(df, "s", "c").collect()} == {None}


def test_coalesce_spans(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 3.0, 4.0), (1, 3.5, 3.6)], "k long, a double, b double")
    assert sorted((r["a"], r["b"]) for r in I.coalesce_spans(df, ["k"]).collect()) == [(0.0, 2.0), (3.0, 4.0)]


def test_cell_targets_unknown_and_short(spark):
    schema = "k long, spans array<struct<a:double,b:double>>, d double"
    df = spark.createDataFrame([(1, None, 0.4), (2, [(0.05, 0.1)], 0.4), (3, [], 0.4)], schema)
    got = {(r["k"], r["cell"]): r["target"] for r in I.cell_targets(df, "k", "spans", "d", 0.2).collect()}
    assert got[1, 0] == got[1, 1] == -1.0 and got[2, 0] == pytest.approx(0.25) and got[3, 0] == 0.0


def test_mask_to_spans(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, True)], "k long, f long, m boolean")
    out = I.mask_to_spans(df, "k", "f", F.col("m"), 0.2, F.lit(1.0), F.lit(0.7)).collect()
    assert sorted((round(r["a"], 3), round(r["b"], 3)) for r in out) == [(0.0, 0.2), (0.4, 0.7)]


def test_fill_gaps(spark):
    df = spark.createDataFrame(list(enumerate([None, 1.0, None, None, 4.0, None])), "f long, v double").withColumn("k", F.lit(1))
    assert [r["filled"] for r in T.fill_gaps(df, "k", "f", "v").orderBy("f").collect()] == [1, 1, 2, 3, 4, 4]


def test_refractory(spark):
    df = spark.createDataFrame([(1, f) for f in (1, 2, 5, 6, 8)], "k long, f long")
    assert [r["f"] for r in T.refractory(df, "k", "f", F.lit(True), 3).orderBy("f").collect()] == [1, 5, 8]


@pytest.mark.parametrize("n", [60, 175, 176, 400, 1500])
def test_windows_cover_every_frame(spark, n):
    w = I.fixed_windows(spark.createDataFrame([(1, n)], "k long, n long"), "k", "n", 175, 88).collect()
    assert {f for r in w for f in range(r["start"], r["stop"])} == set(range(n)) and all(r["stop"] - r["start"] <= 175 for r in w)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), (12, 11), (20, 1)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 10: 10, 11: 10, 12: 10, 7: 7, **dict.fromkeys(range(100, 160), 100)}


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    got = G.connected_components(spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(i, 0) for i in range(n)}


def test_components_of_nothing(spark):
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_allot_balances_and_keeps_locks():
    out = G.allot([(i, 2) for i in range(100)], {"train": 0.6, "validation": 0.15, "test": 0.25}, {0: "test"})
    share = {s: sum(v == s for v in out.values()) for s in ("train", "validation", "test")}
    assert out[0] == "test" and share == {"train": 60, "validation": 15, "test": 25}


def test_apportion_sums_to_total(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 2)], "g long, k string, w long").withColumn("t", F.lit(10))
    got = {r["k"]: r["quota"] for r in S.apportion(df, ["g"], "t", "w", "k").collect()}
    assert sum(got.values()) == 10 and got["c"] == 5


def test_generators_are_used_equally(spark):
    out = S.assign_generators(spark.range(160).withColumnRenamed("id", "c"), "c", ["a", "b", "x", "y"], 2, 1).collect()
    uses = [sum(r["generator"] == g for r in out) for g in "abxy"]
    assert max(uses) - min(uses) <= 1 and len({(r["c"], r["generator"]) for r in out}) == len(out)


def test_temporal_ap(spark):
    truth = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0)], "sample_id long, a double, b double")
    props = spark.createDataFrame([(2, 0.0, 1.0, 0.99, 0), (1, 1.0, 2.0, 0.9, 0), (1, 1.0, 2.0, 0.8, 1), (1, 3.0, 4.0, 0.7, 2)], "sample_id long, a double, b double, score double, seq long")
    got = D.temporal_ap(D.match_proposals(props, truth, [0.5]), 2).first()
    assert got["matched"] == 2 and got["ap"] == pytest.approx(0.5)


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("../c", 3)], "k string, v int")
    found = Q.violations(df, "k", {"value": F.col("v") > 0, "path": Q.safe_path(F.col("k"))})
    assert {(r["k"], r["rule"]) for r in found.collect()} == {("b", "value"), ("../c", "path")}
    with pytest.raises(Q.ContractError):
        Q.enforce(found)


def test_cut_windows(spark):
    none = spark.createDataFrame([], "k long, a double, b double")
    out = C.cut_windows(spark.createDataFrame([(1, 0.0, 20.0)], none.schema), none, "k", 4.0, 7.0).orderBy("a").collect()
    assert (out[0]["a"], out[0]["b"]) == (0.0, 7.0) and all(4 - 1e-6 <= r["b"] - r["a"] <= 7 + 1e-6 for r in out)
    pauses = spark.createDataFrame([(1, 4.9, 5.1), (1, 5.8, 6.2), (1, 6.4, 6.6)], none.schema)
    assert C.cut_windows(spark.createDataFrame([(1, 0.0, 9.0)], none.schema), pauses, "k", 4.0, 7.0).orderBy("a").first()["b"] == 6.0


def test_suppress(spark):
    props = spark.createDataFrame([(1, 0.0, 1.0, 0.9), (1, 0.0, 1.1, 0.8), (1, 5.0, 6.0, 0.7)], "k long, a double, b double, score double")
    assert sorted(r["score"] for r in C.suppress(props, "k", 0.7, 10).collect()) == [0.7, 0.9]
