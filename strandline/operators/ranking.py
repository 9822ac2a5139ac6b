"""Ranking, classification and threshold metrics with exact tie handling.

Every metric starts from one aggregate to distinct scores, so the running sums
work on that smaller table; without grouping columns they are carried over
score ranges rather than in a single task.  Scores that are null or NaN take no
part.  Where a class is missing a metric is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

_WHOLE = 200_000


def usable(score: str) -> Column:
    return F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Add inclusive running sums (new name -> column) over distinct values of `order` within groups.

    Without groups, and beyond _WHOLE rows, rows are dealt into ranges and each
    range starts from the sums of those before it, which are one row a range.
    """
    key = F.desc(order) if descending else F.asc(order)
    if by or df.limit(_WHOLE + 1).count() <= _WHOLE:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    dealt = materialize(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "running")
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "_range").withColumns({n: F.sum(c).over(w) + F.col(f"_b_{n}") for n, c in sums.items()})
    return out.drop("_range", *[f"_b_{n}" for n in sums])


def highest_after(df: DataFrame, order: str, value: str, name: str = "_top") -> DataFrame:
    """`df` with the largest value at a row or at rows that come after it in descending order, over distinct values of `order`.

    Beyond _WHOLE rows, rows are dealt into ranges, and each takes the largest value of the ranges after it, which are one row a range.
    """
    if df.limit(_WHOLE + 1).count() <= _WHOLE:
        return df.withColumn(name, F.max(value).over(Window.orderBy(F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = materialize(df.repartitionByRange(F.asc(order)).withColumn("_range", F.spark_partition_id()), "highest")
    tops = dealt.groupBy("_range").agg(F.max(value).alias("_m"))
    tops = tops.select("_range", F.max("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max(value).over(Window.partitionBy("_range").orderBy(F.asc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(tops), "_range").withColumn(name, F.greatest(inside, "_before")).drop("_range", "_before")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with rows numbered from 1 in a total order; beyond _WHOLE rows in ranges, one count of which is carried on."""
    if df.limit(_WHOLE + 1).count() <= _WHOLE:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(counts), "_range").withColumn(name, (inside + F.col("_before")).cast("long")).drop("_range", "_before")


def by_score(df: DataFrame, by: list[str], label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """One row for each group and distinct score: pos, neg (sums of weight, or counts)."""
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("long")
    return df.filter(usable(score)).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg")
    )


def auc(df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """ROC-AUC with half credit for ties, weighted or not; columns by..., auc, positives, negatives."""
    by = list(by)
    table = running(by_score(df, by, label, score, weight), by, "score", {"upto": "neg"})
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return table.groupBy(*by).agg(F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def curve(df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Running true and false positives at each distinct score, highest first: tp, fp, and the totals p, n."""
    by = list(by)
    table = running(by_score(df, by, label, score), by, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    totals = table.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return table.join(totals, by) if by else table.crossJoin(F.broadcast(totals))  # one row


def average_precision(df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision; null without positives."""
    by = list(by)
    table = curve(df, by, label, score)
    gain = F.col("pos") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return table.groupBy(*by).agg(F.sum(F.when(F.col("p") > 0, gain)).alias("ap"))


def equal_error_rate(df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Mean of false positive and false negative rate at the first point, from the top, where they are closest.

    Points of the curve include its origin; inner points on a straight stretch
    (both counts' second differences are 0) are left out, as public ROC code does.
    """
    by = list(by)
    table = curve(df, by, label, score).select(*by, "score", "tp", "fp", "p", "n")
    origin = table.groupBy(*by).agg(F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.first("p").alias("p"), F.first("n").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    table = table.unionByName(origin)
    bend = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    table = table.withColumn("straight", F.coalesce((bend("tp") == 0) & (bend("fp") == 0), F.lit(False))).filter("NOT straight AND p > 0 AND n > 0")
    fpr, fnr = F.col("fp") / F.col("n"), 1 - F.col("tp") / F.col("p")
    best = F.min_by(F.struct(((fpr + fnr) / 2).alias("eer"), F.col("score").alias("at")), F.struct(F.abs(fpr - fnr), -F.col("score")))
    return table.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.eer").alias("eer"), F.col("b.at").alias("threshold"))


def best_f1_threshold(df: DataFrame, by: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """The score t with the best F1 of `score >= t`; of equal F1 the highest t."""
    by = list(by)
    f1 = 2 * F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("p") + F.col("fp"))
    best = F.max_by(F.struct(F.col("score").alias("threshold"), f1.alias("f1")), F.struct(f1, F.col("score")))
    return curve(df, by, label, score).groupBy(*by).agg(best.alias("b")).select(*by, "b.threshold", "b.f1")


def at_threshold(df: DataFrame, threshold: Column, by: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts of `score >= threshold` and the rates made of them; a zero denominator counts as 1."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    out = df.filter(usable(score)).groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")
    )
    part = lambda a, b: F.col(a) / F.greatest(F.lit(1), b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = part("tp", tp + fn), part("tn", tn + fp)
    return out.withColumns({
        "precision": part("tp", tp + fp), "recall": recall, "f1": 2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn), "fpr": part("fp", fp + tn), "fnr": part("fn", fn + tp),
        "accuracy": (tp + tn) / F.greatest(F.lit(1), tp + fp + fn + tn), "balanced_accuracy": (recall + specificity) / 2,
    })


def operating_points(validation: DataFrame, test: DataFrame, rates=(0.01, 0.05, 0.1), base_rates=(0.001, 0.01, 0.1), label: str = "label", score: str = "score") -> DataFrame:
    """Thresholds at quantiles of the validation negatives, and what a strict `score > threshold` gives on the test rows.

    Precision is restated for base rates; alarms are per 1000 inputs.
    """
    negatives = validation.filter(usable(score) & (F.col(label) == 0))
    marks = negatives.agg(*[F.percentile(score, F.lit(1 - r)).alias(f"t{i}") for i, r in enumerate(rates)])
    stacked = marks.select(F.explode(F.array(*[F.struct(F.lit(float(r)).alias("target_fpr"), F.col(f"t{i}").alias("threshold")) for i, r in enumerate(rates)])).alias("m")).select("m.*")
    hit, pos = F.col(score) > F.col("threshold"), F.col(label) == 1
    rated = test.filter(usable(score)).crossJoin(F.broadcast(stacked)).groupBy("target_fpr", "threshold").agg(
        (F.count_if(hit & pos) / F.greatest(F.lit(1), F.count_if(pos))).alias("recall"), (F.count_if(hit & ~pos) / F.greatest(F.lit(1), F.count_if(~pos))).alias("fpr")
    )
    bases = F.explode(F.array(*[F.lit(float(b)) for b in base_rates]))
    rated = rated.withColumn("base_rate", bases)
    caught, alarms = F.col("base_rate") * F.col("recall"), (1 - F.col("base_rate")) * F.col("fpr")
    return rated.withColumn("precision", F.when(caught + alarms > 0, caught / (caught + alarms))).withColumn("false_alarms_per_1000", 1000 * alarms)


def search_threshold(df: DataFrame, label: str = "label", score: str = "score", limit: int = 1001) -> DataFrame:
    """The threshold in [0, 1] with the best F1, then the lowest false positive rate, then the highest value.

    Candidates are 0.5, the scores, and the next value above each; beyond
    `limit` candidates, as many evenly spaced quantiles of them.
    """
    counts = by_score(df, [], label, score)
    above = F.col("score") + F.greatest(F.abs("score") * 2.0**-52, F.lit(2.0**-60))  # stands for the next double
    candidate = counts.select(F.explode(F.array("score", above)).alias("c")).unionByName(df.sparkSession.createDataFrame([(0.5,)], "c double"))
    candidate = candidate.filter("c >= 0 AND c <= 1").distinct()
    n = candidate.limit(limit + 1).count()
    if n > limit:
        grid = [i / (limit - 1) for i in range(limit)]
        candidate = candidate.agg(F.percentile("c", F.array(*[F.lit(g) for g in grid])).alias("q")).select(F.explode("q").alias("c")).distinct()
    marks = counts.select(F.col("score").alias("v"), "pos", "neg", F.lit(0).alias("asked")).unionByName(candidate.select(F.col("c").alias("v"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(1).alias("asked")))
    per = marks.groupBy("v").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("asked").alias("asked"))
    per = running(per, [], "v", {"tp": "pos", "fp": "neg"}, descending=True)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    per = per.filter("asked = 1").crossJoin(F.broadcast(totals))
    f1 = 2 * F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("p") + F.col("fp"))
    fpr = F.col("fp") / F.greatest(F.lit(1), F.col("n"))
    best = F.max_by(F.struct(F.col("v").alias("threshold"), f1.alias("f1"), fpr.alias("fpr")), F.struct(f1, -fpr, F.col("v")))
    return per.agg(best.alias("b")).select("b.*")


def breakdown(df: DataFrame, dims: list[str], reference: Column, label: str = "label", score: str = "score") -> DataFrame:
    """AUC of each group of positives, along each dimension, against one set of reference rows: dim, value, auc, positives."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims]))
    positives = df.filter(F.col(label) == 1).withColumn("g", stacked).select("g.dim", "g.value", F.col(score).alias("score"))
    pos = positives.filter(usable("score")).groupBy("dim", "value", "score").agg(F.count("*").alias("pos"))
    groups = pos.select("dim", "value").distinct()
    neg = df.filter(reference & usable(score)).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("neg"))
    rows = pos.withColumn("neg", F.lit(0).cast("long")).unionByName(neg.crossJoin(F.broadcast(groups)).select("dim", "value", "score", F.lit(0).cast("long").alias("pos"), "neg"))
    rows = rows.groupBy("dim", "value", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = running(rows, ["dim", "value"], "score", {"upto": "neg"})
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return table.groupBy("dim", "value").agg(F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc"), F.sum("pos").alias("positives"))


def reference_norm(df: DataFrame, group: list[str], order: str, count: int, clip: str, score: str = "score", real: Column | None = None) -> DataFrame:
    """Scores as distances from each group's first `count` reference reals, in their deviations (plus 1e-3).

    The references, and everything from the same source clips, are left out;
    rows whose group has no reference too.  Adds z.
    """
    real = F.col("cell") == "real" if real is None else real
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    refs = df.filter(real & usable(score)).withColumn("_nth", nth).filter(F.col("_nth") <= count)
    stats = refs.groupBy(*group).agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_std"))
    used = refs.select(*group, clip).distinct()
    return df.join(stats, group).join(used, [*group, clip], "left_anti").withColumn("z", (F.col(score) - F.col("_mean")) / (F.col("_std") + 1e-3)).drop("_mean", "_std")


def zscore(df: DataFrame, basis: DataFrame, score: str = "score", by: list[str] = ()) -> DataFrame:
    """Scores in population deviations (plus 1e-6) from the mean of the basis rows."""
    by = list(by)
    stats = basis.filter(usable(score)).groupBy(*by).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    joined = df.join(F.broadcast(stats), by) if by else df.crossJoin(F.broadcast(stats))
    return joined.withColumn("z", (F.col(score) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def weights_by_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """One row a group: items, weight 1 / distinct items; null weights if all groups have as many."""
    n = df.groupBy(group).agg(F.countDistinct(item).alias("items"))
    kinds = n.agg((F.max("items") == F.min("items")).alias("_same"))
    return n.crossJoin(F.broadcast(kinds)).withColumn("weight", F.when(~F.col("_same"), 1.0 / F.col("items"))).drop("_same")


def confusion_by(df: DataFrame, dims: list[str], threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """dim, value, confusion counts and rates at a threshold of each group's positives against all negatives, which are counted once."""
    hit = F.col(score) >= threshold
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims]))
    fakes = df.filter(F.col(label) == 1).select(pairs.alias("g"), hit.alias("_h")).groupBy("g.dim", "g.value").agg(F.count_if("_h").alias("tp"), F.count_if(~F.col("_h")).alias("fn"))
    reals = df.filter(F.col(label) == 0).agg(F.count_if(hit).alias("fp"), F.count_if(~hit).alias("tn"))
    share = lambda a, *all_: a / F.greatest(F.lit(1), sum(all_[1:], all_[0]))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = fakes.crossJoin(F.broadcast(reals))  # one row
    return out.withColumns({"recall": share(tp, tp, fn), "precision": share(tp, tp, fp), "false_alarm": share(fp, fp, tn), "accuracy": share(tp + tn, tp, fn, fp, tn)})


def flattened(df: DataFrame, keys: list[str], report: str, levels: list[str]) -> DataFrame:
    """A table of keys, one column for each level of nested maps, and value."""
    out = df.select(*keys, F.col(report).alias("value"))
    for at, level in enumerate(levels):
        out = out.select(*keys, *levels[:at], F.explode("value").alias(level, "value"))
    return out


def extracts(df: DataFrame, key: str, threshold: float, label: str = "label", score: str = "score", bins: int = 20) -> DataFrame:
    """kind, x, y for a report: points of roc and pr, histogram bins, confusion (x: 2 * label + predicted), first example of each label."""
    k = curve(df, [], label, score)
    d = lambda kind, x, y: [F.lit(kind).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y")]
    parts = [k.select(*d("roc", F.col("fp") / F.col("n"), F.col("tp") / F.col("p"))), k.select(*d("pr", F.col("tp") / F.col("p"), F.col("tp") / (F.col("tp") + F.col("fp"))))]
    rows = df.filter(usable(score))
    box, cell = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)), F.col(label) * 2 + (F.col(score) >= threshold).cast("int")
    for kind, of in (("bin", box), ("confusion", cell)):
        parts.append(rows.groupBy(of.alias("_x")).agg(F.count("*").alias("_y")).select(*d(kind, F.col("_x"), F.col("_y"))))
    parts.append(rows.groupBy(F.col(label).alias("_x")).agg(F.min(key).alias("_y")).select(*d("example", F.col("_x"), F.col("_y"))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
