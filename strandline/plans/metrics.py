"""Queries of the ranking metrics (survey 2.14 and parts of 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import ranking as R
from strandline.plans.base import SCORES_SQL, query, scores, t

r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
TEST = "split = 'test'"


def _auc_sql(rows: str, by: str = "", w: str = "1") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""d AS ({rows}), g AS (SELECT {keys}score, sum(CASE WHEN label = 1 THEN {w} ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN {w} ELSE 0 END) AS neg FROM d GROUP BY {keys}score),
    c AS (SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS UNBOUNDED PRECEDING) - neg / 2.0 AS below FROM g),
    auc AS (SELECT {keys}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round((sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE))::DOUBLE, 6) END AS auc, sum(pos) AS positives, sum(neg) AS negatives FROM c {group})"""


@query("m1_auc", f"WITH {SCORES_SQL}, {_auc_sql('SELECT * FROM scores')} SELECT auc, positives::BIGINT AS positives, negatives::BIGINT AS negatives FROM auc")
def m1(spark, d):
    return R.auc(scores(spark, d)).select(r6("auc"), "positives", "negatives")


@query("m1_auc_by_generator", f"WITH {SCORES_SQL}, {_auc_sql('SELECT * FROM scores', 'split, generator')} SELECT split, generator, auc FROM auc")
def m1b(spark, d):
    return R.auc(scores(spark, d), ["split", "generator"]).select("split", "generator", r6("auc"))


@query("m2_speaker_balanced_auc", f"""WITH {SCORES_SQL}, w AS (SELECT s.*, 1.0::DOUBLE / count(*) OVER (PARTITION BY speaker_id) AS w FROM scores s WHERE split = 'test'), {_auc_sql('SELECT * FROM w', '', 'w')} SELECT auc FROM auc""")
def m2(spark, d):
    rows = scores(spark, d).filter(TEST)
    n = rows.groupBy("speaker_id").agg((1.0 / F.count("*")).alias("w"))
    return R.auc(rows.join(n, "speaker_id"), weight="w").select(r6("auc"))


CURVE_SQL = """g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM d GROUP BY score),
  k AS (SELECT score, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("m3_equal_error_rate", f"""WITH {SCORES_SQL}, d AS (SELECT * FROM scores WHERE split = 'test'), {CURVE_SQL},
  o AS (SELECT score, tp, fp, p, n FROM k UNION ALL SELECT 'inf'::DOUBLE, 0, 0, max(p), max(n) FROM k),
  b AS (SELECT *, coalesce(lead(tp) OVER w - 2 * tp + lag(tp) OVER w = 0 AND lead(fp) OVER w - 2 * fp + lag(fp) OVER w = 0, false) AS straight FROM o WINDOW w AS (ORDER BY score DESC))
  SELECT round((fp / n + 1 - tp / p)::DOUBLE / 2, 6) AS eer FROM b WHERE NOT straight ORDER BY abs(fp::DOUBLE / n - (1 - tp::DOUBLE / p)), score DESC LIMIT 1""")
def m3(spark, d):
    return R.equal_error_rate(scores(spark, d).filter(TEST)).select(r6("eer"))


@query("w3_best_f1_threshold", f"""WITH {SCORES_SQL}, d AS (SELECT * FROM scores WHERE split = 'validation'), {CURVE_SQL}
  SELECT score AS threshold, round((2 * tp / greatest(1, tp + p + fp))::DOUBLE, 6) AS f1 FROM k ORDER BY 2 * tp::DOUBLE / greatest(1, tp + p + fp) DESC, score DESC LIMIT 1""")
def w3(spark, d):
    return R.best_f1_threshold(scores(spark, d).filter("split = 'validation'")).select("threshold", r6("f1"))


@query("w2_cumulative_counts", f"WITH {SCORES_SQL}, d AS (SELECT * FROM scores), {CURVE_SQL} SELECT score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM k")
def w2(spark, d):
    return R.curve(scores(spark, d)).select("score", "pos", "neg", "tp", "fp")


@query("m4_threshold_metrics", f"""WITH {SCORES_SQL}, c AS (SELECT split, count(*) FILTER (score >= 0.25 AND label = 1) AS tp, count(*) FILTER (score >= 0.25 AND label = 0) AS fp,
  count(*) FILTER (score < 0.25 AND label = 1) AS fn, count(*) FILTER (score < 0.25 AND label = 0) AS tn FROM scores GROUP BY split)
  SELECT split, tp, fp, fn, tn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1,
  round(fp / greatest(1, fp + tn), 6) AS fpr, round((tp + tn) / greatest(1, tp + fp + fn + tn), 6) AS accuracy, round((tp / greatest(1, tp + fn) + tn / greatest(1, tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def m4(spark, d):
    out = R.at_threshold(scores(spark, d), F.lit(0.25), ["split"])
    return out.select("split", "tp", "fp", "fn", "tn", *[r6(c) for c in ("precision", "recall", "f1", "fpr", "accuracy", "balanced_accuracy")])


@query("m5_operating_points", f"""WITH {SCORES_SQL}, m AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS target_fpr),
  q AS (SELECT target_fpr, (SELECT quantile_cont(score, 0.99) FROM scores WHERE split = 'validation' AND label = 0) AS a, (SELECT quantile_cont(score, 0.95) FROM scores WHERE split = 'validation' AND label = 0) AS b,
    (SELECT quantile_cont(score, 0.9) FROM scores WHERE split = 'validation' AND label = 0) AS c FROM m),
  th AS (SELECT target_fpr, CASE WHEN target_fpr = 0.01 THEN a WHEN target_fpr = 0.05 THEN b ELSE c END AS threshold FROM q),
  s AS (SELECT target_fpr, threshold, count(*) FILTER (score > threshold AND label = 1)::DOUBLE / greatest(1, count(*) FILTER (label = 1)) AS recall,
    count(*) FILTER (score > threshold AND label = 0)::DOUBLE / greatest(1, count(*) FILTER (label = 0)) AS fpr FROM scores, th WHERE split = 'test' GROUP BY ALL),
  b AS (SELECT *, unnest([0.001, 0.01, 0.1])::DOUBLE AS base_rate FROM s)
  SELECT target_fpr, base_rate, round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr,
    CASE WHEN base_rate * recall + (1 - base_rate) * fpr > 0 THEN round(base_rate * recall / (base_rate * recall + (1 - base_rate) * fpr), 6) END AS precision, round(1000 * (1 - base_rate) * fpr, 4) AS false_alarms_per_1000 FROM b""")
def m5(spark, d):
    s = scores(spark, d)
    out = R.operating_points(s.filter("split = 'validation'"), s.filter(TEST))
    return out.select("target_fpr", "base_rate", *[r6(c) for c in ("threshold", "recall", "fpr", "precision")], F.round("false_alarms_per_1000", 4).alias("false_alarms_per_1000"))


@query("m6_average_precision", f"""WITH {SCORES_SQL}, d AS (SELECT * FROM scores WHERE split = 'test'), {CURVE_SQL} SELECT round(sum((pos::DOUBLE / p) * (tp::DOUBLE / (tp + fp))), 6) AS ap FROM k""")
def m6(spark, d):
    return R.average_precision(scores(spark, d).filter(TEST)).select(r6("ap"))


@query("m8_breakdown", f"""WITH {SCORES_SQL}, p AS (SELECT 'cell' AS dim, cell AS value, score FROM scores WHERE label = 1 UNION ALL SELECT 'kind', kind, score FROM scores WHERE label = 1 UNION ALL SELECT 'generator', generator, score FROM scores WHERE label = 1 UNION ALL SELECT 'gender', gender, score FROM scores WHERE label = 1),
  rows AS (SELECT dim, value, score, 1 AS label FROM p UNION ALL SELECT g.dim, g.value, s.score, 0 FROM scores s, (SELECT DISTINCT dim, value FROM p) g WHERE s.cell = 'real'), {_auc_sql('SELECT * FROM rows', 'dim, value')}
  SELECT dim, value, auc, positives::BIGINT AS positives FROM auc""")
def m8(spark, d):
    out = R.breakdown(scores(spark, d), ["cell", "kind", "generator", "gender"], F.col("cell") == "real")
    return out.select("dim", "value", r6("auc"), "positives")


@query("m9_per_speaker", f"WITH {SCORES_SQL}, {_auc_sql('SELECT * FROM scores', 'speaker_id')} SELECT round(avg(auc), 5) AS mean_auc, min(auc) AS min_auc, count(auc) AS speakers FROM auc")
def m9(spark, d):
    per = R.auc(scores(spark, d), ["speaker_id"]).withColumn("auc", F.round("auc", 6))
    return per.agg(F.round(F.avg("auc"), 5).alias("mean_auc"), F.min("auc").alias("min_auc"), F.count("auc").alias("speakers"))


@query("m10_reference_norm", f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY split, speaker_id ORDER BY sample_id) AS nth FROM scores WHERE cell = 'real'),
  f AS (SELECT * FROM r WHERE nth <= 3), st AS (SELECT split, speaker_id, avg(score) AS m, stddev_pop(score) AS s FROM f GROUP BY ALL),
  z AS (SELECT s.split, s.label, round((s.score - st.m) / (st.s + 1e-3), 3) AS score FROM scores s JOIN st USING (split, speaker_id) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.split = s.split AND f.speaker_id = s.speaker_id AND f.source_clip_id = s.source_clip_id)),
  {_auc_sql('SELECT * FROM z', 'split')} SELECT split, round(auc, 3) AS auc, (positives + negatives)::BIGINT AS samples FROM auc""")
def m10(spark, d):
    z = R.reference_norm(scores(spark, d), ["split", "speaker_id"], "sample_id", 3, "source_clip_id")
    z = z.withColumn("z", F.round("z", 3))
    return R.auc(z, ["split"], score="z").select("split", F.round("auc", 3).alias("auc"), (F.col("positives") + F.col("negatives")).alias("samples"))


@query("m11_fpr_by_cell", f"WITH {SCORES_SQL} SELECT cell, round(avg(CASE WHEN score >= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS fpr, count(*) AS samples FROM scores WHERE cell IN ('real', 'sham') GROUP BY cell")
def m11(spark, d):
    return scores(spark, d).filter(F.col("cell").isin("real", "sham")).groupBy("cell").agg(F.round(F.avg((F.col("score") >= 0.25).cast("double")), 6).alias("fpr"), F.count("*").alias("samples"))


@query("m12_zscore", f"""WITH {SCORES_SQL}, b AS (SELECT avg(score3) AS m, stddev_pop(score3) AS s FROM scores WHERE split = 'validation' AND label = 0)
  SELECT split, round(avg((score3 - m) / (s + 1e-6)), 5) AS mean_z, round(max((score3 - m) / (s + 1e-6)), 5) AS max_z FROM scores, b GROUP BY split""")
def m12(spark, d):
    s = scores(spark, d)
    z = R.zscore(s, s.filter("split = 'validation' AND label = 0"), "score3")
    return z.groupBy("split").agg(F.round(F.avg("z"), 5).alias("mean_z"), F.round(F.max("z"), 5).alias("max_z"))


@query("m13_ensemble_max", f"""WITH {SCORES_SQL}, b AS (SELECT avg(score) AS m1, stddev_pop(score) AS s1, avg(score2) AS m2, stddev_pop(score2) AS s2 FROM scores WHERE split = 'validation' AND label = 0),
  e AS (SELECT label, round(greatest((score - m1) / (s1 + 1e-6), (score2 - m2) / (s2 + 1e-6)), 9) AS score FROM scores, b WHERE split = 'test'), {_auc_sql('SELECT * FROM e')} SELECT auc FROM auc""")
def m13(spark, d):
    s = scores(spark, d)
    basis = s.filter("split = 'validation' AND label = 0")
    z = R.zscore(R.zscore(s.filter(TEST), basis, "score").withColumnRenamed("z", "z1"), basis, "score2")
    return R.auc(z.withColumn("e", F.round(F.greatest("z1", "z"), 9)), score="e").select(r6("auc"))


@query("m14_head_rule", f"""WITH {SCORES_SQL} SELECT split, round(avg(greatest(score, score2)), 6) AS ai, round(avg(CASE WHEN kind = 'O' THEN score ELSE greatest(score, score2) END), 6) AS mixed FROM scores GROUP BY split""")
def m14(spark, d):
    both = F.greatest("score", "score2")
    return scores(spark, d).groupBy("split").agg(F.round(F.avg(both), 6).alias("ai"), F.round(F.avg(F.when(F.col("kind") == "O", F.col("score")).otherwise(both)), 6).alias("mixed"))


@query("m19_binary_metrics", f"""WITH {SCORES_SQL}, c AS (SELECT generator, count(*) FILTER (score2 >= 0.5 AND label = 1) AS tp, count(*) FILTER (score2 >= 0.5 AND label = 0) AS fp, count(*) FILTER (score2 < 0.5 AND label = 1) AS fn, count(*) FILTER (score2 < 0.5 AND label = 0) AS tn FROM scores GROUP BY ALL)
  SELECT generator, tp, fp, fn, tn, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1, round(fn / greatest(1, fn + tp), 6) AS fnr FROM c""")
def m19(spark, d):
    return R.at_threshold(scores(spark, d), F.lit(0.5), ["generator"], score="score2").select("generator", "tp", "fp", "fn", "tn", r6("f1"), r6("fnr"))


@query("m21_diagnostic_alarms", f"WITH {SCORES_SQL} SELECT cell, kind, round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS alarm_rate, count(*) AS n FROM scores WHERE label = 0 GROUP BY cell, kind")
def m21(spark, d):
    return scores(spark, d).filter("label = 0").groupBy("cell", "kind").agg(F.round(F.avg((F.col("score") >= 0.3).cast("double")), 6).alias("alarm_rate"), F.count("*").alias("n"))


@query("m22_branch_reports", f"""WITH {SCORES_SQL}, u AS (SELECT 'score' AS branch, cell, label, score FROM scores UNION ALL SELECT 'score2', cell, label, score2 FROM scores),
  rows AS (SELECT branch, cell, score, 1 AS label FROM u WHERE label = 1 UNION ALL SELECT r.branch, c.cell, r.score, 0 FROM u r, (SELECT DISTINCT cell FROM scores WHERE label = 1) c WHERE r.cell = 'real'),
  {_auc_sql('SELECT * FROM rows', 'branch, cell')} SELECT branch, cell, auc FROM auc""")
def m22(spark, d):
    long = scores(spark, d).select("cell", "label", F.expr("stack(2, 'score', score, 'score2', score2) AS (branch, score)"))
    cells = long.filter("label = 1").select(F.col("cell").alias("of")).distinct()
    reals = long.filter("cell = 'real'").crossJoin(F.broadcast(cells)).select("branch", F.col("of").alias("cell"), "score", F.lit(0).alias("label"))
    rows = long.filter("label = 1").select("branch", "cell", "score", "label").unionByName(reals)
    return R.auc(rows, ["branch", "cell"]).select("branch", "cell", r6("auc"))


@query("m27_roc_points", f"""WITH {SCORES_SQL}, d AS (SELECT sample_id, label, score FROM scores WHERE split = 'test'), {CURVE_SQL},
  x AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS c FROM k)
  SELECT round((fp / n)::DOUBLE, 6) AS fpr, round((tp / p)::DOUBLE, 6) AS tpr, score FROM x WHERE (i - 1) % greatest(1, c // 20) = 0 OR i = c""")
def m27(spark, d):
    k = R.curve(scores(spark, d).filter(TEST))
    total = k.agg(F.count("*").alias("c"))
    x = R.numbered(k, [F.desc("score")], "i").crossJoin(F.broadcast(total))
    x = x.filter(((F.col("i") - 1) % F.greatest(F.lit(1), F.floor(F.col("c") / 20)) == 0) | (F.col("i") == F.col("c")))
    return x.select(r6(F.col("fp") / F.col("n"), "fpr"), r6(F.col("tp") / F.col("p"), "tpr"), "score")


@query("m27_histogram_by_cell", f"WITH {SCORES_SQL} SELECT cell, least(20, floor(score2 * 20) + 1)::BIGINT AS bin, count(*) AS n FROM scores GROUP BY ALL")
def m27h(spark, d):
    return scores(spark, d).groupBy("cell", F.least(F.lit(20).cast("long"), F.floor(F.col("score2") * 20) + 1).alias("bin")).agg(F.count("*").alias("n"))


@query("m28_shortcut_audit", f"""WITH {SCORES_SQL}, u AS (SELECT 'quantity' AS feature, cell, score2 AS score, CASE WHEN cell = 'real' THEN 0 ELSE 1 END AS label FROM scores WHERE cell <> 'sham' UNION ALL SELECT 'price', cell, score3, CASE WHEN cell = 'real' THEN 0 ELSE 1 END FROM scores WHERE cell <> 'sham'),
  {_auc_sql('SELECT * FROM u', 'feature')} SELECT feature, auc, abs(auc - 0.5) > 0.2 AS flagged FROM auc""")
def m28(spark, d):
    long = scores(spark, d).filter("cell <> 'sham'").select(F.when(F.col("cell") == "real", 0).otherwise(1).alias("label"), F.expr("stack(2, 'quantity', score2, 'price', score3) AS (feature, score)"))
    return R.auc(long, ["feature"]).select("feature", r6("auc"), (F.abs(F.round("auc", 6) - 0.5) > 0.2).alias("flagged"))


@query("m29_cell_membership_auc", f"WITH {SCORES_SQL}, u AS (SELECT score3 AS score, CASE WHEN cell = 'audio' THEN 1 ELSE 0 END AS label FROM scores WHERE cell IN ('audio', 'real')), {_auc_sql('SELECT * FROM u')} SELECT auc FROM auc")
def m29(spark, d):
    rows = scores(spark, d).filter(F.col("cell").isin("audio", "real")).withColumn("label", (F.col("cell") == "audio").cast("int"))
    return R.auc(rows, score="score3").select(r6("auc"))


@query("m30_split_view_table", f"""WITH {SCORES_SQL}, v AS (SELECT split, 'score' AS view, score, label FROM scores UNION ALL SELECT split, 'score2', score2, label FROM scores), {_auc_sql('SELECT * FROM v', 'split, view')},
  x AS (SELECT split, view, count(*) FILTER (label = 0) AS real, count(*) FILTER (label = 1) AS fake, avg(CASE WHEN (score >= 0.3) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc,
    count(*) FILTER (label = 0 AND score >= 0.3) / greatest(1, count(*) FILTER (label = 0)) AS fa, count(*) FILTER (label = 1 AND score < 0.3) / greatest(1, count(*) FILTER (label = 1)) AS miss FROM v GROUP BY ALL)
  SELECT split, view, real, fake, auc, round(acc, 6) AS accuracy, round(fa, 6) AS real_false_alarm, round(miss, 6) AS fake_miss FROM x JOIN auc USING (split, view)""")
def m30(spark, d):
    v = scores(spark, d).select("split", "label", F.expr("stack(2, 'score', score, 'score2', score2) AS (view, score)"))
    m = R.at_threshold(v, F.lit(0.3), ["split", "view"])
    a = R.auc(v, ["split", "view"])
    return m.join(a, ["split", "view"]).select("split", "view", F.col("negatives").alias("real"), F.col("positives").alias("fake"), r6("auc"), r6("accuracy"), r6("fpr", "real_false_alarm"), r6("fnr", "fake_miss"))


@query("m31_method_table", f"""WITH {SCORES_SQL}, rows AS (SELECT generator, score, 1 AS label FROM scores WHERE label = 1 AND split = 'test' UNION ALL SELECT g.generator, s.score, 0 FROM scores s, (SELECT DISTINCT generator FROM scores WHERE label = 1 AND split = 'test') g WHERE s.label = 0 AND s.split = 'test'),
  {_auc_sql('SELECT * FROM rows', 'generator')}, x AS (SELECT generator, count(*) FILTER (label = 1 AND score >= 0.25) / greatest(1, count(*) FILTER (label = 1)) AS recall FROM rows GROUP BY ALL)
  SELECT generator, positives::BIGINT AS n, round(recall, 6) AS recall, auc FROM auc JOIN x USING (generator)""")
def m31(spark, d):
    s = scores(spark, d).filter(TEST)
    auc = R.breakdown(s, ["generator"], F.col("label") == 0).select(F.col("value").alias("generator"), "auc", "positives")
    recall = R.at_threshold(s.filter("label = 1"), F.lit(0.25), ["generator"]).select("generator", "recall")
    return auc.join(recall, "generator").select("generator", F.col("positives").alias("n"), r6("recall"), r6("auc"))


@query("a12_speaker_weights", f"""WITH {SCORES_SQL}, c AS (SELECT split, speaker_id, count(DISTINCT source_clip_id) AS items FROM scores GROUP BY ALL), g AS (SELECT max(items) = min(items) AS same FROM c WHERE split = 'train')
  SELECT speaker_id, items, CASE WHEN NOT same THEN round(1.0::DOUBLE / items, 6) END AS weight FROM c, g WHERE split = 'train'""")
def a12(spark, d):
    return R.weights_by_group(scores(spark, d).filter("split = 'train'"), "speaker_id", "source_clip_id").select("speaker_id", "items", r6("weight"))


@query("a13_class_weights", f"WITH {SCORES_SQL} SELECT split, round(least(5, greatest(0.2, count(*) FILTER (label = 0)::DOUBLE / greatest(1, count(*) FILTER (label = 1)))), 6) AS pos_weight FROM scores GROUP BY split")
def a13(spark, d):
    ratio = F.count_if(F.col("label") == 0) / F.greatest(F.lit(1), F.count_if(F.col("label") == 1))
    return scores(spark, d).groupBy("split").agg(F.round(F.least(F.lit(5.0), F.greatest(F.lit(0.2), ratio)), 6).alias("pos_weight"))


@query("m1_label_auc", """WITH scores AS (SELECT d.doc_id, d.n_chars::DOUBLE AS score, l.quality AS label, d.lang FROM documents d JOIN labels l USING (doc_id)),
  g AS (SELECT lang, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY score) - neg / 2.0 AS below FROM g)
  SELECT lang, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round((sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 6) END AS auc FROM c GROUP BY lang""")
def m1_label(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return R.auc(rows, ["lang"]).select("lang", r6("auc"))


@query("w4_search_threshold")
def w4(spark, d):
    return R.search_threshold(scores(spark, d).filter("split = 'validation'"), score="score2").select("threshold", r6("f1"), r6("fpr"))


@query("m7_task_bundle", f"""WITH {SCORES_SQL}, {_auc_sql('SELECT * FROM scores', 'split')}, x AS (SELECT split, count(*) FILTER (score >= 0.25 AND label = 1) AS tp, count(*) FILTER (score >= 0.25 AND label = 0) AS fp, count(*) FILTER (label = 1) AS p FROM scores GROUP BY split)
  SELECT split, auc, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, p), 6) AS recall FROM auc JOIN x USING (split)""")
def m7(spark, d):
    s = scores(spark, d)
    return R.auc(s, ["split"]).join(R.at_threshold(s, F.lit(0.25), ["split"]), "split").select("split", r6("auc"), r6("precision"), r6("recall"))


@query("m26_validation_auc", f"""WITH {SCORES_SQL}, v AS (SELECT * FROM scores WHERE split = 'validation'), p AS (SELECT 'cell' AS dim, cell AS value, score FROM v WHERE label = 1 UNION ALL SELECT 'kind', kind, score FROM v WHERE label = 1),
  rows AS (SELECT dim, value, score, 1 AS label FROM p UNION ALL SELECT g.dim, g.value, v.score, 0 FROM v, (SELECT DISTINCT dim, value FROM p) g WHERE v.cell = 'real'), {_auc_sql('SELECT * FROM rows', 'dim, value')} SELECT dim, value, auc FROM auc""")
def m26(spark, d):
    return R.breakdown(scores(spark, d).filter("split = 'validation'"), ["cell", "kind"], F.col("cell") == "real").select("dim", "value", r6("auc"))
