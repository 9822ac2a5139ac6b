"""Queries of the interval and time-series operators (survey 2.6, 2.9, 2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import intervals as I
from strandline.operators import series as S
from strandline.operators.sync import JumpRules, jump_marks
from strandline.session import materialize
from strandline.plans.base import CLIPS_SQL, FRAMES_SQL, clips, frames, query, t

FR = f"WITH {FRAMES_SQL}"
SPANS_SQL = "spans AS (SELECT user_id AS key, event_type AS kind, event_id, (event_id * 37 % 20000) / 10.0::DOUBLE AS a, (event_id * 37 % 20000) / 10.0::DOUBLE + value / 10 AS b FROM events)"


def spans(spark, d):
    a = F.col("event_id") * 37 % 20000 / F.lit(10.0)
    return t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "event_id", a.alias("a"), (a + F.col("value") / 10).alias("b"))


def _union_sql(src: str, keys: str, touch: str = "1e-9", name: str = "u", digits: str = "4") -> str:
    r = lambda x: f"round_even({x}, {digits})" if digits else x
    return f"""{name}_m AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {touch}, true)::INT AS fresh FROM {src}),
  {name}_r AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
  {name} AS (SELECT {keys}, {r('min(a)')} AS a, {r('max(b)')} AS b FROM {name}_r GROUP BY {keys}, run)"""


@query("i1_coalesce_spans", f"WITH {SPANS_SQL}, {_union_sql('spans', 'key')} SELECT key, a, b FROM u")
def i1(spark, d):
    return I.coalesce_spans(spans(spark, d), ["key"]).select("key", "a", "b")


@query("i2_union_check", f"WITH {SPANS_SQL}, {_union_sql('spans', 'key, kind', '0', 'u', '')}, w AS (SELECT key, round(sum(b - a), 4) AS covered FROM u GROUP BY key) SELECT key, covered FROM w")
def i2(spark, d):
    return I.coalesce_spans(spans(spark, d), ["key", "kind"], touch=0.0, digits=None).groupBy("key").agg(F.round(F.sum(F.col("b") - F.col("a")), 4).alias("covered"))


def _arrays(spark, d):
    s = I.coalesce_spans(spans(spark, d), ["key"])
    return s.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


@query("i3_interval_checks", f"WITH {SPANS_SQL}, {_union_sql('spans', 'key')}, n AS (SELECT *, lead(a) OVER (PARTITION BY key ORDER BY a) AS nxt FROM u) SELECT key, bool_and(b > a AND a >= -1e-6 AND b <= 2005 + 1e-6 AND (nxt IS NULL OR nxt >= b - 1e-6)) AS ok FROM n GROUP BY key")
def i3(spark, d):
    return _arrays(spark, d).select("key", I.well_formed(F.col("spans"), F.lit(2005.0)).alias("ok"))


@query("i4_cell_targets", f"""WITH {SPANS_SQL}, {_union_sql('spans', 'key')}, c AS (SELECT k.key, x.cell FROM (SELECT DISTINCT key FROM spans) k, range(0, 41) x(cell)),
  s AS (SELECT c.key, c.cell, sum(greatest(0, least(u.b, least(c.cell * 50.0 + 50, 2010)) - greatest(u.a, c.cell * 50.0))) / any_value(least(c.cell * 50.0 + 50, 2010) - c.cell * 50.0) AS share FROM c JOIN u USING (key) GROUP BY c.key, c.cell)
  SELECT key, cell, CASE WHEN key % 10 = 3 THEN -1.0 ELSE round(least(1, greatest(0, share))::DOUBLE, 6) END AS target FROM s""")
def i4(spark, d):
    arr = _arrays(spark, d).withColumn("duration", F.lit(2010.0)).withColumn("spans", F.when(F.col("key") % 10 != 3, F.col("spans")))
    return I.cell_targets(arr, "key", "spans", "duration", 50.0).select("key", "cell", F.round("target", 6).alias("target"))


@query("i6_iou", f"""WITH {SPANS_SQL}, n AS (SELECT *, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM spans WINDOW w AS (PARTITION BY key ORDER BY a, event_id)),
  x AS (SELECT *, greatest(0, least(b, b2) - greatest(a, a2)) AS i FROM n WHERE a2 IS NOT NULL) SELECT event_id, CASE WHEN (b - a) + (b2 - a2) - i > 0 THEN round(i / ((b - a) + (b2 - a2) - i), 6) ELSE 0 END AS iou FROM x""")
def i6(spark, d):
    w = Window.partitionBy("key").orderBy("a", "event_id")
    s = spans(spark, d).withColumns({"a2": F.lead("a").over(w), "b2": F.lead("b").over(w)}).filter("a2 IS NOT NULL")
    return s.select("event_id", F.round(I.iou(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")), 6).alias("iou"))


ISLANDS = "isl AS (SELECT *, frame - row_number() OVER (PARTITION BY sample_id ORDER BY frame) AS g FROM frames WHERE {cond})"


@query("i7_mask_to_spans", f"""{FR}, {ISLANDS.format(cond="valid AND score >= 0.3")} SELECT sample_id, round(min(frame) * 0.2, 4) AS a, round(least((max(frame) + 1) * 0.2, 12.3), 4) AS b, round(avg(score), 6) AS score FROM isl GROUP BY sample_id, g HAVING least((max(frame) + 1) * 0.2, 12.3) - min(frame) * 0.2 >= 0.4 - 1e-9""")
def i7(spark, d):
    out = I.mask_to_spans(frames(spark, d), "sample_id", "frame", F.col("valid") & (F.col("score") >= 0.3), 0.2, F.col("score"), F.lit(12.3), 0.4)
    return out.select("sample_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("score", 6).alias("score"))


@query("i8_valid_runs", f"{FR}, {ISLANDS.format(cond='valid')} SELECT sample_id, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM isl GROUP BY sample_id, g")
def i8(spark, d):
    return I.runs(frames(spark, d), "sample_id", "frame", F.col("valid")).groupBy("sample_id", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames")).drop("run")


@query("i9_run_ids", f"{FR}, {ISLANDS.format(cond='valid')} SELECT f.sample_id, f.frame, coalesce(r.run, -1) AS run FROM frames f LEFT JOIN (SELECT sample_id, frame, dense_rank() OVER (PARTITION BY sample_id ORDER BY g) - 1 AS run FROM isl) r USING (sample_id, frame)")
def i9(spark, d):
    f = frames(spark, d)
    return f.select("sample_id", "frame").join(I.runs(f, "sample_id", "frame", F.col("valid")).select("sample_id", "frame", "run"), ["sample_id", "frame"], "left").select("sample_id", "frame", F.coalesce("run", F.lit(-1)).alias("run"))


SPEECH_SQL = f"""{ISLANDS.format(cond='score >= 0.5')}, raw AS (SELECT sample_id, min(frame) * 0.1::DOUBLE AS a, (max(frame) + 1) * 0.1::DOUBLE AS b FROM isl GROUP BY sample_id, g),
  {_union_sql('raw', 'sample_id', '0.25', 'j', '')}, pad AS (SELECT sample_id, greatest(0, a - 0.15) AS a, least((SELECT (max(frame) + 1) * 0.1 FROM frames f WHERE f.sample_id = j.sample_id), b + 0.15) AS b FROM j WHERE b - a >= 0.15 - 1e-9), {_union_sql('pad', 'sample_id', '1e-9', 'sp')}"""


def _speech(spark, d):
    f = frames(spark, d)
    length = f.groupBy("sample_id").agg(((F.max("frame") + 1) * 0.1).alias("duration"))
    return f, I.speech_regions(f, "sample_id", "frame", "score", 0.1, length, 0.5, 0.25, 0.15, 0.15)


@query("i10_speech_regions", f"{FR}, {SPEECH_SQL} SELECT sample_id, a, b FROM sp")
def i10(spark, d):
    return _speech(spark, d)[1].select("sample_id", "a", "b")


@query("i11_inner_pauses", f"{FR}, {SPEECH_SQL}, lo AS (SELECT *, frame - row_number() OVER (PARTITION BY sample_id ORDER BY frame) AS g2 FROM frames WHERE score < 0.5), ps AS (SELECT sample_id, min(frame) * 0.1::DOUBLE AS a, (max(frame) + 1) * 0.1::DOUBLE AS b FROM lo GROUP BY sample_id, g2) SELECT ps.sample_id, round(ps.a, 4) AS a, round(ps.b, 4) AS b FROM ps JOIN sp ON sp.sample_id = ps.sample_id AND ps.a > sp.a AND ps.b < sp.b")
def i11(spark, d):
    f, regions = _speech(spark, d)
    return I.inner_pauses(f, "sample_id", "frame", "score", 0.1, regions).select("sample_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("i13_window_coverage", f"""{FR}, n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL), w AS (SELECT sample_id, s AS start, s + 10 AS stop FROM n, range(0, 1000, 10) x(s) WHERE s + 10 <= n)
  SELECT w.sample_id, start, round(avg(valid::INT), 6) AS ratio FROM w JOIN frames f ON f.sample_id = w.sample_id AND f.frame >= start AND f.frame < stop GROUP BY ALL HAVING avg(valid::INT) >= 0.8""")
def i13(spark, d):
    f = frames(spark, d)
    n = f.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n >= 10")
    w = n.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 10, F.lit(10).cast("long"))).alias("start")).withColumn("stop", F.col("start") + 10)
    out = I.coverage(w, f.select("sample_id", "frame", "valid"), "sample_id", "frame", F.col("valid"))
    return out.filter("ratio >= 0.8").select("sample_id", "start", F.round("ratio", 6).alias("ratio"))


@query("i14_boundary_segments", f"""WITH {SPANS_SQL}, m AS (SELECT key, x, sum(dd) AS dd FROM (SELECT key, a AS x, 1 AS dd FROM spans UNION ALL SELECT key, b, -1 FROM spans) GROUP BY key, x),
  s AS (SELECT key, x AS a, lead(x) OVER w AS b, sum(dd) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM m WINDOW w AS (PARTITION BY key ORDER BY x)) SELECT key, count(*) AS segments, max(c)::BIGINT AS deepest, round(sum(CASE WHEN c >= 2 THEN b - a ELSE 0 END), 4) AS doubled FROM s WHERE b IS NOT NULL GROUP BY key""")
def i14(spark, d):
    s = I.segments(spans(spark, d), "key", "a", "b")
    return s.groupBy("key").agg(F.count("*").alias("segments"), F.max("covering").alias("deepest"), F.round(F.sum(F.when(F.col("covering") >= 2, F.col("b") - F.col("a")).otherwise(0.0)), 4).alias("doubled"))


@query("i15_containment", f"WITH {SPANS_SQL}, {_union_sql('spans', 'key')}, p AS (SELECT key, a + 1 AS a, b + 1 AS b FROM spans WHERE kind = 'click') SELECT key, bool_and(EXISTS (SELECT 1 FROM u WHERE u.key = p.key AND p.a >= u.a - 1e-6 AND p.b <= u.b + 1e-6)) AS inside FROM p GROUP BY key")
def i15(spark, d):
    p = spans(spark, d).filter("kind = 'click'").groupBy("key").agg(F.collect_list(F.struct((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"))).alias("p"))
    return p.join(_arrays(spark, d), "key").select("key", I.contained(F.col("p"), F.col("spans")).alias("inside"))


@query("i17_word_spans", f"""{FR}, w AS (SELECT sample_id, frame, sum(value) OVER (PARTITION BY sample_id ORDER BY frame ROWS UNBOUNDED PRECEDING) - value AS a, sum(value) OVER (PARTITION BY sample_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS b FROM frames),
  x AS (SELECT p.sample_id, p.frame AS first, q.frame AS last FROM w p JOIN w q ON p.sample_id = q.sample_id AND p.frame <= q.frame AND round(q.b - p.a, 6) BETWEEN 50 AND 120) SELECT sample_id, count(*) AS phrases, max(last - first) AS longest FROM x GROUP BY sample_id""")
def i17(spark, d):
    w = Window.partitionBy("sample_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    f = frames(spark, d).withColumn("b", F.sum("value").over(w)).withColumn("a", F.col("b") - F.col("value"))
    words = I.word_spans(f, "sample_id", "frame", "a", "b", 50 - 5e-7, 120 + 5e-7)
    return words.groupBy("sample_id").agg(F.count("*").alias("phrases"), F.max(F.col("last") - F.col("first")).alias("longest"))


@query("i18_apart", f"{CLIPS_SQL and 'WITH ' + CLIPS_SQL}, p AS (SELECT *, lead(start_s) OVER w AS s2, lead(end_s) OVER w AS e2 FROM clips WINDOW w AS (PARTITION BY video_id ORDER BY clip_id)) SELECT clip_id, (end_s <= s2 OR e2 <= start_s) AS apart FROM p WHERE s2 IS NOT NULL")
def i18(spark, d):
    w = Window.partitionBy("video_id").orderBy("clip_id")
    c = clips(spark, d).withColumns({"s2": F.lead("start_s").over(w), "e2": F.lead("end_s").over(w)}).filter("s2 IS NOT NULL")
    return c.select("clip_id", I.apart(F.col("start_s"), F.col("end_s"), F.col("s2"), F.col("e2")).alias("apart"))


@query("i19_fixed_windows", "SELECT o_orderkey AS video, x.s AS start, x.s + 5 AS stop FROM orders, range(0, 2000, 4) x(s) WHERE x.s + 5 <= o_totalprice / 5000")
def i19(spark, d):
    last = F.floor(F.col("o_totalprice") / 5000 - 5).cast("int")
    o = t(spark, d, "orders").filter(F.col("o_totalprice") / 5000 >= 5)
    return o.select(F.col("o_orderkey").alias("video"), F.explode(F.sequence(F.lit(0), last, F.lit(4))).alias("start")).withColumn("start", F.col("start").cast("long")).withColumn("stop", F.col("start") + 5)


@query("i20_longest_bad", f"WITH {SPANS_SQL} SELECT key, arg_max(kind, struct_pack(l := round(b - a, 9), n := event_id)) AS reason, round(max(b - a), 6) AS longest FROM spans GROUP BY key")
def i20(spark, d):
    return spans(spark, d).groupBy("key").agg(F.max_by("kind", F.struct(F.round(F.col("b") - F.col("a"), 9), F.col("event_id"))).alias("reason"), F.round(F.max(F.col("b") - F.col("a")), 6).alias("longest"))


@query("i21_reject_policy", f"""{FR}, {ISLANDS.format(cond='score < 0.3')}, r AS (SELECT sample_id, g, count(*) * 200 AS ms FROM isl GROUP BY ALL), b AS (SELECT sample_id, max(ms) AS longest, sum(ms) AS total FROM r GROUP BY ALL), n AS (SELECT sample_id, count(*) * 200 AS voiced FROM frames GROUP BY ALL)
  SELECT n.sample_id, CASE WHEN coalesce(longest, 0) >= 800 THEN 'reject' WHEN coalesce(total, 0) >= 500 AND total >= 0.2 * voiced THEN 'reject' WHEN coalesce(total, 0) > 0 THEN 'manual' ELSE 'keep' END AS decision FROM n LEFT JOIN b USING (sample_id)""")
def i21(spark, d):
    f = frames(spark, d)
    r = I.runs(f, "sample_id", "frame", F.col("score") < 0.3).groupBy("sample_id", "run").agg((F.count("*") * 200).alias("ms"))
    b = r.groupBy("sample_id").agg(F.max("ms").alias("longest"), F.sum("ms").alias("total"))
    n = f.groupBy("sample_id").agg((F.count("*") * 200).alias("voiced")).join(b, "sample_id", "left").na.fill(0)
    return n.select("sample_id", F.when(F.col("longest") >= 800, "reject").when((F.col("total") >= 500) & (F.col("total") >= 0.2 * F.col("voiced")), "reject").when(F.col("total") > 0, "manual").otherwise("keep").alias("decision"))


@query("i22_scoring_windows", f"""{FR}, n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL), s AS (SELECT sample_id, n, s FROM n, range(0, 2000, 9) x(s) WHERE s + 18 <= n UNION SELECT sample_id, n, greatest(0, n - 18) FROM n) SELECT sample_id, s AS start, least(s + 18, n) AS stop FROM s""")
def i22(spark, d):
    return I.fixed_windows(frames(spark, d).groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id", "n", 18, 9)


@query("i23_overlap_average", f"""{FR}, n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL), s AS (SELECT sample_id, n, s FROM n, range(0, 2000, 9) x(s) WHERE s + 18 <= n UNION SELECT sample_id, n, greatest(0, n - 18) FROM n),
  w AS (SELECT s.sample_id, s AS start, least(s + 18, n) AS stop, avg(f.score) AS score FROM s JOIN frames f ON f.sample_id = s.sample_id AND frame >= s AND frame < s + 18 GROUP BY ALL) SELECT f.sample_id, f.frame, round(avg(w.score), 6) AS score FROM frames f JOIN w ON w.sample_id = f.sample_id AND frame >= start AND frame < stop GROUP BY ALL""")
def i23(spark, d):
    f = frames(spark, d)
    w = I.fixed_windows(f.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id", "n", 18, 9)
    scored = w.join(f.select("sample_id", "frame", "score"), "sample_id").filter("frame >= start AND frame < stop").groupBy("sample_id", "start", "stop").agg(F.avg("score").alias("score"))
    return I.overlap_average(scored, "sample_id", "start", "stop", "score").select("sample_id", "frame", F.round("score", 6).alias("score"))


@query("i24_context_windows", f"{FR}, n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL) SELECT sample_id, c AS centre, greatest(0, c - 6) AS start, least(n, c + 7) AS stop, (c >= 6 AND c + 6 < n) AS whole FROM n, range(0, 2000, 5) x(c) WHERE c < n")
def i24(spark, d):
    return I.context_windows(frames(spark, d).groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id", "n", 6, 5)


# --- time series -----------------------------------------------------------------------------------------------------


@query("w6_run_smooth", f"{FR}, {ISLANDS.format(cond='valid')} SELECT sample_id, frame, round(avg(value) OVER (PARTITION BY sample_id, g ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 5) AS smooth FROM isl")
def w6(spark, d):
    r = I.runs(frames(spark, d), "sample_id", "frame", F.col("valid"))
    return S.run_smooth(r, "sample_id", "frame", "run", "value", 6).select("sample_id", "frame", F.round("smooth", 5).alias("smooth"))


@query("w8_differences", f"""{FR}, a AS (SELECT *, coalesce(value - lag(value) OVER w, 0) AS d1 FROM frames WINDOW w AS (PARTITION BY sample_id ORDER BY frame)), b AS (SELECT *, coalesce(d1 - lag(d1) OVER w, 0) AS d2 FROM a WINDOW w AS (PARTITION BY sample_id ORDER BY frame)),
  c AS (SELECT *, coalesce(d2 - lag(d2) OVER w, 0) AS d3 FROM b WINDOW w AS (PARTITION BY sample_id ORDER BY frame)) SELECT sample_id, frame, round(d1, 5) AS d1, round(d2, 5) AS d2, round(d3, 5) AS d3 FROM c""")
def w8(spark, d):
    return S.differences(frames(spark, d), "sample_id", "frame", "value").select("sample_id", "frame", *[F.round(c, 5).alias(c) for c in ("d1", "d2", "d3")])


@query("w9_residual", f"{FR} SELECT sample_id, frame, round(value - (coalesce(lag(value) OVER w, value) + coalesce(lead(value) OVER w, value)) / 2, 5) AS residual FROM frames WINDOW w AS (PARTITION BY sample_id ORDER BY frame)")
def w9(spark, d):
    return S.residual(frames(spark, d), "sample_id", "frame", "value").select("sample_id", "frame", F.round("residual", 5).alias("residual"))


@query("w10_top_mean", f"{FR}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM frames WHERE valid) SELECT sample_id, round(avg(score), 6) AS score FROM r WHERE r <= ceil(n * 0.1) GROUP BY sample_id")
def w10(spark, d):
    return S.top_mean(frames(spark, d).filter("valid"), "sample_id", "score", 0.1).select("sample_id", F.round("score", 6).alias("score"))


@query("w11_pooling", f"{FR}, m AS (SELECT sample_id, max(score) AS m FROM frames GROUP BY ALL) SELECT sample_id, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(ln(sum(exp(score - m)) / count(*)) + max(m), 6) AS lse FROM frames JOIN m USING (sample_id) GROUP BY sample_id")
def w11(spark, d):
    return S.pool(frames(spark, d), "sample_id", "score").select("sample_id", *[F.round(c, 6).alias(c) for c in ("mean", "max", "lse")])


ROBUST_SQL = """near AS (SELECT f.sample_id, f.frame, f.value, g.value AS v FROM frames f LEFT JOIN frames g ON g.sample_id = f.sample_id AND abs(g.frame - f.frame) BETWEEN 2 AND 25),
  md AS (SELECT sample_id, frame, any_value(value) AS value, median(v) AS m, count(v) AS n FROM near GROUP BY sample_id, frame),
  mad AS (SELECT md.sample_id, md.frame, md.value, md.m, md.n, median(abs(near.v - md.m)) AS mad FROM md JOIN near USING (sample_id, frame) GROUP BY ALL),
  rz AS (SELECT sample_id, frame, CASE WHEN n < 5 THEN 0.0 ELSE (value - m) / greatest(1e-4, 1.4826 * mad) END AS z FROM mad)"""


@query("ts1_robust_z", f"{FR}, {ROBUST_SQL} SELECT sample_id, frame, round(z, 4) AS z FROM rz")
def ts1(spark, d):
    return S.robust_z(frames(spark, d), "sample_id", "frame", "value").select("sample_id", "frame", F.round("z", 4).alias("z"))


@query("ts2_spikes")
def ts2(spark, d):
    f = frames(spark, d).withColumns({"motion": F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("sample_id").orderBy("frame"))) / 100, "look": F.col("score"), "sound": F.col("value")})
    return jump_marks(f.na.fill(0.0, ["motion"]), "sample_id", "frame", "motion", "look", "sound", JumpRules(ratio=1.2, calm=4.0, appearance=1.0, audio=1.0))


@query("ts7_fill_gaps", f"""{FR}, k AS (SELECT sample_id, frame, CASE WHEN valid THEN value END AS v FROM frames), n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1
  FROM k WINDOW b AS (PARTITION BY sample_id ORDER BY frame ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY sample_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT sample_id, frame, round(coalesce(v0 + (v1 - v0) * (frame - f0) / greatest(f1 - f0, 1), v0, v1), 5) AS filled FROM n""")
def ts7(spark, d):
    f = frames(spark, d).withColumn("v", F.when(F.col("valid"), F.col("value")))
    return S.fill_gaps(f, "sample_id", "frame", "v").select("sample_id", "frame", F.round("filled", 5).alias("filled"))


LAG_SQL = """f AS (SELECT sample_id, frame, value - 50 AS x, lag(value - 50, 2) OVER (PARTITION BY sample_id ORDER BY frame) AS y FROM frames), p AS (SELECT a.sample_id, l AS lag, avg(a.x * b.y) AS score, count(*) AS n FROM f a, range(-5, 6) r(l), f b WHERE b.sample_id = a.sample_id AND b.frame = a.frame + l AND b.y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)"""


LONG_LAG_SQL = LAG_SQL.replace("range(-5, 6)", "range(-15, 16)")


def _lags(spark, d, most):
    w = Window.partitionBy("sample_id").orderBy("frame")
    f = frames(spark, d).select("sample_id", "frame", (F.col("value") - 50).alias("x")).withColumn("y", F.lag("x", 2).over(w))
    profile = S.lag_profile(f.select("sample_id", "frame", "x"), f.filter("y IS NOT NULL").select("sample_id", "frame", "y"), "sample_id", "frame", "x", "y", most, 10)
    return S.best_lag(profile.withColumn("score", F.round("score", 6)), "sample_id").select("sample_id", "lag", F.round("peak", 3).alias("peak"))


def _sync(b):
    near = F.count_if(F.abs(F.col("lag") - 2) <= 1) / F.count("*")
    out = b.groupBy((F.col("sample_id") % 10).alias("video")).agg(F.count("*").alias("curves"), near.alias("r"))
    return out.select("video", "curves", F.round("r", 6).alias("agree"), F.when(F.col("curves") < 3, "few").when(F.col("r") >= 0.5, "ok").otherwise("unreliable").alias("status"))


@query("ts8_lag_profile", f"{FR}, {LAG_SQL} SELECT sample_id, arg_max(lag, struct_pack(s := round(score, 6), l := -lag)) AS lag, round(max(score) - median(score), 3) AS peak FROM p GROUP BY sample_id")
def ts8(spark, d):
    """The window of five lags that the oracle SQL has; ts8_lag_profile_full has the operator's fifteen."""
    return _lags(spark, d, 5)


@query("ts10_sync_summary", f"{FR}, {LAG_SQL}, b AS (SELECT sample_id, arg_max(lag, struct_pack(s := round(score, 6), l := -lag)) AS lag FROM p GROUP BY sample_id) SELECT sample_id % 10 AS video, count(*) AS curves, round(count(*) FILTER (abs(lag + 2) <= 1) / count(*), 6) AS agree, CASE WHEN count(*) < 3 THEN 'few' WHEN count(*) FILTER (abs(lag + 2) <= 1) / count(*) >= 0.5 THEN 'ok' ELSE 'unreliable' END AS status FROM b GROUP BY 1" .replace("lag + 2", "lag - 2"))
def ts10(spark, d):
    return _sync(ts8(spark, d))


@query("ts8_lag_profile_full", f"{FR}, {LONG_LAG_SQL} SELECT sample_id, arg_max(lag, struct_pack(s := round(score, 6), l := -lag)) AS lag, round(max(score) - median(score), 3) AS peak FROM p GROUP BY sample_id")
def ts8_full(spark, d):
    return _lags(spark, d, 15)


@query("ts10_sync_summary_full", f"{FR}, {LONG_LAG_SQL}, b AS (SELECT sample_id, arg_max(lag, struct_pack(s := round(score, 6), l := -lag)) AS lag FROM p GROUP BY sample_id) SELECT sample_id % 10 AS video, count(*) AS curves, round(count(*) FILTER (abs(lag + 2) <= 1) / count(*), 6) AS agree, CASE WHEN count(*) < 3 THEN 'few' WHEN count(*) FILTER (abs(lag + 2) <= 1) / count(*) >= 0.5 THEN 'ok' ELSE 'unreliable' END AS status FROM b GROUP BY 1" .replace("lag + 2", "lag - 2"))
def ts10_full(spark, d):
    return _sync(ts8_full(spark, d))


@query("ts13_shift", f"{FR} SELECT f.sample_id, f.frame, round(g.value, 5) AS moved, g.value IS NOT NULL AS has FROM frames f LEFT JOIN frames g ON g.sample_id = f.sample_id AND g.frame = f.frame - 3")
def ts13(spark, d):
    return S.shift(frames(spark, d), "sample_id", "frame", "value", 3).select("sample_id", "frame", F.round("moved", 5).alias("moved"), "has")


@query("ts15_edge_silence", f"{FR}, l AS (SELECT *, value > max(value) OVER (PARTITION BY sample_id) - 60 AS loud FROM frames) SELECT sample_id, min(frame) FILTER (loud) AS lead, max(frame) - max(frame) FILTER (loud) AS trail, round(avg(loud::INT), 6) AS loud_share FROM l GROUP BY sample_id")
def ts15(spark, d):
    return S.edge_silence(frames(spark, d), "sample_id", "frame", "value", 60).select("sample_id", "lead", "trail", F.round("loud_share", 6).alias("loud_share"))


@query("ts17_quietest_window", f"{FR}, w AS (SELECT sample_id, frame, sqrt(avg(value * value) OVER x) AS r, count(*) OVER x AS n FROM frames WINDOW x AS (PARTITION BY sample_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT sample_id, arg_min(frame, struct_pack(r := round(r, 6), f := frame)) AS start, round(min(r), 6) AS rms FROM w WHERE n = 5 GROUP BY sample_id")
def ts17(spark, d):
    return S.quietest(frames(spark, d), "sample_id", "frame", "value", 5)


@query("ts21_resample", f"{FR}, k AS (SELECT sample_id, round(frame * 0.07::DOUBLE, 6) AS t, value FROM frames WHERE valid), g AS (SELECT sample_id, round(i * 0.04::DOUBLE, 6) AS t FROM (SELECT sample_id, floor(max(frame) * 0.07::DOUBLE / 0.04::DOUBLE) AS n FROM frames GROUP BY ALL), range(0, 1000) x(i) WHERE i <= n) SELECT g.sample_id, g.t, round(k.value, 5) AS value, coalesce(round(g.t - k.t, 6) <= 0.12, false) AS valid FROM g ASOF LEFT JOIN k ON k.sample_id = g.sample_id AND k.t <= g.t")
def ts21(spark, d):
    f = frames(spark, d)
    known = f.filter("valid").select("sample_id", F.round(F.col("frame") * 0.07, 6).alias("t"), "value")
    length = f.groupBy("sample_id").agg((F.max("frame") * 0.07).alias("duration"))
    return S.resample(known, "sample_id", "t", "value", length, 0.04, 0.12).select("sample_id", "t", F.round("value", 5).alias("value"), "valid")


@query("ts23_stride_pooling", f"{FR} SELECT sample_id, frame // 4 AS block, round(avg(value), 5) AS value, bool_and(valid) AS valid FROM frames GROUP BY ALL")
def ts23(spark, d):
    return S.pooled(frames(spark, d), "sample_id", "frame", "value", "valid", 4).select("sample_id", "block", F.round("value", 5).alias("value"), "valid")


@query("m16_localization", f"""{FR}, s AS (SELECT sample_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, round(score, 1) AS score FROM frames), g AS (SELECT sample_id, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY sample_id ORDER BY score) - neg / 2.0 AS below FROM g), a AS (SELECT sample_id, sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM c GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0) SELECT round(avg(auc), 5) AS mean_auc, count(*) AS clips FROM a""")
def m16(spark, d):
    from strandline.operators import ranking as R

    s = frames(spark, d).select("sample_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"), F.round("score", 1).alias("score"))
    return R.auc(s, ["sample_id"]).agg(F.round(F.avg("auc"), 5).alias("mean_auc"), F.count("auc").alias("clips"))


@query("m16_localization_full", f"""{FR}, s AS (SELECT sample_id, frame, event_type = 'purchase' AS own, round(score, 1) AS score FROM frames), g AS (SELECT sample_id, score, count(*) FILTER (own) AS pos, count(*) FILTER (NOT own) AS neg FROM s GROUP BY ALL),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY sample_id ORDER BY score) - neg / 2.0 AS below FROM g), a AS (SELECT sample_id, sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM c GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0),
  e AS (SELECT sample_id, min(frame) FILTER (own) AS lo, max(frame) FILTER (own) AS hi, arg_max(own, struct_pack(s := score, f := -frame)) AS top FROM s GROUP BY ALL),
  m AS (SELECT sample_id, any_value(top) AS top, avg(score) FILTER (least(abs(frame - lo), abs(frame - hi)) <= 2) AS edge, avg(score) FILTER (least(abs(frame - lo), abs(frame - hi)) > 2) AS middle FROM s JOIN e USING (sample_id) WHERE own GROUP BY ALL)
  SELECT round(avg(auc), 5) AS mean_auc, count(*) AS clips, round(avg(top::INT), 5) AS top_inside, round(avg(edge), 5) AS edge, round(avg(middle), 5) AS middle FROM a JOIN m USING (sample_id)""")
def m16_full(spark, d):
    from strandline.operators import detection as D

    s = frames(spark, d).select("sample_id", "frame", (F.col("event_type") == "purchase").alias("own"), F.round("score", 1).alias("score"))
    return D.localization(s, "sample_id", "frame", "own", "score").select("clips", *[F.round(c, 5).alias(c) for c in ("mean_auc", "top_inside", "edge", "middle")])
