"""Queries of the scalar functions, sources, and the remaining selection, series, state and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars as X
from strandline.operators import intervals as I
from strandline.operators import ranking as R
from strandline.operators import resample as B
from strandline.operators import selection as S
from strandline.operators import series as E
from strandline.operators import tables as T
from strandline.plans.base import CLIPS_SQL, FRAMES_SQL, SCORES_SQL, VIDEOS_SQL, clips, frames, query, scores, t, videos
from strandline.sources import manifests

V, C, SC, FR = (f"WITH {x}" for x in (VIDEOS_SQL, CLIPS_SQL, SCORES_SQL, FRAMES_SQL))

# --- filters and scalar functions ------------------------------------------------------------------------------------


@query("f2_quality_reason", f"{V} SELECT CASE WHEN size_mb < 50 THEN 'small' WHEN duration_s < 300 THEN 'short' WHEN status = 'P' THEN 'pending' END AS issue, count(*) AS n FROM videos GROUP BY 1")
def f2(spark, d):
    rules = T.first_failing([("small", F.col("size_mb") < 50), ("short", F.col("duration_s") < 300), ("pending", F.col("status") == "P")])
    return videos(spark, d).groupBy(rules.alias("issue")).agg(F.count("*").alias("n"))


@query("f5_size_estimate", "SELECT p_partkey, round(coalesce(CASE WHEN p_size > 30 THEN p_retailprice * 1e4 END / 1e6, CASE WHEN p_size > 10 THEN p_size END * 60.0 / 8 / 1000, 60.0 / 3600 * 0.5 * 1000)::DOUBLE, 1) AS mb FROM part")
def f5(spark, d):
    size = F.when(F.col("p_size") > 30, F.col("p_retailprice") * 1e4)
    rate = F.when(F.col("p_size") > 10, F.col("p_size").cast("double"))
    return t(spark, d, "part").select("p_partkey", X.estimate_mb(size, rate, F.lit(60.0)).alias("mb"))


@query("f6_link_hosts", "SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]*)', 1) AS head, count(*) AS pages FROM pages GROUP BY ALL")
def f6(spark, d):
    return t(spark, d, "pages").groupBy(X.host_of(F.col("url")).alias("host"), X.path_head(F.col("url")).alias("head")).agg(F.count("*").alias("pages"))


@query("f7_video_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(md5(source || doc_id), 1, 11) WHEN doc_id % 3 = 1 THEN substr(md5(lang || doc_id), 1, 11) END AS id FROM documents")
def f7(spark, d):
    a, b = (F.substring(F.md5(F.concat(c, F.col("doc_id").cast("string"))), 1, 11) for c in ("source", "lang"))
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://example.org/watch?v="), a, F.lit("&t=3"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), b)).otherwise(F.lit("https://example.org/about"))
    return t(spark, d, "documents").select("doc_id", X.video_id(link).alias("id"))


@query("f8_valid_ids", "SELECT page_id, regexp_full_match(replace(url, '/', ''), '[A-Za-z0-9_-]+') AS ok, regexp_full_match(md5(url), '[A-Za-z0-9_-]+') AS hash_ok FROM pages")
def f8(spark, d):
    from strandline.operators.contracts import valid_id

    return t(spark, d, "pages").select("page_id", valid_id(F.regexp_replace("url", "/", "")).alias("ok"), valid_id(F.md5("url")).alias("hash_ok"))


@query("f9_conditions", f"{SC} SELECT CASE WHEN cell = 'sham' THEN 'sham' WHEN label = 0 THEN 'real' ELSE generator || '/' || kind END AS condition, count(*) AS n FROM scores GROUP BY 1")
def f9(spark, d):
    c = X.condition(F.lit(None).cast("string"), F.col("cell") == "sham", F.col("label"), F.col("generator"), F.col("kind"))
    return scores(spark, d).groupBy(c.alias("condition")).agg(F.count("*").alias("n"))


@query("f10_targets", f"{SC} SELECT split, sum(label)::BIGINT AS ai, count(*) FILTER (cell = 'video') AS visual, count(*) FILTER (cell = 'audio') AS audio, count(*) FILTER (score2 > 0.9) AS mismatch FROM scores GROUP BY split")
def f10(spark, d):
    visual, audio = F.when(F.col("cell") == "video", True), F.when(F.col("cell") == "audio", True)
    mismatch = F.when(F.col("score2") > 0.9, F.array(F.lit(1))).when(F.col("score2") > 0.5, F.slice(F.array(F.lit(1)), 1, 0))
    return scores(spark, d).groupBy("split").agg(*[F.sum(X.target(n, F.col("label"), visual, audio, mismatch)).alias(n) for n in ("ai", "visual", "audio", "mismatch")])


@query("f11_cohorts", f"{SC} SELECT split, count(*) AS n FROM scores s WHERE label = 0 OR NOT EXISTS (SELECT 1 FROM scores r WHERE r.split = 'train' AND r.label = 1 AND r.generator = s.generator AND r.score3 > 1.045) GROUP BY split")
def f11(spark, d):
    s = scores(spark, d)
    seen = s.filter("split = 'train' AND label = 1 AND score3 > 1.045").select("generator").distinct()
    return s.filter("label = 0").unionByName(s.filter("label = 1").join(F.broadcast(seen), "generator", "left_anti")).groupBy("split").agg(F.count("*").alias("n"))


@query("f12_held_out", f"{SC} SELECT split, generator, count(*) AS n FROM scores WHERE generator NOT IN ('g5', 'g6') OR split = 'test' GROUP BY ALL")
def f12(spark, d):
    return scores(spark, d).filter(~F.col("generator").isin("g5", "g6") | (F.col("split") == "test")).groupBy("split", "generator").agg(F.count("*").alias("n"))


@query("f13_glob_allow_list", f"{SC} SELECT generator, count(*) AS n FROM scores WHERE label = 0 OR generator GLOB 'g[12]' OR generator GLOB '?4' GROUP BY generator")
def f13(spark, d):
    g = F.col("generator")
    keep = (F.col("label") == 0) | X.glob_like(g, "g1") | X.glob_like(g, "*2") | X.glob_like(g, "?4")
    return scores(spark, d).filter(keep).groupBy("generator").agg(F.count("*").alias("n"))


@query("f16_error_triage", "SELECT CASE WHEN contains(lower(m), 'face') THEN 'no_face' WHEN contains(lower(m), 'memory') THEN 'memory' WHEN contains(lower(m), 'timeout') THEN 'timeout' ELSE 'stop' END AS kind, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'No FACE found' WHEN 'view' THEN 'out of Memory' WHEN 'error' THEN 'Timeout!' ELSE event_type END AS m FROM events) GROUP BY 1")
def f16(spark, d):
    m = F.when(F.col("event_type") == "click", "No FACE found").when(F.col("event_type") == "view", "out of Memory").when(F.col("event_type") == "error", "Timeout!").otherwise(F.col("event_type"))
    return t(spark, d, "events").groupBy(X.error_kind(m).alias("kind")).agg(F.count("*").alias("n"))


@query("f17_in_list", f"{C} SELECT count(*) AS clips, round(sum(duration_s), 2) AS seconds FROM clips WHERE speaker_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) AND decision = 'keep'")
def f17(spark, d):
    ids = t(spark, d, "supplier").filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("speaker_id"))
    return clips(spark, d).filter("decision = 'keep'").join(ids, "speaker_id", "left_semi").agg(F.count("*").alias("clips"), F.round(F.sum("duration_s"), 2).alias("seconds"))


@query("f18_prefix_test", "SELECT p_brand, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY p_brand")
def f18(spark, d):
    return t(spark, d, "part").filter(F.col("p_brand").startswith("Brand#1")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("f19_ready_speakers", f"{C}, k AS (SELECT speaker_id, count(*) FILTER (decision = 'keep') AS keep FROM clips GROUP BY speaker_id) SELECT s_suppkey AS speaker_id, coalesce(keep, 0) AS keep FROM supplier LEFT JOIN k ON speaker_id = s_suppkey WHERE s_acctbal > 0 AND coalesce(keep, 0) BETWEEN 100 AND 400")
def f19(spark, d):
    k = clips(spark, d).groupBy("speaker_id").agg(F.count_if(F.col("decision") == "keep").alias("keep"))
    s = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("speaker_id")).join(k, "speaker_id", "left").na.fill(0, ["keep"])
    return s.filter(F.col("keep").between(100, 400))


@query("f20_label_blocks", f"{SC} SELECT sample_id, label, cell = 'video' AS synthetic_visual, cell = 'audio' AS synthetic_audio, CASE WHEN label = 1 THEN 1 ELSE 0 END AS spans, CASE WHEN label = 1 THEN CASE WHEN kind = 'O' THEN 4.0 - 1.0 ELSE 4.0 END ELSE 0.0 END::DOUBLE AS fake_seconds FROM scores")
def f20(spark, d):
    begin, end = F.when(F.col("kind") == "O", 1.0), F.when(F.col("kind") == "O", 4.0)
    s = scores(spark, d).withColumn("l", X.labels(F.col("cell"), F.lit(4.0), begin, end))
    seconds = F.aggregate("l.fake_intervals", F.lit(0.0), lambda acc, x: acc + x["b"] - x["a"])
    return s.select("sample_id", F.col("l.label").alias("label"), "l.synthetic_visual", "l.synthetic_audio", F.size("l.fake_intervals").alias("spans"), seconds.alias("fake_seconds"))


# --- sources ---------------------------------------------------------------------------------------------------------


@query("s2_named_parameters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def s2(spark, d):
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > :low AND o_orderstatus = :status GROUP BY o_orderpriority", args={"low": 100000, "status": "F"}, orders=t(spark, d, "orders"))


@query("s4_scalar", "SELECT max(o_totalprice) AS top, (SELECT count(*) FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) AS above FROM orders")
def s4(spark, d):
    o = t(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    return o.crossJoin(F.broadcast(mean)).agg(F.max("o_totalprice").alias("top"), F.count_if(F.col("o_totalprice") > F.col("m")).alias("above"))


@query("s8_union_parts", f"{SC} SELECT generator AS dataset_part, count(DISTINCT sample_id) AS n FROM scores GROUP BY generator")
def s8(spark, d):
    s = scores(spark, d).withColumn("sha256", F.sha2(F.col("sample_id").cast("string"), 256))
    parts = [(g, s.filter(F.col("generator") == g).dropDuplicates(["sample_id"])) for g in (f"g{i}" for i in range(7))]
    return manifests.union_parts(parts).groupBy("dataset_part").agg(F.count("*").alias("n"))


@query("s12_layered_caches", "SELECT c_custkey AS k, CASE WHEN s_suppkey IS NOT NULL THEN 'a' ELSE 'b' END AS root FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def s12(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("a").alias("root"))
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("b").alias("root"))
    return manifests.layered([a, b], "k")


@query("s19_search_dedupe", "SELECT text AS title, arg_min(doc_id, struct_pack(q := source, i := doc_id)) AS first, min(source) AS query FROM documents WHERE NOT regexp_matches(text, 'Licensed|token') AND source IS NOT NULL GROUP BY text")
def s19(spark, d):
    rows = t(spark, d, "documents").filter(~F.col("text").rlike("Licensed|token") & F.col("source").isNotNull())
    return S.first_of_each(rows, ["text"], ["source", "doc_id"]).select(F.col("text").alias("title"), F.col("doc_id").alias("first"), F.col("source").alias("query"))


@query("s21_retry_list", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def s21(spark, d):
    o = t(spark, d, "orders")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    by = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return c.join(by("P"), "id", "left_semi").join(by("F"), "id", "left_anti")


@query("s22_run_loader", f"{SC} SELECT run, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT 'a' AS run, sample_id, score FROM scores UNION ALL SELECT 'b', sample_id, score2 FROM scores) GROUP BY run")
def s22(spark, d):
    s = scores(spark, d)
    runs = manifests.scored_runs([("a", s.select("sample_id", "score")), ("b", s.select("sample_id", F.col("score2").alias("score")))])
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


# --- joins, windows, selection ---------------------------------------------------------------------------------------


@query("j5_clips_by_location", f"WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT batch, count(*) AS clips FROM clips JOIN videos USING (video_id) WHERE status <> 'P' GROUP BY batch")
def j5(spark, d):
    return clips(spark, d).join(videos(spark, d).filter("status != 'P'").select("video_id", "batch"), "video_id").groupBy("batch").agg(F.count("*").alias("clips"))


@query("j7_completeness", f"WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT status, count(*) AS missing FROM videos WHERE video_id NOT IN (SELECT video_id FROM clips) GROUP BY status")
def j7(spark, d):
    return T.pending(videos(spark, d), clips(spark, d), "video_id").groupBy("status").agg(F.count("*").alias("missing"))


@query("j11_clip_lookups", f"WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT clip_id, upload_date, s_name AS speaker FROM clips JOIN videos USING (video_id) JOIN supplier ON s_suppkey = speaker_id WHERE decision = 'keep'")
def j11(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_name").alias("speaker"))
    return clips(spark, d).filter("decision = 'keep'").join(videos(spark, d).select("video_id", "upload_date"), "video_id").join(s, "speaker_id").select("clip_id", "upload_date", "speaker")


@query("j18_words_round_span", f"{FR}, s AS (SELECT sample_id, max(frame) / 2 AS mid FROM frames GROUP BY sample_id) SELECT f.sample_id, count(*) FILTER (frame < mid - 5) AS before, count(*) FILTER (frame BETWEEN mid - 5 AND mid + 5) AS inside, count(*) FILTER (frame > mid + 5) AS after FROM frames f JOIN s USING (sample_id) GROUP BY f.sample_id")
def j18(spark, d):
    f = frames(spark, d)
    mid = f.groupBy("sample_id").agg((F.max("frame") / 2).alias("mid"))
    x = F.col("frame")
    return f.join(mid, "sample_id").groupBy("sample_id").agg(F.count_if(x < F.col("mid") - 5).alias("before"), F.count_if(x.between(F.col("mid") - 5, F.col("mid") + 5)).alias("inside"), F.count_if(x > F.col("mid") + 5).alias("after"))


@query("w5_precision_envelope", f"""{SC}, r AS (SELECT sample_id, label, score3, sum(label) OVER o AS tp, row_number() OVER o AS n FROM scores WHERE split = 'test' WINDOW o AS (ORDER BY score3 DESC, sample_id ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, max(tp / n) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, sum(label) OVER () AS p FROM r) SELECT round(sum(CASE WHEN label = 1 THEN env / p ELSE 0 END), 5) AS ap, count(*) AS n FROM e""")
def w5(spark, d):
    s = scores(spark, d).filter("split = 'test'").select("sample_id", "label", "score3")
    r = R.running(s.select(F.struct("score3", (-F.col("sample_id")).alias("i")).alias("at"), "label", F.lit(1).alias("one")), [], "at", {"tp": "label", "n": "one"}, descending=True)
    e = R.highest_after(r.withColumn("pr", F.col("tp") / F.col("n")), "at", "pr", "env")
    return e.agg(F.round(F.sum(F.when(F.col("label") == 1, F.col("env")).otherwise(0.0)) / F.sum("label"), 5).alias("ap"), F.count("*").alias("n"))


@query("w7_neighbour_context", f"{FR} SELECT f.sample_id, f.frame, round(sum(g.value), 2) AS context, count(*) AS n FROM frames f JOIN frames g ON g.sample_id = f.sample_id AND abs(g.frame - f.frame) BETWEEN 3 AND 25 GROUP BY f.sample_id, f.frame")
def w7(spark, d):
    w = Window.partitionBy("sample_id").orderBy("frame")
    left, right = w.rowsBetween(-25, -3), w.rowsBetween(3, 25)
    f = frames(spark, d).withColumns({"s": F.coalesce(F.sum("value").over(left), F.lit(0.0)) + F.coalesce(F.sum("value").over(right), F.lit(0.0)), "n": F.count("value").over(left) + F.count("value").over(right)})
    return f.filter("n > 0").select("sample_id", "frame", F.round("s", 2).alias("context"), "n")


@query("l8_quota_left", f"{C}, q AS (SELECT speaker_id, count(*) FILTER (decision = 'keep') AS done FROM clips GROUP BY speaker_id) SELECT speaker_id, greatest(0, 300 - done) AS left_ FROM q")
def l8(spark, d):
    q = clips(spark, d).groupBy("speaker_id").agg(F.count_if(F.col("decision") == "keep").alias("done"))
    return q.select("speaker_id", F.greatest(F.lit(0), 300 - F.col("done")).alias("left_"))


@query("l10_best_pause", f"{FR} SELECT sample_id, arg_max(frame, struct_pack(v := round(value, 6), f := frame)) AS at FROM frames WHERE frame BETWEEN 10 AND 40 GROUP BY sample_id")
def l10(spark, d):
    return frames(spark, d).filter(F.col("frame").between(10, 40)).groupBy("sample_id").agg(F.max_by("frame", F.struct(F.round("value", 6), F.col("frame"))).alias("at"))


@query("l11_nearest", """WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), n AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM v),
  s AS (SELECT label, i, sum(x) AS s FROM v GROUP BY ALL), c AS (SELECT label AS owner, i, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS c FROM s), m AS (SELECT vec_id, owner, round(sum(u * c), 9) AS sim FROM n JOIN c USING (i) GROUP BY ALL)
  SELECT vec_id, owner, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, owner) AS place FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, owner) <= 3""")
def l11(spark, d):
    from strandline.operators import vectors as E

    v = t(spark, d, "embeddings")
    c = E.centroids(v, "label", "embedding").select(F.col("label").alias("owner"), "centroid")
    sims = v.select("vec_id", E.normalized(F.col("embedding")).alias("u")).join(F.broadcast(c), F.size("u") == F.size("centroid")).select("vec_id", "owner", F.round(E.dot(F.col("u"), F.col("centroid")), 9).alias("sim"))
    return sims.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "owner")).cast("long")).filter("place <= 3").select("vec_id", "owner", "place")


@query("l12_measured_sample", f"{C}, r AS (SELECT speaker_id, clip_id, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) - 1 AS i, count(*) OVER (PARTITION BY speaker_id) AS n FROM clips) SELECT speaker_id, clip_id FROM r WHERE n <= 5 OR i IN (SELECT round_even(j * (n - 1) / 4.0::DOUBLE, 0) FROM range(0, 5) x(j))")
def l12(spark, d):
    return S.spread(clips(spark, d), ["speaker_id"], ["clip_id"], 5).select("speaker_id", "clip_id")


# --- state, reports, supplementary -----------------------------------------------------------------------------------


@query("x10_skip_streaks", f"{FR}, i AS (SELECT *, frame - row_number() OVER (PARTITION BY sample_id ORDER BY frame) AS g FROM frames WHERE event_type = 'error'), s AS (SELECT sample_id, g, count(*) AS n FROM i GROUP BY ALL) SELECT sample_id, max(n) AS longest, max(n) >= 3 AS tripped FROM s GROUP BY sample_id")
def x10(spark, d):
    r = I.runs(frames(spark, d), "sample_id", "frame", F.col("event_type") == "error").groupBy("sample_id", "run").agg(F.count("*").alias("n"))
    return r.groupBy("sample_id").agg(F.max("n").alias("longest"), (F.max("n") >= 3).alias("tripped"))


@query("x8_finalize", f"""{SC}, k AS (SELECT s.split, s.cell, s.score FROM (SELECT DISTINCT * FROM scores) s LEFT JOIN labels l ON l.doc_id = s.source_clip_id WHERE coalesce(l.quality, 1) = 1)
  SELECT 'row' AS what, split || '/' || cell AS name, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'problem', 'range', count(*) FILTER (score > 0.55) FROM k""")
def x8(spark, d):
    s = scores(spark, d).distinct()
    row = F.struct("sample_id", "split", "cell", "score", "source_clip_id")
    records = s.groupBy("speaker_id").agg(F.collect_list(row).alias("rows"))
    decided = t(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("source_clip_id"), F.lit("reject").alias("decision")).distinct()
    kept, problems = T.finalize(records.select("speaker_id"), records, decided, "speaker_id", "rows", "source_clip_id", {"range": F.col("score") <= 0.55})
    counts = kept.groupBy(F.concat_ws("/", "split", "cell").alias("name")).agg(F.count("*").alias("n")).select(F.lit("row").alias("what"), "name", "n")
    return counts.unionByName(problems.groupBy(F.col("problem").alias("name")).agg(F.count("*").alias("n")).select(F.lit("problem").alias("what"), "name", "n"))


@query("x12_attach_caches", "WITH a AS (SELECT s_suppkey AS k, 'suppliers' AS source FROM supplier UNION ALL SELECT c_custkey, 'customers' FROM customer) SELECT k, source, count(*) OVER (PARTITION BY k) > 1 AS shared FROM a")
def x12(spark, d):
    sources = [("suppliers", t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))), ("customers", t(spark, d, "customer").select(F.col("c_custkey").alias("k")))]
    return T.attach(sources, "k", strict=False)


@query("u1_lock_history", """WITH l AS (SELECT l_orderkey AS clip, l_returnflag AS split, l_orderkey % 4 + 1 AS part FROM lineitem WHERE l_orderkey % 4 <> 1), o AS (SELECT * FROM l WHERE part < 4), g AS (SELECT clip, count(DISTINCT split) AS n, min(split) AS split FROM o GROUP BY clip)
  SELECT 'split/' || split AS what, count(*) AS n FROM g WHERE n = 1 GROUP BY 1 UNION ALL SELECT 'problem/splits', count(*) FROM g WHERE n > 1 UNION ALL SELECT 'problem/part', count(*) FROM (SELECT unnest(range(1, 4)) AS p EXCEPT SELECT part FROM o)""")
def u1(spark, d):
    locks = t(spark, d, "lineitem").filter("l_orderkey % 4 != 1").select(F.col("l_orderkey").alias("clip"), F.col("l_returnflag").alias("split"), (F.col("l_orderkey") % 4 + 1).alias("part"))
    agreed, problems = T.lock_history(locks, "clip", "split", "part", 4)
    names = agreed.select(F.concat(F.lit("split/"), "split").alias("what")).unionByName(problems.select(F.concat(F.lit("problem/"), "problem").alias("what")))
    return names.groupBy("what").agg(F.count("*").alias("n"))


@query("u3_effective_lag", "SELECT event_type, sum(CASE WHEN coalesce(st, 'unmeasured') IN ('ok', 'few') THEN lag ELSE 0 END)::BIGINT AS lags FROM (SELECT event_type, event_id % 7 AS lag, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'few' WHEN 2 THEN 'bad' END AS st FROM events) GROUP BY event_type")
def u3(spark, d):
    k = F.col("event_id") % 4
    status = F.when(k == 0, "ok").when(k == 1, "few").when(k == 2, "bad")
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(X.effective_lag(status, F.col("event_id") % 7)).alias("lags"))


@query("u4_least_error_donor", f"{C} SELECT video_id, arg_min(clip_id, struct_pack(e := round(abs(duration_s - 5), 9), c := clip_id)) AS donor FROM clips GROUP BY video_id")
def u4(spark, d):
    return clips(spark, d).groupBy("video_id").agg(F.min_by("clip_id", F.struct(F.round(F.abs(F.col("duration_s") - 5), 9), F.col("clip_id"))).alias("donor"))


@query("u5_finished_engines", f"{SC} SELECT DISTINCT generator FROM scores WHERE generator IN (SELECT generator FROM scores WHERE score > 0.55 AND kind = 'F')")
def u5(spark, d):
    s = scores(spark, d)
    return s.select("generator").distinct().join(s.filter("score > 0.55 AND kind = 'F'"), "generator", "left_semi")


@query("u9_frame_gate", f"""{FR}, i AS (SELECT *, frame - row_number() OVER (PARTITION BY sample_id ORDER BY frame) AS g FROM frames WHERE NOT valid), r AS (SELECT sample_id, g, count(*) AS n FROM i GROUP BY ALL), b AS (SELECT sample_id, sum(n) AS bad, max(n) AS run FROM r GROUP BY ALL), n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL)
  SELECT n.sample_id, CASE WHEN coalesce(run, 0) > 3 THEN 'run' WHEN coalesce(bad, 0) > 0.3 * n THEN 'bad' ELSE 'ok' END AS verdict FROM n LEFT JOIN b USING (sample_id)""")
def u9(spark, d):
    f = frames(spark, d)
    r = I.runs(f, "sample_id", "frame", ~F.col("valid")).groupBy("sample_id", "run").agg(F.count("*").alias("c"))
    b = r.groupBy("sample_id").agg(F.sum("c").alias("bad"), F.max("c").alias("longest"))
    n = f.groupBy("sample_id").agg(F.count("*").alias("n")).join(b, "sample_id", "left").na.fill(0)
    return n.select("sample_id", F.when(F.col("longest") > 3, "run").when(F.col("bad") > 0.3 * F.col("n"), "bad").otherwise("ok").alias("verdict"))


@query("u14_video_summaries", f"{C}, p AS (SELECT video_id, sum(duration_s) AS s, count(*) AS n, count(*) FILTER (decision = 'keep') AS k, count(*) FILTER (decision = 'reject') AS r, count(*) FILTER (decision = 'pending') AS w FROM clips GROUP BY video_id) SELECT video_id, round(s, 3) AS speech_s, n AS inspected, k AS accepted, concat_ws(',', CASE WHEN w > 0 THEN 'pending=' || w END, CASE WHEN r > 0 THEN 'reject=' || r END) AS rejected, greatest(1, least(6, floor(s / 10)))::BIGINT AS quota FROM p")
def u14(spark, d):
    c = clips(spark, d)
    reasons = c.filter("decision != 'keep'").groupBy("video_id", "decision").agg(F.count("*").alias("n")).groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("decision", "n"))).alias("rejected"))
    placed = c.select("video_id", "duration_s", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    seconds = T.sums_in_order(placed, ["video_id"], {"s": F.col("duration_s")}, ["file", "row"])  # quotas are cut at whole tens, where the last bit counts
    out = T.conditional_rollup(c, ["video_id"], {}, {"accepted": F.col("decision") == "keep"})
    for part in (seconds, reasons):  # a null video is a group, too
        out = out.join(part.withColumnRenamed("video_id", "_video"), F.col("video_id").eqNullSafe(F.col("_video")), "left").drop("_video")
    shown = F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("rejected")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit(""))
    return out.select("video_id", F.round("s", 3).alias("speech_s"), F.col("rows").alias("inspected"), "accepted", shown.alias("rejected"), F.greatest(F.lit(1), F.least(F.lit(6), F.floor(F.col("s") / 10))).cast("long").alias("quota"))


@query("u19_speaker_index", f"{SC} SELECT DISTINCT speaker_id, dense_rank() OVER (ORDER BY speaker_id) - 1 AS i FROM scores WHERE split = 'train'")
def u19(spark, d):
    s = scores(spark, d).filter("split = 'train'").select("speaker_id").distinct()
    return R.numbered(s, [F.col("speaker_id")], "i").withColumn("i", F.col("i") - 1)


@query("u20_aligned_series", f"""{FR}, b AS (SELECT sample_id, frame, value AS other, event_id % 7 <> 0 AS ok FROM frames WHERE frame < 30 + sample_id), n AS (SELECT sample_id, least(max(a.frame), (SELECT max(b.frame) FROM b WHERE b.sample_id = a.sample_id)) AS n FROM frames a GROUP BY sample_id)
  SELECT a.sample_id, count(*) AS frames, count(*) FILTER (a.valid AND b.ok) AS valid, round(sum(other), 3) AS other FROM frames a JOIN n USING (sample_id) JOIN b ON b.sample_id = a.sample_id AND b.frame = a.frame WHERE a.frame <= n GROUP BY a.sample_id""")
def u20(spark, d):
    f = frames(spark, d)
    other = f.filter(F.col("frame") < 30 + F.col("sample_id")).select("sample_id", "frame", F.col("value").alias("other"), (F.col("event_id") % 7 != 0).alias("valid"))
    out = E.aligned(f.select("sample_id", "frame", "valid"), other, "sample_id", "frame", "valid")
    return out.groupBy("sample_id").agg(F.count("*").alias("frames"), F.count_if("valid").alias("valid"), F.round(F.sum("other"), 3).alias("other"))


@query("u21_padded_series", f"{FR}, m AS (SELECT max(frame) AS m FROM frames), g AS (SELECT DISTINCT sample_id, x.i FROM frames, m, range(0, 1000) x(i) WHERE x.i <= m) SELECT g.sample_id, count(*) AS length, count(f.frame) AS present FROM g LEFT JOIN frames f ON f.sample_id = g.sample_id AND f.frame = g.i GROUP BY g.sample_id")
def u21(spark, d):
    f = frames(spark, d)
    longest = f.agg(F.max("frame").alias("m"))
    grid = f.select("sample_id").distinct().crossJoin(F.broadcast(longest)).select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("frame"))
    return grid.join(f.select("sample_id", "frame", F.lit(1).alias("p")), ["sample_id", "frame"], "left").groupBy("sample_id").agg(F.count("*").alias("length"), F.count("p").alias("present"))


@query("u23_report_extracts", f"""{SC}, v AS (SELECT * FROM scores WHERE split = 'validation'), g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM v GROUP BY score), k AS (SELECT score, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT 'roc' AS kind, round((fp / n)::DOUBLE, 6) AS x, round((tp / p)::DOUBLE, 6) AS y FROM k UNION ALL SELECT 'pr', round((tp / p)::DOUBLE, 6), round((tp / (tp + fp))::DOUBLE, 6) FROM k
  UNION ALL SELECT 'bin', least(19, floor(score * 20))::DOUBLE, count(*)::DOUBLE FROM v GROUP BY 2 UNION ALL SELECT 'confusion', (label * 2 + (score >= 0.25)::INT)::DOUBLE, count(*)::DOUBLE FROM v GROUP BY 2 UNION ALL SELECT 'example', label::DOUBLE, min(sample_id)::DOUBLE FROM v GROUP BY label""")
def u23(spark, d):
    return R.extracts(scores(spark, d).filter("split = 'validation'"), "sample_id", 0.25).select("kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("u27_cost_model", "WITH m AS (SELECT event_type, count(*) AS n, 16 * (min(event_id) % 4 + 1) AS batch, avg(value) / 1000 AS step_s, count(DISTINCT user_id) AS seeds FROM events GROUP BY event_type) SELECT event_type, ceil(n / batch)::BIGINT AS steps, round(ceil(n / batch) * step_s * (3 + 2 * 1)::DOUBLE, 4) AS epoch_s, round(ceil(n / batch) * step_s * 5 * seeds / 3600, 5) AS hours FROM m")
def u27(spark, d):
    m = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (16 * (F.min("event_id") % 4 + 1)).alias("batch"), (F.avg("value") / 1000).alias("step_s"), F.countDistinct("user_id").alias("seeds"))
    cost = X.training_cost(F.col("n"), F.col("batch"), F.col("step_s"), F.col("seeds"), train=3.0, evaluate=1.0)
    return m.select("event_type", cost["steps"].alias("steps"), F.round(cost["epoch_s"], 4).alias("epoch_s"), F.round(cost["hours"], 5).alias("hours"))


@query("ts11_sync_flags", f"{C}, {VIDEOS_SQL} SELECT clip_id, CASE WHEN status = 'P' THEN 'reject' ELSE decision END AS decision, CASE WHEN status = 'P' THEN 'sync_bad' WHEN status = 'O' THEN 'sync_unmeasured' ELSE '' END AS flags FROM clips LEFT JOIN videos USING (video_id)")
def ts11(spark, d):
    status = videos(spark, d).select("video_id", F.when(F.col("status") == "P", "bad").when(F.col("status") == "F", "ok").alias("sync"))
    joined = clips(spark, d).join(status, "video_id", "left")
    flagged = X.sync_verdict(F.col("decision"), F.lit(""), F.col("sync"))
    return joined.select("clip_id", flagged["decision"].alias("decision"), flagged["flags"].alias("flags"))


@query("ts14_segment_replacement", f"{FR}, s AS (SELECT DISTINCT sample_id, sample_id % 5 + 3 AS a, sample_id % 5 + 12 AS b, sample_id + 1 AS donor FROM frames) SELECT f.sample_id, f.frame, round(CASE WHEN f.frame BETWEEN a AND b THEN coalesce(g.value, f.value) ELSE f.value END, 5) AS value, f.frame BETWEEN a AND b AND g.value IS NOT NULL AS replaced FROM frames f JOIN s USING (sample_id) LEFT JOIN frames g ON g.sample_id = s.donor AND g.frame = f.frame")
def ts14(spark, d):
    f = frames(spark, d).select("sample_id", "frame", "value")
    k = F.col("sample_id") % 5
    segments = f.select("sample_id").distinct().select("sample_id", (k + 3).alias("a"), (k + 12).alias("b"), (F.col("sample_id") + 1).alias("donor"))
    return E.replaced(f, segments, "sample_id", "frame", "value").select("sample_id", "frame", F.round("value", 5).alias("value"), "replaced")


@query("ts22_audio_validity", f"{FR} SELECT sample_id, frame // 10 AS block, avg(valid::INT) >= 0.95 AS ok FROM frames GROUP BY ALL")
def ts22(spark, d):
    return frames(spark, d).groupBy("sample_id", F.floor(F.col("frame") / 10).alias("block")).agg((F.avg(F.col("valid").cast("double")) >= 0.95).alias("ok"))


@query("ts24_adaptive_bins", f"{FR}, n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL) SELECT f.sample_id, frame * 8 // n AS bin, round(avg(value), 5) AS value FROM frames f JOIN n USING (sample_id) GROUP BY ALL")
def ts24(spark, d):
    f = frames(spark, d)
    n = f.groupBy("sample_id").agg(F.count("*").alias("n"))
    return f.join(n, "sample_id").groupBy("sample_id", F.floor(F.col("frame") * 8 / F.col("n")).alias("bin")).agg(F.round(F.avg("value"), 5).alias("value"))


@query("b8_auc_by_model_task", f"""{SC}, u AS (SELECT generator AS model, 'score' AS task, score AS s, label FROM scores UNION ALL SELECT generator, 'score2', score2, label FROM scores), g AS (SELECT model, task, s, sum(label) AS pos, sum(1 - label) AS neg FROM u GROUP BY ALL),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY model, task ORDER BY s) - neg / 2.0 AS below FROM g) SELECT model, task, round((sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 6) AS auc FROM c GROUP BY ALL""")
def b8(spark, d):
    long = scores(spark, d).select(F.col("generator").alias("model"), "label", F.expr("stack(2, 'score', score, 'score2', score2) AS (task, score)"))
    return R.auc(long, ["model", "task"]).select("model", "task", F.round("auc", 6).alias("auc"))


@query("b4_clip_bootstrap")
def b4(spark, d):
    return B.paired_delta(scores(spark, d), "source_clip_id", "score2", "score3", replicates=2000)


@query("m24_real_alarm_summary", f"{SC} SELECT split, round(avg((score >= 0.3)::INT), 6) AS alarm_rate, count(*) AS real, round(count(*) FILTER (score >= 0.3) / (count(*) * 4.0 / 3600), 4) AS per_hour FROM scores WHERE label = 0 GROUP BY split")
def m24(spark, d):
    hit = F.col("score") >= 0.3
    return scores(spark, d).filter("label = 0").groupBy("split").agg(F.round(F.avg(hit.cast("double")), 6).alias("alarm_rate"), F.count("*").alias("real"), F.round(F.count_if(hit) / (F.count("*") * 4.0 / 3600), 4).alias("per_hour"))


@query("k10_batch_links", f"{V} SELECT batch, video_id, 'https://video.example/' || video_id AS link, upload_date, round(duration_s / 60, 1) AS minutes FROM videos JOIN customer ON c_custkey = input_id")
def k10(spark, d):
    inputs = t(spark, d, "customer").select(F.col("c_custkey").alias("input_id"))
    joined = videos(spark, d).join(inputs, "input_id")
    return joined.select("batch", "video_id", F.concat(F.lit("https://video.example/"), F.col("video_id").cast("string")).alias("link"), "upload_date", F.round(F.col("duration_s") / 60, 1).alias("minutes"))


@query("streaming_file_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_file_sink(spark, d):
    """The streaming addition: the table's files read as a stream into a file sink, then counted by type."""
    from strandline.session import scratch_path

    base = t(spark, d, "events")
    stream = spark.readStream.schema(base.schema).parquet(f"{d}/events.parquet*")
    out, marks = scratch_path(spark, "stream"), scratch_path(spark, "marks")
    q = stream.select("event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
