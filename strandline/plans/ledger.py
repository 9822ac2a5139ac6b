"""Queries of the relational, selection and job-state operators (survey 2.3 to 2.8, 2.13, 2.17)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import selection as S
from strandline.operators import tables as T
from strandline.operators.ranking import numbered
from strandline.plans.base import CLIPS_SQL, SCORES_SQL, VIDEOS_SQL, clips, query, scores, t, videos

V, C = f"WITH {VIDEOS_SQL}", f"WITH {CLIPS_SQL}"


@query("a1_count_by_status", f"{V} SELECT status, count(*) AS videos FROM videos GROUP BY status")
def a1(spark, d):
    return videos(spark, d).groupBy("status").agg(F.count("*").alias("videos"))


@query("a2_batch_conditional_sums", f"""{V} SELECT batch, count(*) AS rows, round(sum(duration_s) / 3600, 4) AS hours, round(sum(CASE WHEN status = 'F' THEN size_mb ELSE 0 END) / 1000.0, 4) AS done_gb,
  count(*) FILTER (status = 'F') AS done, count(*) FILTER (status = 'O') AS open FROM videos GROUP BY batch""")
def a2(spark, d):
    out = T.conditional_rollup(videos(spark, d), ["batch"], {"s": F.col("duration_s"), "m": F.when(F.col("status") == "F", F.col("size_mb"))}, {"done": F.col("status") == "F", "open": F.col("status") == "O"})
    return out.select("batch", "rows", F.round(F.col("s") / 3600, 4).alias("hours"), F.round(F.col("m") / 1000, 4).alias("done_gb"), "done", "open")


@query("a3_batch_rollup", f"{V} SELECT batch, count(*) AS videos, round(sum(duration_s) / 3600, 2) AS hours FROM videos GROUP BY batch")
def a3(spark, d):
    return videos(spark, d).groupBy("batch").agg(F.count("*").alias("videos"), F.round(F.sum("duration_s") / 3600, 2).alias("hours"))


@query("a4_keep_per_speaker", f"{C} SELECT speaker_id, count(*) AS keep FROM clips WHERE decision = 'keep' GROUP BY speaker_id")
def a4(spark, d):
    return clips(spark, d).filter("decision = 'keep'").groupBy("speaker_id").agg(F.count("*").alias("keep"))


@query("a5_count_and_keep", f"{C} SELECT speaker_id, count(*) AS clips, count(*) FILTER (decision = 'keep') AS keep FROM clips GROUP BY speaker_id")
def a5(spark, d):
    return T.conditional_rollup(clips(spark, d), ["speaker_id"], {}, {"keep": F.col("decision") == "keep"}).withColumnRenamed("rows", "clips")


@query("a6_status_document", f"""WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM videos WHERE status = 'F') AS done, (SELECT round(sum(duration_s) / 3600, 3) FROM videos) AS hours,
  (SELECT count(DISTINCT input_id) FROM videos) AS inputs, (SELECT count(*) FROM clips) AS clips, (SELECT count(*) FROM clips WHERE decision = 'keep') AS keep, (SELECT count(DISTINCT speaker_id) FROM clips) AS speakers, (SELECT max(batch) FROM videos) AS batches""")
def a6(spark, d):
    v = videos(spark, d).agg(F.count("*").alias("videos"), F.count_if(F.col("status") == "F").alias("done"), F.round(F.sum("duration_s") / 3600, 3).alias("hours"), F.countDistinct("input_id").alias("inputs"), F.max("batch").alias("batches"))
    c = clips(spark, d).agg(F.count("*").alias("clips"), F.count_if(F.col("decision") == "keep").alias("keep"), F.countDistinct("speaker_id").alias("speakers"))
    return v.crossJoin(c)


@query("a7_next_batch", f"WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT 'download' AS step, min(batch) AS batch FROM videos WHERE status = 'O' UNION ALL SELECT 'review', min(batch) FROM videos WHERE video_id IN (SELECT video_id FROM clips WHERE decision = 'pending')")
def a7(spark, d):
    v = videos(spark, d)
    waiting = clips(spark, d).filter("decision = 'pending'").select("video_id")
    return v.filter("status = 'O'").agg(F.min("batch").alias("batch")).select(F.lit("download").alias("step"), "batch").unionByName(v.join(waiting, "video_id", "left_semi").agg(F.min("batch").alias("batch")).select(F.lit("review").alias("step"), "batch"))


@query("a8_surrogate_keys", "SELECT c_custkey AS c, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS s_suppkey, 'spk_' || lpad(CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS VARCHAR), greatest(6, 1), '0') AS s_suppkey_id FROM customer")
def a8(spark, d):
    return T.next_keys(t(spark, d, "customer").select(F.col("c_custkey").alias("c")), t(spark, d, "supplier"), "s_suppkey", [F.col("c")], width=6)


@query("a9_packing_state", f"{V} SELECT round(sum(duration_s), 3) AS seconds, round(sum(size_mb), 3) AS mb, max(batch) AS last_batch FROM videos")
def a9(spark, d):
    return videos(spark, d).agg(F.round(F.sum("duration_s"), 3).alias("seconds"), F.round(F.sum("size_mb"), 3).alias("mb"), F.max("batch").alias("last_batch"))


@query("a10_plan_counters", f"WITH {SCORES_SQL} SELECT 'cell' AS dim, cell AS value, count(*) AS rows FROM scores GROUP BY cell UNION ALL SELECT 'generator', generator, count(*) FROM scores GROUP BY generator UNION ALL SELECT 'split', split, count(*) FROM scores GROUP BY split")
def a10(spark, d):
    return T.counts_by_dimension(scores(spark, d), ["cell", "generator", "split"])


@query("a11_split_gender_cube", f"WITH {SCORES_SQL} SELECT split, gender, count(*) AS n, count(DISTINCT speaker_id) AS speakers FROM scores GROUP BY CUBE (split, gender)")
def a11(spark, d):
    return scores(spark, d).cube("split", "gender").agg(F.count("*").alias("n"), F.countDistinct("speaker_id").alias("speakers"))


@query("a14_part_receipts", f"WITH {SCORES_SQL} SELECT generator AS part, count(*) AS samples, count(DISTINCT source_clip_id) AS sources, min(sample_id) AS first_id FROM scores GROUP BY generator")
def a14(spark, d):
    return scores(spark, d).groupBy(F.col("generator").alias("part")).agg(F.count("*").alias("samples"), F.countDistinct("source_clip_id").alias("sources"), F.min("sample_id").alias("first_id"))


RULES_SQL = "CASE WHEN status = 'P' THEN 'pending' WHEN duration_s < 200 THEN 'too short' WHEN duration_s > 4000 THEN 'too long' WHEN size_mb < 30 THEN 'too small' WHEN upload_date < '19930101' THEN 'old' END"


def _rules():
    return T.first_failing([("pending", F.col("status") == "P"), ("too short", F.col("duration_s") < 200), ("too long", F.col("duration_s") > 4000), ("too small", F.col("size_mb") < 30), ("old", F.col("upload_date") < "19930101")])


@query("f1_first_failing_rule", f"{V} SELECT video_id, {RULES_SQL} AS reason FROM videos")
def f1(spark, d):
    return videos(spark, d).select("video_id", _rules().alias("reason"))


@query("a15_rejection_reasons", f"{V} SELECT reason, count(*) AS n FROM (SELECT {RULES_SQL} AS reason FROM videos) GROUP BY reason")
def a15(spark, d):
    return videos(spark, d).select(_rules().alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("a16_fallback_ratio", f"WITH {SCORES_SQL} SELECT cell, round(avg(CASE WHEN score2 < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM scores GROUP BY cell UNION ALL SELECT 'all', round(avg(CASE WHEN score2 < 0.2 THEN 1.0 ELSE 0.0 END), 6) FROM scores")
def a16(spark, d):
    low = F.round(F.avg((F.col("score2") < 0.2).cast("double")), 6).alias("ratio")
    s = scores(spark, d)
    return s.groupBy("cell").agg(low).unionByName(s.agg(low).select(F.lit("all").alias("cell"), "ratio"))


@query("a17_cache_quality", "SELECT event_type, round(avg(value), 5) AS mean_value, count(*) FILTER (value < 50) AS low, round(median(value), 5) AS median_value, round(count(*) FILTER (abs(value - 50) <= 10) / count(*), 6) AS near FROM events GROUP BY event_type")
def a17(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean_value"), F.count_if(F.col("value") < 50).alias("low"), F.round(F.median("value"), 5).alias("median_value"), F.round(F.count_if(F.abs(F.col("value") - 50) <= 10) / F.count("*"), 6).alias("near"))


@query("a18_provenance", "SELECT md5(event_type) AS signature, count(*) AS found, count(DISTINCT user_id) AS samples FROM events GROUP BY 1")
def a18(spark, d):
    return t(spark, d, "events").groupBy(F.md5("event_type").alias("signature")).agg(F.count("*").alias("found"), F.countDistinct("user_id").alias("samples"))


@query("a19_equal_weight_statistics", "WITH p AS (SELECT user_id, avg(value) AS m, avg(value * value) AS s FROM events GROUP BY user_id) SELECT round(avg(m), 5) AS mean, round(avg(s) - avg(m) * avg(m), 3) AS variance FROM p")
def a19(spark, d):
    per = t(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("s"))
    return per.agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.avg("s") - F.avg("m") * F.avg("m"), 3).alias("variance"))


@query("a20_percentile_profile", f"{C} SELECT decision, round(quantile_cont(duration_s, 0.1), 5) AS p10, round(quantile_cont(duration_s, 0.5), 5) AS p50, round(quantile_cont(duration_s, 0.9), 5) AS p90 FROM clips GROUP BY decision")
def a20(spark, d):
    q = F.percentile("duration_s", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return clips(spark, d).groupBy("decision").agg(q.alias("q")).select("decision", *[F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("a21_threshold_grid", f"WITH {SCORES_SQL}, g AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS conf), h AS (SELECT unnest([0.25, 0.5])::DOUBLE AS agree) SELECT conf, agree, count(*) FILTER (score < conf OR score2 < agree) AS unreliable FROM scores, g, h GROUP BY conf, agree")
def a21(spark, d):
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("conf"), F.lit(a).alias("agree")) for c in (0.1, 0.2, 0.3) for a in (0.25, 0.5)]))
    rows = scores(spark, d).select("score", "score2", grid.alias("g")).select("score", "score2", "g.*")
    return rows.groupBy("conf", "agree").agg(F.count_if((F.col("score") < F.col("conf")) | (F.col("score2") < F.col("agree"))).alias("unreliable"))


@query("a22_cut_summary", f"{C} SELECT count(*) FILTER (decision = 'keep') AS accepted, count(*) FILTER (decision = 'reject') AS rejected, count(DISTINCT video_id) AS videos, round(sum(duration_s), 2) AS seconds FROM clips")
def a22(spark, d):
    return clips(spark, d).agg(F.count_if(F.col("decision") == "keep").alias("accepted"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.countDistinct("video_id").alias("videos"), F.round(F.sum("duration_s"), 2).alias("seconds"))


@query("a23_calibration_strata", f"WITH {SCORES_SQL} SELECT kind AS tier, cell AS risk, count(*) AS n FROM scores GROUP BY GROUPING SETS ((kind, cell), (kind), ())")
def a23(spark, d):
    return scores(spark, d).rollup(F.col("kind").alias("tier"), F.col("cell").alias("risk")).agg(F.count("*").alias("n"))


@query("a24_vector_sums", "SELECT label, i - 1 AS pos, round(sum(embedding[i]::DOUBLE), 4) AS total, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def a24(spark, d):
    long = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return long.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("total"), F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("j1_videos_with_inputs", f"{V} SELECT video_id, c_name AS input, c_mktsegment AS speakers FROM videos JOIN customer ON c_custkey = input_id WHERE status = 'F'")
def j1(spark, d):
    inputs = t(spark, d, "customer").select(F.col("c_custkey").alias("input_id"), F.col("c_name").alias("input"), F.col("c_mktsegment").alias("speakers"))
    return videos(spark, d).filter("status = 'F'").join(inputs, "input_id").select("video_id", "input", "speakers")


@query("j3_batch_list", f"{V} SELECT batch, video_id, c_name AS input, round(duration_s / 60, 1) AS minutes FROM videos JOIN customer ON c_custkey = input_id")
def j3(spark, d):
    inputs = t(spark, d, "customer").select(F.col("c_custkey").alias("input_id"), F.col("c_name").alias("input"))
    return videos(spark, d).join(inputs, "input_id").select("batch", "video_id", "input", F.round(F.col("duration_s") / 60, 1).alias("minutes"))


@query("j4_pool_leftovers", f"WITH {CLIPS_SQL} SELECT clip_id, s_name AS speaker, p_brand AS location FROM clips JOIN supplier ON s_suppkey = speaker_id LEFT JOIN part ON p_partkey = source_id AND p_size > 25 WHERE decision <> 'keep'")
def j4(spark, d):
    sup = t(spark, d, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_name").alias("speaker"))
    loc = t(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("location"))
    return clips(spark, d).filter("decision != 'keep'").join(sup, "speaker_id").join(loc, "source_id", "left").select("clip_id", "speaker", "location")


@query("j6_pending_jobs", f"WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT video_id FROM videos WHERE video_id NOT IN (SELECT video_id FROM clips WHERE decision <> 'reject')")
def j6(spark, d):
    return T.pending(videos(spark, d), clips(spark, d), "video_id", redo=F.col("decision") == "reject").select("video_id")


@query("j8_donors", f"""{C} SELECT a.clip_id, count(*) AS donors, min(b.clip_id) AS first_donor FROM clips a JOIN clips b ON a.speaker_id = b.speaker_id AND a.decision = b.decision AND a.clip_id <> b.clip_id AND b.duration_s >= a.duration_s - 1e-6
  AND (a.source_id <> b.source_id OR a.end_s <= b.start_s OR b.end_s <= a.start_s) GROUP BY a.clip_id""")
def j8(spark, d):
    pairs = T.overlapping_partners(clips(spark, d), ["speaker_id", "decision"], "clip_id", "duration_s", "source_id", "start_s", "end_s")
    return pairs.groupBy("clip_id").agg(F.count("*").alias("donors"), F.min("partner").alias("first_donor"))


@query("j9_best_reference", f"""{C}, r AS (SELECT a.clip_id, b.clip_id AS ref, row_number() OVER (PARTITION BY a.clip_id ORDER BY (a.source_id = b.source_id)::INT, b.duration_s DESC, b.clip_id) AS n
  FROM clips a JOIN clips b ON a.speaker_id = b.speaker_id AND a.decision = b.decision AND a.clip_id <> b.clip_id) SELECT c.clip_id, coalesce(ref, c.clip_id) AS reference FROM clips c LEFT JOIN r ON r.clip_id = c.clip_id AND n = 1""")
def j9(spark, d):
    return T.best_reference(clips(spark, d), ["speaker_id", "decision"], "clip_id", "duration_s", "source_id").select("clip_id", "reference")


@query("j10_fixed_references", f"""WITH {SCORES_SQL}, n AS (SELECT speaker_id, source_clip_id, sample_id, row_number() OVER (PARTITION BY speaker_id ORDER BY sample_id) AS k FROM scores WHERE cell = 'real')
  SELECT s.sample_id, count(*) AS refs, min(n.sample_id) AS first_ref FROM scores s JOIN n ON s.speaker_id = n.speaker_id AND s.source_clip_id <> n.source_clip_id AND k <= 4 WHERE s.label = 1 GROUP BY s.sample_id""")
def j10(spark, d):
    s = scores(spark, d)
    refs = S.first_of_each(s.filter("cell = 'real'"), ["speaker_id"], ["sample_id"], 4).select("speaker_id", F.col("source_clip_id").alias("rc"), F.col("sample_id").alias("rs"))
    return s.filter("label = 1").join(refs, "speaker_id").filter("source_clip_id != rc").groupBy("sample_id").agg(F.count("*").alias("refs"), F.min("rs").alias("first_ref"))


@query("j12_review_default", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'keep' WHEN l.quality = 1 THEN 'keep' ELSE 'reject' END AS decision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j12(spark, d):
    decided = t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("decision"))
    return t(spark, d, "documents").select("doc_id").join(decided, "doc_id", "left").select("doc_id", F.coalesce("decision", F.lit("keep")).alias("decision"))


@query("j13_strict_review", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_a, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_b, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS both")
def j13(spark, d):
    return T.same_ids(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("j14_common_samples", f"WITH {SCORES_SQL} SELECT a.split, count(*) AS common FROM scores a JOIN (SELECT sample_id, score2 FROM scores WHERE score2 > 0.3) b USING (sample_id) WHERE a.score < 0.4 GROUP BY a.split")
def j14(spark, d):
    s = scores(spark, d)
    return s.filter("score < 0.4").join(s.filter("score2 > 0.3").select("sample_id"), "sample_id").groupBy("split").agg(F.count("*").alias("common"))


@query("j15_orphans", f"WITH {VIDEOS_SQL}, {CLIPS_SQL} SELECT video_id FROM videos WHERE video_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM clips WHERE clips.video_id = videos.video_id)")
def j15(spark, d):
    return videos(spark, d).filter("video_id IS NOT NULL").join(clips(spark, d), "video_id", "left_anti").select("video_id")


@query("j16_real_pairs", f"WITH {SCORES_SQL}, r AS (SELECT source_clip_id, min(sample_id) AS real_id FROM scores WHERE cell = 'real' GROUP BY ALL) SELECT s.sample_id, r.real_id FROM scores s LEFT JOIN r USING (source_clip_id) WHERE label = 1")
def j16(spark, d):
    s = scores(spark, d)
    r = s.filter("cell = 'real'").groupBy("source_clip_id").agg(F.min("sample_id").alias("real_id"))
    return s.filter("label = 1").join(r, "source_clip_id", "left").select("sample_id", "real_id")


@query("j17_merge_suggestion", "SELECT a.s_suppkey AS sid, b.s_suppkey AS suggestion FROM supplier a LEFT JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_suppkey = a.s_suppkey + 25 AND b.s_acctbal > 0")
def j17(spark, d):
    s = t(spark, d, "supplier")
    target = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("suggestion"), F.col("s_nationkey").alias("n"))
    return s.join(target, (F.col("n") == F.col("s_nationkey")) & (F.col("suggestion") == F.col("s_suppkey") + 25), "left").select(F.col("s_suppkey").alias("sid"), "suggestion")


# --- set operations --------------------------------------------------------------------------------------------------


@query("o1_union_parts", f"WITH {SCORES_SQL} SELECT part, count(*) AS n, count(DISTINCT sample_id) AS ids FROM (SELECT 'a' AS part, sample_id FROM scores WHERE split = 'train' UNION ALL SELECT 'b', sample_id FROM scores WHERE split <> 'train') GROUP BY part")
def o1(spark, d):
    s = scores(spark, d).select("sample_id", "split")
    parts = s.filter("split = 'train'").drop("split").withColumn("part", F.lit("a")).unionByName(s.filter("split != 'train'").drop("split").withColumn("part", F.lit("b")), allowMissingColumns=True)
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids"))


@query("o2_distinct_append", "SELECT event_type AS name, min(src) AS first_source FROM (SELECT event_type, 1 AS src FROM events UNION ALL SELECT lang, 2 FROM documents) GROUP BY event_type")
def o2(spark, d):
    both = t(spark, d, "events").select(F.col("event_type").alias("name"), F.lit(1).alias("src")).unionByName(t(spark, d, "documents").select(F.col("lang").alias("name"), F.lit(2).alias("src")))
    return both.groupBy("name").agg(F.min("src").alias("first_source"))


@query("o3_difference", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def o3(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).subtract(t(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("o4_intersection", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def o4(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(t(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("o6_first_owner", "SELECT l_partkey AS part, min(l_orderkey * 10 + l_linenumber) AS owner, count(*) - 1 AS duplicates FROM lineitem GROUP BY l_partkey")
def o6(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("owner"))
    kept, later = T.first_owner(rows, "part", ["owner"])
    return kept.join(later.groupBy("part").agg(F.count("*").alias("d")), "part", "left").select("part", "owner", F.coalesce("d", F.lit(0)).alias("duplicates"))


@query("o7_distinct_pairs", f"{C} SELECT DISTINCT speaker_id, source_id FROM clips WHERE decision = 'keep'")
def o7(spark, d):
    return clips(spark, d).filter("decision = 'keep'").select("speaker_id", "source_id").distinct()


@query("o8_seen_generators", f"WITH {SCORES_SQL} SELECT DISTINCT generator, generator IN (SELECT generator FROM scores WHERE split = 'train' AND label = 1 AND score3 > 1.045) AS seen FROM scores WHERE split = 'test'")
def o8(spark, d):
    s = scores(spark, d)
    seen = s.filter("split = 'train' AND label = 1 AND score3 > 1.045").select("generator").distinct().withColumn("seen", F.lit(True))
    return s.filter("split = 'test'").select("generator").distinct().join(F.broadcast(seen), "generator", "left").select("generator", F.coalesce("seen", F.lit(False)).alias("seen"))


# --- windows, selection, planning ------------------------------------------------------------------------------------


@query("w1_enrollment", f"WITH {SCORES_SQL} SELECT split, speaker_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY split, speaker_id ORDER BY sample_id) AS n FROM scores WHERE cell = 'real') WHERE n <= 3")
def w1(spark, d):
    return S.first_of_each(scores(spark, d).filter("cell = 'real'"), ["split", "speaker_id"], ["sample_id"], 3).select("split", "speaker_id", "sample_id")


@query("w12_photos", f"""{C}, a AS (SELECT *, row_number() OVER (PARTITION BY speaker_id, source_id ORDER BY consistency DESC, clip_id) AS n FROM clips), b AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY consistency DESC, clip_id) AS m FROM a WHERE n = 1) SELECT speaker_id, clip_id FROM b WHERE m <= 3""")
def w12(spark, d):
    order = [F.desc("consistency"), "clip_id"]
    return S.first_of_each(S.first_of_each(clips(spark, d), ["speaker_id", "source_id"], order), ["speaker_id"], order, 3).select("speaker_id", "clip_id")


@query("w13_voice_rotation", f"{C} SELECT clip_id, (row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) - 1 + dense_rank() OVER (ORDER BY speaker_id) - 1 + source_id % 5) % 6 AS slot FROM clips")
def w13(spark, d):
    return S.rotation(clips(spark, d), "speaker_id", "clip_id", 6, F.col("source_id") % 5).select("clip_id", "slot")


@query("w14_contiguous_chunks", "WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS l FROM customer), k AS (SELECT unnest(range(1, 8)) AS k) SELECT id, k AS chunk FROM n JOIN k ON i >= ((k - 1) * l) // 7 AND i < (k * l) // 7")
def w14(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    total = c.agg(F.count("*").alias("l"))
    ranked = numbered(c, [F.col("id")], "i").withColumn("i", F.col("i") - 1).crossJoin(F.broadcast(total))
    bounds = F.sequence(F.lit(1), F.lit(7))
    inside = F.filter(bounds, lambda k: (F.col("i") >= F.floor((k - 1) * F.col("l") / 7)) & (F.col("i") < F.floor(k * F.col("l") / 7)))
    return ranked.select("id", inside[0].cast("long").alias("chunk"))


@query("w15_seeded_variant", f"{C}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sha256('7:' || clip_id::VARCHAR)) AS n FROM clips) SELECT video_id, clip_id FROM r WHERE n = 1")
def w15(spark, d):
    return S.first_of_each(clips(spark, d), ["video_id"], [S.seeded(7, "clip_id")]).select("video_id", "clip_id")


@query("l1_even_spread", f"""{V}, r AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY upload_date, video_id) - 1 AS i, count(*) OVER (PARTITION BY input_id) AS n FROM videos)
  SELECT input_id, video_id FROM r WHERE n <= 4 OR i IN (SELECT round_even(j * (n - 1) / 3.0::DOUBLE, 0) FROM range(0, 4) x(j))""")
def l1(spark, d):
    return S.spread(videos(spark, d), ["input_id"], ["upload_date", "video_id"], 4).select("input_id", "video_id")


@query("l2_smallest_count", f"""{V}, r AS (SELECT *, row_number() OVER w AS i, sum(duration_s) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM videos WINDOW w AS (PARTITION BY input_id ORDER BY upload_date, video_id)),
  q AS (SELECT input_id, coalesce(min(i) FILTER (s >= 5000 AND i >= 3), 10) AS need FROM r GROUP BY input_id) SELECT r.input_id, count(*) AS picked FROM r JOIN q USING (input_id) WHERE i <= need AND i <= 10 GROUP BY r.input_id""")
def l2(spark, d):
    return S.smallest_count(videos(spark, d), ["input_id"], ["upload_date", "video_id"], "duration_s", 5000, 3, 10).groupBy("input_id").agg(F.count("*").alias("picked"))


@query("l3_newest", f"{V} SELECT input_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY upload_date DESC, video_id) AS n FROM videos) WHERE n <= 5")
def l3(spark, d):
    return S.first_of_each(videos(spark, d), ["input_id"], [F.desc("upload_date"), "video_id"], 5).select("input_id", "video_id")


@query("l4_bucket_spread", f"""{C}, b AS (SELECT *, floor((start_s + end_s) / 2 / 8)::BIGINT AS bucket, round(abs((start_s + end_s) / 2 - (floor((start_s + end_s) / 2 / 8) + 0.5) * 8), 9) AS off FROM clips)
  SELECT speaker_id, bucket, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id, bucket ORDER BY off, clip_id) AS n FROM b) WHERE n = 1""")
def l4(spark, d):
    b = S.bucket_order(clips(spark, d), ["speaker_id"], (F.col("start_s") + F.col("end_s")) / 2, F.lit(8.0))
    return S.first_of_each(b, ["speaker_id", "bucket"], ["_off", "clip_id"]).select("speaker_id", F.col("bucket").cast("long").alias("bucket"), "clip_id")


@query("l6_linear_quota", f"{V}, s AS (SELECT input_id, sum(duration_s) AS s FROM videos GROUP BY input_id) SELECT input_id, round_even(30 + greatest(0, least(1, (s - 3000) / (30000 - 3000))) * 20, 0)::BIGINT AS quota FROM s")
def l6(spark, d):
    s = videos(spark, d).groupBy("input_id").agg(F.sum("duration_s").alias("s"))
    return s.select("input_id", S.linear_quota(F.col("s"), (3000.0, 30.0), (30000.0, 50.0)).alias("quota"))


@query("l7_largest_remainder", """WITH w AS (SELECT c_nationkey AS n, c_mktsegment AS k, count(*) AS weight FROM customer GROUP BY ALL), x AS (SELECT *, 100 * weight / sum(weight) OVER (PARTITION BY n) AS e FROM w),
  y AS (SELECT *, floor(e) AS low, 100 - sum(floor(e)) OVER (PARTITION BY n) AS left_, row_number() OVER (PARTITION BY n ORDER BY round((e - floor(e))::DOUBLE, 9) DESC, k) AS r FROM x) SELECT n, k, (low + CASE WHEN r <= left_ THEN 1 ELSE 0 END)::BIGINT AS quota FROM y""")
def l7(spark, d):
    w = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("weight")).withColumn("total", F.lit(100))
    return S.apportion(w, ["n"], "total", "weight", "k").select("n", "k", "quota")


@query("l13_seeded_sample", f"WITH {SCORES_SQL} SELECT split, sample_id FROM (SELECT split, sample_id, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || sample_id::VARCHAR)) AS n FROM scores) WHERE n <= 25")
def l13(spark, d):
    return S.first_of_each(scores(spark, d), ["split"], [S.seeded(42, "sample_id")], 25).select("split", "sample_id")


@query("l14_balanced_pool", f"""{C}, a AS (SELECT *, row_number() OVER (PARTITION BY decision, source_id ORDER BY sha256('1:' || clip_id::VARCHAR)) AS n FROM clips), b AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY sha256('1:' || clip_id::VARCHAR)) AS m FROM a WHERE n = 1) SELECT decision, clip_id FROM b WHERE m <= 250""")
def l14(spark, d):
    order = [S.seeded(1, "clip_id")]
    return S.first_of_each(S.first_of_each(clips(spark, d), ["decision", "source_id"], order), ["decision"], order, 250).select("decision", "clip_id")


@query("l15_round_robin", "WITH r AS (SELECT s_suppkey AS id, s_nationkey AS stratum, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT id, stratum, row_number() OVER (ORDER BY k, stratum) AS turn FROM r")
def l15(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("stratum"))
    return S.round_robin(s, ["stratum"], ["id"]).select("id", "stratum", "turn")


@query("p1_next_fit_batches")
def p1(spark, d):
    return S.next_fit(videos(spark, d), "video_id", "upload_date", "duration_s", "size_mb", 7200.0, 800.0, "input_id")


@query("p2_assign_generators", f"""{C}, p AS (SELECT clip_id, row_number() OVER (ORDER BY sha256('42:' || clip_id::VARCHAR), clip_id) - 1 AS p FROM clips WHERE decision = 'keep') SELECT clip_id, j, ['w', 'm', 'v'][((p * 2 + j) % 3 + 1)::INT] AS generator, ((p * 2 + j) // 3 + j) % 3 AS cell FROM p, range(0, 2) x(j)""")
def p2(spark, d):
    out = S.assign_generators(clips(spark, d).filter("decision = 'keep'").select("clip_id"), "clip_id", ["w", "m", "v"], 2, 42)
    return out.select("clip_id", F.col("j").cast("long").alias("j"), "generator", "cell")


@query("p5_job_fanout", f"{V} SELECT video_id, unnest(CASE WHEN status = 'F' THEN ['voice', 'lips'] WHEN status = 'O' THEN ['voice'] ELSE ['source'] END) AS kind FROM videos")
def p5(spark, d):
    kinds = F.when(F.col("status") == "F", F.array(F.lit("voice"), F.lit("lips"))).when(F.col("status") == "O", F.array(F.lit("voice"))).otherwise(F.array(F.lit("source")))
    return videos(spark, d).select("video_id", F.explode(kinds).alias("kind"))


@query("p6_input_status", f"""{V}, g AS (SELECT input_id, count(*) AS n, sum(duration_s) AS s, count(*) FILTER (status = 'F') AS ok FROM videos GROUP BY input_id) SELECT input_id, CASE WHEN ok = 0 THEN 'rejected' WHEN s < 4000 THEN 'short' ELSE 'planned' END AS state FROM g""")
def p6(spark, d):
    g = videos(spark, d).groupBy("input_id").agg(F.sum("duration_s").alias("s"), F.count_if(F.col("status") == "F").alias("ok"))
    return g.select("input_id", F.when(F.col("ok") == 0, "rejected").when(F.col("s") < 4000, "short").otherwise("planned").alias("state"))


@query("p7_register_inputs", "SELECT c_custkey AS id, c_mktsegment AS kind FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def p7(spark, d):
    existing = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("x").alias("kind"))
    incoming = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return T.register(existing, incoming, "id", ["kind"])[0]


@query("p8_engine_order", f"WITH {SCORES_SQL} SELECT generator, list_position(['g3', 'g1', 'g0', 'g2', 'g4', 'g5', 'g6'], generator)::BIGINT AS place, count(*) AS jobs FROM scores GROUP BY generator")
def p8(spark, d):
    order = F.array(*[F.lit(g) for g in ("g3", "g1", "g0", "g2", "g4", "g5", "g6")])
    return scores(spark, d).groupBy("generator").agg(F.count("*").alias("jobs")).select("generator", F.array_position(order, F.col("generator")).alias("place"), "jobs")


# --- job state -------------------------------------------------------------------------------------------------------


@query("x1_resume", "SELECT o_orderkey AS job FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def x1(spark, d):
    records = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), "l_returnflag")
    return T.pending(t(spark, d, "orders").select(F.col("o_orderkey").alias("job")), records, "job", F.col("l_returnflag") == "R")


@query("x2_merge_sessions", "SELECT l_partkey AS key, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS owner, count(*) AS seen FROM lineitem GROUP BY l_partkey")
def x2(spark, d):
    parts = t(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    newest, _ = T.merge_outputs(parts, "key", "owner", [F.desc("at")])
    return newest.select("key", "owner").join(parts.groupBy("key").agg(F.count("*").alias("seen")), "key")


@query("x3_conflicting_outputs", "SELECT l_partkey AS key, count(DISTINCT l_returnflag) AS contents FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def x3(spark, d):
    parts = t(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_returnflag", "l_orderkey")
    return T.merge_outputs(parts, "key", "l_returnflag", [F.desc("l_orderkey")])[1]


@query("x4_left_per_generator", f"WITH {SCORES_SQL} SELECT generator, count(*) AS left_jobs FROM scores WHERE sample_id NOT IN (SELECT sample_id FROM scores WHERE score > 0.3) GROUP BY generator")
def x4(spark, d):
    s = scores(spark, d)
    return T.pending(s, s.filter("score > 0.3"), "sample_id").groupBy("generator").agg(F.count("*").alias("left_jobs"))


@query("x5_merge_runs", "SELECT l_suppkey AS run, max(l_linestatus = 'F') AS complete, max(l_linenumber) FILTER (l_linestatus = 'F')::BIGINT AS epochs FROM lineitem GROUP BY l_suppkey")
def x5(spark, d):
    runs = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_linestatus") == "F").alias("complete"), F.col("l_linenumber").cast("long").alias("epochs"))
    return T.latest_complete(runs, "run", "complete", "epochs")


@query("x7_missing_runs", "SELECT m.event_type AS model, s.s_suppkey AS seed FROM (SELECT DISTINCT event_type FROM events) m, supplier s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = m.event_type AND e.user_id = s.s_suppkey AND e.value > 60)")
def x7(spark, d):
    e = t(spark, d, "events")
    models = e.select(F.col("event_type").alias("model")).distinct()
    seeds = t(spark, d, "supplier").select(F.col("s_suppkey").alias("seed"))
    return T.missing_combinations(seeds, models, e.filter("value > 60").select(F.col("event_type").alias("model"), F.col("user_id").alias("seed")).distinct()).select("model", "seed")


@query("x9_session_log", "SELECT event_type AS engine, round(avg(value), 5) AS mean_s, count(*) AS done, count(*) FILTER (value < 10) AS skipped FROM events GROUP BY event_type")
def x9(spark, d):
    return t(spark, d, "events").groupBy(F.col("event_type").alias("engine")).agg(F.round(F.avg("value"), 5).alias("mean_s"), F.count("*").alias("done"), F.count_if(F.col("value") < 10).alias("skipped"))


@query("x11_location_states", f"{V} SELECT CASE WHEN status = 'P' THEN 'local' WHEN batch < 8 THEN 'packed' WHEN batch < 16 THEN 'drive' ELSE 'deleted' END AS location, count(*) AS n FROM videos GROUP BY 1")
def x11(spark, d):
    state = F.when(F.col("status") == "P", "local").when(F.col("batch") < 8, "packed").when(F.col("batch") < 16, "drive").otherwise("deleted")
    return videos(spark, d).groupBy(state.alias("location")).agg(F.count("*").alias("n"))


@query("k1_upsert", "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def k1(spark, d):
    base = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return T.upsert(base, t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")), ["id"])


@query("k2_update", "SELECT c_custkey AS id, coalesce(s_acctbal, c_acctbal) AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def k2(spark, d):
    base = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return T.update(base, t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")), "id")


@query("k9_speaker_rollup", f"{C} SELECT speaker_id, count(*) AS clips, round(sum(duration_s), 3) AS seconds, array_to_string(list_sort(list_distinct(list(decision))), ';') AS decisions FROM clips GROUP BY speaker_id")
def k9(spark, d):
    return clips(spark, d).groupBy("speaker_id").agg(F.count("*").alias("clips"), F.round(F.sum("duration_s"), 3).alias("seconds"), F.array_join(F.sort_array(F.collect_set("decision")), ";").alias("decisions"))


@query("k11_score_table", f"WITH {SCORES_SQL} SELECT sample_id, CASE WHEN score < 0.1 THEN 'nan'::DOUBLE ELSE round(score, 6) END AS video_ai, CASE WHEN score2 < 0.1 THEN 'nan'::DOUBLE ELSE round(score2, 6) END AS video_mismatch FROM scores")
def k11(spark, d):
    keep = lambda c, n: F.when(F.col(c) < 0.1, F.lit(float("nan"))).otherwise(F.round(c, 6)).alias(n)
    return scores(spark, d).select("sample_id", keep("score", "video_ai"), keep("score2", "video_mismatch"))


@query("k15_histogram", "SELECT event_type, least(10, floor(value / 20))::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def k15(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.least(F.lit(10).cast("long"), F.floor(F.col("value") / 20)).alias("bin")).agg(F.count("*").alias("n"))
