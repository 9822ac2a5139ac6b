"""Queries of the remaining state, plan, vector and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import contracts as Q
from strandline.operators import graph
from strandline.operators import intervals as I
from strandline.operators import ranking as R
from strandline.operators import segmentation as G
from strandline.operators import selection as S
from strandline.operators import series
from strandline.operators import tables as T
from strandline.operators import vectors as E
from strandline.operators.sync import best_spans
from strandline.plans.base import CLIPS_SQL, FRAMES_SQL, SCORES_SQL, VIDEOS_SQL, clips, frames, query, scores, t, videos

V, C, SC, FR = (f"WITH {x}" for x in (VIDEOS_SQL, CLIPS_SQL, SCORES_SQL, FRAMES_SQL))


@query("e8_merge_owners", """WITH m AS (SELECT vec_id, embedding, label, CASE WHEN label = 9 THEN 0 WHEN label = 7 THEN 2 ELSE label END AS owner, 'c' || (vec_id % 6) AS channel FROM embeddings)
  SELECT owner, count(*) AS n, round(sum(list_sum(embedding)), 2) AS total, len(list_distinct(list(channel)))::BIGINT AS channels, CASE WHEN owner IN (0, 2) THEN 'pending' ELSE 'done' END AS review FROM m GROUP BY owner""")
def e8(spark, d):
    v = t(spark, d, "embeddings").withColumn("owner", F.col("label").cast("long"))
    lists = v.groupBy("owner").agg(F.collect_set(F.concat(F.lit("c"), (F.col("vec_id") % 6).cast("string"))).alias("channels"))
    owners = E.centroids(v, "owner", "embedding").join(lists, "owner").withColumn("review", F.lit("done"))
    out = T.merge_owners(owners, spark.createDataFrame([(9, 0), (7, 2)], "owner long, into long"), "owner", "total", "n", ["channels"], "review")
    return out.select("owner", "n", F.round(F.aggregate("total", F.lit(0.0), lambda s, x: s + x), 2).alias("total"), F.size("channels").cast("long").alias("channels"), "review")


@query("u31_vector_totals", "WITH a AS (SELECT i, sum(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY i) SELECT i - 1 AS pos, round(x, 4) AS total FROM a")
def u31(spark, d):
    c = E.centroids(t(spark, d, "embeddings").withColumn("k", F.lit(1)), "k", "embedding")
    return c.select(F.posexplode("total").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("total"))


@query("b9_comparison_tables", f"""{SC}, p AS (SELECT 'split' AS dim, split AS value, score FROM scores WHERE label = 1 UNION ALL SELECT 'generator', generator, score FROM scores WHERE label = 1),
  rows AS (SELECT dim, value, score, 1 AS label FROM p UNION ALL SELECT g.dim, g.value, s.score, 0 FROM scores s, (SELECT DISTINCT dim, value FROM p) g WHERE s.label = 0), g AS (SELECT dim, value, score, sum(label) AS pos, sum(1 - label) AS neg FROM rows GROUP BY ALL),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY dim, value ORDER BY score) - neg / 2.0 AS below FROM g) SELECT dim, value, round((sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 6) AS auc FROM c GROUP BY ALL""")
def b9(spark, d):
    return R.breakdown(scores(spark, d), ["split", "generator"], F.col("label") == 0).select("dim", "value", F.round("auc", 6).alias("auc"))


@query("g9_split_registry", f"""{SC}, g AS (SELECT speaker_id, CASE WHEN h < 60 THEN 'train' WHEN h < 75 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT speaker_id, ('0x' || substr(sha256(speaker_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM scores))
  SELECT g.split, count(DISTINCT speaker_id) AS groups, count(*) AS rows, list_sort(list_distinct(list(speaker_id)))::VARCHAR AS members FROM scores JOIN g USING (speaker_id) GROUP BY g.split""")
def g9(spark, d):
    h = S.stable_int(F.col("speaker_id").cast("string")) % 100
    rows = scores(spark, d)
    groups = rows.select("speaker_id").distinct().withColumn("split", F.when(h < 60, "train").when(h < 75, "validation").otherwise("test"))
    out = graph.split_registry(groups, rows.drop("split"), "speaker_id", "split")
    return out.select("split", "groups", "rows", F.concat(F.lit("["), F.array_join(F.transform("members", lambda x: x.cast("string")), ", "), F.lit("]")).alias("members"))


@query("q5_evaluation_lock", "SELECT o_orderstatus, o_orderkey, md5(o_orderpriority) = first_value(md5(o_orderpriority)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS accepted FROM orders")
def q5(spark, d):
    runs = t(spark, d, "orders").withColumn("stamp", F.md5("o_orderpriority"))
    return T.held_locks(runs, "o_orderstatus", ["o_orderdate", "o_orderkey"], "stamp").select("o_orderstatus", "o_orderkey", "accepted")


@query("q4_frozen_settings", "SELECT p_partkey, sha256('{\"a\":\"' || p_brand || '\",\"b\":' || p_size || '}') = sha256('{\"a\":\"' || p_brand || '\",\"b\":' || (p_size % 40) || '}') AS same FROM part")
def q4(spark, d):
    a = Q.signature([F.col("p_brand").alias("a"), F.col("p_size").alias("b")])
    b = Q.signature([F.col("p_brand").alias("a"), (F.col("p_size") % 40).alias("b")])
    return t(spark, d, "part").select("p_partkey", (a == b).alias("same"))


@query("u13_clip_ids", f"{C} SELECT clip_id, 'clip_' || substr(sha256(video_id || ':' || speaker_id), 1, 24) AS name, concat_ws(',', CASE WHEN duration_s > 6 THEN 'long' END, CASE WHEN decision = 'pending' THEN 'pending' END) AS flags FROM clips")
def u13(spark, d):
    name = F.concat(F.lit("clip_"), F.substring(F.sha2(F.concat_ws(":", F.col("video_id").cast("string"), F.col("speaker_id").cast("string")), 256), 1, 24))
    return clips(spark, d).select("clip_id", name.alias("name"), F.concat_ws(",", F.when(F.col("duration_s") > 6, "long"), F.when(F.col("decision") == "pending", "pending")).alias("flags"))


@query("u17_clean_pool", f"""{V}, {CLIPS_SQL}, l AS (SELECT v.batch, CASE WHEN v.reason LIKE '1%' OR v.reason LIKE '2%' THEN 'drive:raw' ELSE 'local' END AS location FROM clips c JOIN videos v USING (video_id) WHERE c.decision <> 'keep')
  SELECT batch, count(*) FILTER (starts_with(location, 'drive:')) AS deleted, count(*) FILTER (NOT starts_with(location, 'drive:')) AS waiting FROM l GROUP BY batch""")
def u17(spark, d):
    stored = F.col("reason").startswith("1") | F.col("reason").startswith("2")
    raw = videos(spark, d).select("video_id", "batch", F.when(stored, "drive:raw").otherwise("local").alias("location"))
    leftovers = clips(spark, d).filter("decision != 'keep'").join(raw, "video_id")
    return T.conditional_rollup(leftovers, ["batch"], {}, {"deleted": F.col("location").startswith("drive:"), "waiting": ~F.col("location").startswith("drive:")}).select("batch", "deleted", "waiting")


@query("u18_ordered_needs", f"{SC}, f AS (SELECT speaker_id, generator, min(sample_id) AS o FROM scores WHERE label = 1 GROUP BY ALL) SELECT speaker_id, string_agg(generator, ',' ORDER BY o) AS needs FROM f GROUP BY speaker_id")
def u18(spark, d):
    needs = T.ordered_distinct(scores(spark, d).filter("label = 1"), ["speaker_id"], ["sample_id"], "generator", "needs")
    return needs.select("speaker_id", F.array_join("needs", ",").alias("needs"))


@query("u22_phrase_choice", f"""{FR}, w AS (SELECT sample_id, frame, event_type AS word, sum(value) OVER (PARTITION BY sample_id ORDER BY frame ROWS UNBOUNDED PRECEDING) - value AS a, sum(value) OVER (PARTITION BY sample_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS b FROM frames),
  x AS (SELECT p.sample_id, p.frame AS first, q.frame AS last FROM w p JOIN w q ON p.sample_id = q.sample_id AND p.frame <= q.frame AND round(q.b - p.a, 6) BETWEEN 50 AND 120),
  y AS (SELECT x.sample_id, first, last, bool_or(word = 'click') AS ok FROM x JOIN w ON w.sample_id = x.sample_id AND w.frame BETWEEN first AND last GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY NOT ok, sha256('5:' || sample_id || '/' || first || '/' || last)) AS n FROM y) SELECT sample_id, first, last, CASE WHEN ok THEN 'swap:click->tap' ELSE 'replace' END AS kind FROM r WHERE n = 1""")
def u22(spark, d):
    w = Window.partitionBy("sample_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    f = frames(spark, d).withColumn("b", F.sum("value").over(w)).withColumn("a", F.col("b") - F.col("value"))
    spans = I.word_spans(f, "sample_id", "frame", "a", "b", 50 - 5e-7, 120 + 5e-7).select("sample_id", "first", "last")
    words = f.select(F.col("sample_id").alias("_s"), F.col("frame").alias("_f"), F.col("event_type").alias("word"))
    inside = (F.col("sample_id") == F.col("_s")) & F.col("_f").between(F.col("first"), F.col("last"))
    phrases = spans.join(words, inside).groupBy("sample_id", "first", "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_f", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.concat_ws("/", *[F.col(c).cast("string") for c in ("sample_id", "first", "last")])
    chosen = S.chosen_phrase(phrases.withColumn("place", place), ["sample_id"], "phrase", "place", {"click": "tap"}, ["one", "two"], ["well", "so"], 5)
    return chosen.select("sample_id", "first", "last", "kind")


@query("u24_metrics_by_part", f"""{SC}, d AS (SELECT unnest([struct_pack(dim := 'generator', value := generator), struct_pack(dim := 'cell', value := cell), struct_pack(dim := 'split', value := split)]) AS g, score FROM scores WHERE label = 1),
  f AS (SELECT g.dim AS dim, g.value AS value, count(*) AS fakes, count(*) FILTER (score >= 0.3) AS tp FROM d GROUP BY ALL), r AS (SELECT count(*) AS reals, count(*) FILTER (score >= 0.3) AS fp FROM scores WHERE label = 0)
  SELECT dim, value, tp, fakes - tp AS fn, fp, reals - fp AS tn, round(tp / greatest(1, fakes), 6) AS recall, round(tp / greatest(1, tp + fp), 6) AS precision, round(fp / greatest(1, reals), 6) AS false_alarm, round((tp + reals - fp) / greatest(1, fakes + reals), 6) AS accuracy FROM f, r""")
def u24(spark, d):
    out = R.confusion_by(scores(spark, d), ["generator", "cell", "split"], 0.3)
    return out.select("dim", "value", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "false_alarm", "accuracy")])


@query("u26_flat_metrics", f"""{SC}, m AS (SELECT split, cell, count(*) AS n, avg(score) AS mean, avg((score >= 0.3)::INT) AS rate FROM scores GROUP BY ALL)
  SELECT split, cell, name, round(value, 6) AS value FROM (SELECT split, cell, 'n' AS name, n::DOUBLE AS value FROM m UNION ALL SELECT split, cell, 'mean', mean FROM m UNION ALL SELECT split, cell, 'rate', rate FROM m)""")
def u26(spark, d):
    per = scores(spark, d).groupBy("split", "cell").agg(F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("mean"), F.avg("score"), F.lit("rate"), F.avg((F.col("score") >= 0.3).cast("double"))).alias("m"))
    nested = per.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("cell", "m"))).alias("report"))
    return R.flattened(nested, ["split"], "report", ["cell", "name"]).select("split", "cell", "name", F.round("value", 6).alias("value"))


@query("u29_secondary_features", f"{FR} SELECT count(*) AS frames, count(*) FILTER (g.frame IS NULL) AS missing FROM frames f LEFT JOIN (SELECT sample_id, frame FROM frames WHERE valid) g USING (sample_id, frame)")
def u29(spark, d):
    f = frames(spark, d)
    other = f.filter("valid").select("sample_id", "frame", F.lit(1).alias("there"))
    return f.join(other, ["sample_id", "frame"], "left").agg(F.count("*").alias("frames"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("u11_scene_changes", """WITH f AS (SELECT vec_id % 9 AS k, vec_id // 9 AS f, [abs(x)::DOUBLE for x in embedding] AS h FROM embeddings), s AS (SELECT k, f, [x - list_avg(h) for x in h] AS h FROM f WHERE f % 2 = 0),
  p AS (SELECT *, lag(h) OVER (PARTITION BY k ORDER BY f) AS q FROM s) SELECT k, f, round(list_dot_product(h, q) / sqrt(list_dot_product(h, h) * list_dot_product(q, q)), 5) AS similarity FROM p WHERE q IS NOT NULL AND list_dot_product(h, q) / sqrt(list_dot_product(h, h) * list_dot_product(q, q)) < 0.05""")
def u11(spark, d):
    e = t(spark, d, "embeddings").select((F.col("vec_id") % 9).alias("k"), F.floor(F.col("vec_id") / 9).alias("f"), F.transform("embedding", lambda x: F.abs(x)).alias("h"))
    return series.scene_changes(e, "k", "f", "h", 2, 0.05).select("k", "f", F.round("similarity", 5).alias("similarity"))


@query("x6_run_states", "SELECT l_suppkey AS run, bool_and(l_linestatus = 'F') AS complete, max(l_linenumber)::BIGINT AS epochs, max(l_tax) AS best, arg_max(l_orderkey, struct_pack(a := l_linenumber, b := l_orderkey)) AS last FROM lineitem GROUP BY l_suppkey")
def x6(spark, d):
    at = F.struct("l_linenumber", "l_orderkey")
    state = F.struct(F.bool_and(F.col("l_linestatus") == "F").alias("complete"), F.max("l_linenumber").cast("long").alias("epochs"), F.max("l_tax").alias("best"), F.max_by("l_orderkey", at).alias("last"))
    return t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(state.alias("state")).select("run", "state.*")


@query("x13_work_by_parent", f"{SC} SELECT source_clip_id, count(*) AS jobs, count(DISTINCT generator) AS generators FROM scores GROUP BY source_clip_id")
def x13(spark, d):
    grouped = scores(spark, d).repartition("source_clip_id")  # one parent's jobs stand together, and the sums need no second shuffle
    return grouped.groupBy("source_clip_id").agg(F.count("*").alias("jobs"), F.countDistinct("generator").alias("generators"))


@query("x14_progress", "SELECT event_type, count(*) AS done, round(count(*) / (sum(value) / 3600), 5) AS per_hour FROM events GROUP BY event_type")
def x14(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("done"), F.round(F.count("*") / (F.sum("value") / 3600), 5).alias("per_hour"))


@query("ts16_edge_levels", f"{FR}, l AS (SELECT *, 20 * log10(greatest(value, 1e-6)) AS db FROM frames), m AS (SELECT *, db > max(db) OVER (PARTITION BY sample_id) - 12 AS loud FROM l) SELECT sample_id, min(frame) FILTER (loud) AS lead, max(frame) FILTER (loud) AS last FROM m GROUP BY sample_id")
def ts16(spark, d):
    w = Window.partitionBy("sample_id")
    f = frames(spark, d).withColumn("db", 20 * F.log10(F.greatest(F.col("value"), F.lit(1e-6))))
    f = f.withColumn("loud", F.col("db") > F.max("db").over(w) - 12)
    return f.groupBy("sample_id").agg(F.min(F.when(F.col("loud"), F.col("frame"))).alias("lead"), F.max(F.when(F.col("loud"), F.col("frame"))).alias("last"))


@query("ts20_index_remap", f"{FR}, n AS (SELECT sample_id, count(*) AS n FROM frames GROUP BY ALL) SELECT f.sample_id, f.frame, least(n - 1, greatest(0, CASE WHEN f.sample_id % 3 = 0 THEN frame + 2 WHEN f.sample_id % 3 = 1 THEN frame // 2 * 2 ELSE floor(frame * 1.25::DOUBLE)::BIGINT END)) AS source FROM frames f JOIN n USING (sample_id)")
def ts20(spark, d):
    f = frames(spark, d)
    n = f.groupBy("sample_id").agg(F.count("*").alias("n"))
    k, i = F.col("sample_id") % 3, F.col("frame")
    at = F.when(k == 0, i + 2).when(k == 1, F.floor(i / 2) * 2).otherwise(F.floor(i * 1.25))
    return f.join(n, "sample_id").select("sample_id", "frame", F.least(F.col("n") - 1, F.greatest(F.lit(0).cast("long"), at)).alias("source"))


@query("ts18_best_span", f"""{FR}, l AS (SELECT sample_id, frame, value > max(value) OVER (PARTITION BY sample_id) - 40 AS loud, max(frame) OVER (PARTITION BY sample_id) + 1 AS n FROM frames), q AS (SELECT *, frame - row_number() OVER (PARTITION BY sample_id ORDER BY frame) AS g FROM l WHERE NOT loud),
  p AS (SELECT sample_id, min(frame) AS s, max(frame) + 1 AS t, any_value(n) AS n FROM q GROUP BY sample_id, g), k AS (SELECT * FROM p WHERE t - s >= 2 OR s = 0 OR t = n), o AS (SELECT sample_id, t AS o FROM k WHERE t < n UNION SELECT sample_id, 0 FROM l WHERE frame = 0 AND loud), e AS (SELECT sample_id, s AS e FROM k WHERE s > 0),
  x AS (SELECT sample_id, o, e FROM o JOIN e USING (sample_id) WHERE o < e AND e <= o + 20) SELECT sample_id, arg_min(o, struct_pack(d := abs(e - o - 8), l := o - e, o := o)) AS onset, arg_min(e, struct_pack(d := abs(e - o - 8), l := o - e, o := o)) AS stop FROM x GROUP BY sample_id""")
def ts18(spark, d):
    spans = best_spans(frames(spark, d), "sample_id", "frame", "value", 40.0, 2, 8, 20)
    return spans.select("sample_id", "onset", "stop")


@query("m25_by_condition", f"{SC} SELECT cell, round(avg((score >= 0.3)::INT), 6) AS rate, (SELECT round(avg((score >= 0.3)::INT), 6) FROM scores WHERE cell = 'real') AS real_rate FROM scores GROUP BY cell")
def m25(spark, d):
    s = scores(spark, d)
    rate = F.round(F.avg((F.col("score") >= 0.3).cast("double")), 6)
    return s.groupBy("cell").agg(rate.alias("rate")).crossJoin(F.broadcast(s.filter("cell = 'real'").agg(rate.alias("real_rate"))))


@query("m23_calibrated_thresholds", f"""{SC}, d AS (SELECT 'video' AS what, score, label FROM scores WHERE split = 'validation' UNION ALL SELECT 'temporal', score3, CASE WHEN cell = 'audio' THEN 1 ELSE 0 END FROM scores WHERE split = 'validation' AND cell <> 'sham'),
  g AS (SELECT what, score, sum(label) AS pos, sum(1 - label) AS neg FROM d GROUP BY ALL), k AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY what) AS p FROM g WINDOW o AS (PARTITION BY what ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY round(2 * tp::DOUBLE / greatest(1, tp + p + fp), 12) DESC, score DESC) AS n FROM k) SELECT what, round(score, 6) AS threshold, round(2 * tp::DOUBLE / greatest(1, tp + p + fp), 6) AS f1 FROM r WHERE n = 1""")
def m23(spark, d):
    s = scores(spark, d).filter("split = 'validation'")
    rows = s.select(F.lit("video").alias("what"), "score", "label").unionByName(s.filter("cell != 'sham'").select(F.lit("temporal").alias("what"), F.col("score3").alias("score"), (F.col("cell") == "audio").cast("int").alias("label")))
    return R.best_f1_threshold(rows, ["what"]).select("what", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("p3_generation_plan", f"""{C}, k AS (SELECT * FROM clips WHERE decision = 'keep'), dn AS (SELECT a.clip_id, min(b.clip_id) AS donor FROM k a JOIN k b ON a.speaker_id = b.speaker_id AND a.clip_id <> b.clip_id AND b.duration_s >= a.duration_s - 1e-6 AND (a.source_id <> b.source_id OR a.end_s <= b.start_s OR b.end_s <= a.start_s) GROUP BY a.clip_id)
  SELECT k.clip_id, CASE WHEN dn.donor IS NULL THEN 'source' ELSE 'donor' END AS cell, dn.donor, substr(sha256(k.clip_id || ':lips'), 1, 20) AS job FROM k LEFT JOIN dn USING (clip_id)""")
def p3(spark, d):
    from strandline.operators.tables import overlapping_partners

    k = clips(spark, d).filter("decision = 'keep'")
    pairs = overlapping_partners(k, ["speaker_id"], "clip_id", "duration_s", "source_id", "start_s", "end_s")
    donors = pairs.groupBy("clip_id").agg(F.min("partner").alias("donor"))
    job = F.substring(F.sha2(F.concat(F.col("clip_id").cast("string"), F.lit(":lips")), 256), 1, 20)
    return k.join(donors, "clip_id", "left").select("clip_id", F.when(F.col("donor").isNull(), "source").otherwise("donor").alias("cell"), "donor", job.alias("job"))


@query("p4_sampled_parents", f"{SC}, r AS (SELECT split, source_clip_id, row_number() OVER (PARTITION BY split ORDER BY sha256('3:' || source_clip_id::VARCHAR)) AS n FROM (SELECT DISTINCT split, source_clip_id FROM scores)) SELECT split, source_clip_id, n = 1 AS emits_real FROM r WHERE n <= 40")
def p4(spark, d):
    parents = scores(spark, d).select("split", "source_clip_id").distinct()
    nth = F.row_number().over(Window.partitionBy("split").orderBy(S.seeded(3, "source_clip_id")))
    return parents.withColumn("n", nth).filter("n <= 40").select("split", "source_clip_id", (F.col("n") == 1).alias("emits_real"))


@query("i16_partial_spans", "SELECT o_orderkey AS id, 5 + ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 80 AS start, 5 + ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 80 + 10 AS stop FROM orders")
def i16(spark, d):
    start = 5 + S.stable_int(F.col("o_orderkey").cast("string")) % 80
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), start.alias("start"), (start + 10).alias("stop"))


@query("i12_cut_windows")
def i12(spark, d):
    f = frames(spark, d)
    length = f.groupBy("sample_id").agg(((F.max("frame") + 1) * 0.4).alias("duration"))
    regions = I.speech_regions(f, "sample_id", "frame", "score", 0.4, length, 0.2, 1.2, 0.15, 0.4)
    pauses = I.mask_to_spans(f, "sample_id", "frame", F.col("score") < 0.2, 0.4, F.col("score")).select("sample_id", "a", "b")
    return G.cut_windows(regions, pauses, "sample_id", 4.0, 7.0)


@query("l9_proposals")
def l9(spark, d):
    return G.proposals(frames(spark, d), "sample_id", "frame", "score", 0.2)


@query("b3_component_bootstrap")
def b3(spark, d):
    from strandline.operators import resample as B
    from strandline.operators.graph import identity_groups

    s = scores(spark, d).filter("split = 'test'")
    suppliers = t(spark, d, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_nationkey").alias("n"))
    groups = identity_groups(suppliers, "speaker_id", {"nation": F.col("n")})
    return B.paired_delta(s.join(groups, "speaker_id"), "group_id", "score", "score2")
