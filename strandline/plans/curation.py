"""Queries for identification, parts, landmarks, lags, trials and reports, over the domain views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars as X
from strandline.operators import detection as D
from strandline.operators import graph as G
from strandline.operators import identity as N
from strandline.operators import intervals as I
from strandline.operators import landmarks as L
from strandline.operators import segmentation as M
from strandline.operators import selection as S
from strandline.operators import series as E
from strandline.operators import sync as Y
from strandline.operators import vectors as V
from strandline.plans.base import CLIPS_SQL, FRAMES_SQL, SCORES_SQL, clips, frames, query, scores, t
from strandline.session import materialize

FR, SC, C = f"WITH {FRAMES_SQL}", f"WITH {SCORES_SQL}", f"WITH {CLIPS_SQL}"

# --- points of 68 landmarks a vector, and a track of boxes, laid over the test tables ---------------------------------

POINTS_SQL = "p AS (SELECT vec_id, [[(embedding[(i % 64) + 1] * 40)::DOUBLE, (embedding[((i * 5 + 3) % 64) + 1] * 40)::DOUBLE] for i in range(68)] AS pts FROM embeddings)"


def points(spark, d) -> DataFrame:
    at = lambda i: (F.element_at("embedding", (i % 64 + 1).cast("int")) * 40).cast("double")
    return t(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(67)), lambda i: F.array(at(i), at(i * 5 + 3))).alias("pts"))


def far(a: str, b: str) -> str:
    return f"sqrt(pow({a}[1] - {b}[1], 2) + pow({a}[2] - {b}[2], 2))"


# --- predicates ------------------------------------------------------------------------------------------------------


@query("f3_draft_gate", "SELECT event_id, event_id % 1080 >= 480 AND event_id % 61 >= 24 AND event_type <> 'error' AS passes FROM events")
def f3(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", X.draft_gate(F.col("event_id") % 1080, F.col("event_id") % 61, F.col("event_type") != "error").alias("passes"))


@query("f4_chosen_formats", """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag <> 'R' AS video, l_linestatus = 'F' AS audio, (l_quantity * 20)::BIGINT AS w, (l_partkey % 1200)::BIGINT AS h, l_tax AS lang FROM lineitem)
  SELECT k, max(CASE WHEN video THEN least(w, h) END) AS side, coalesce(arg_max(h > w, struct_pack(s := least(w, h), n := -n, a := NOT audio, w := -w, h := -h)) FILTER (video), false) AS vertical, arg_min(n, n) FILTER (video) AS v_first, arg_min(n, n) FILTER (audio) AS a_first,
  CASE WHEN count(*) FILTER (audio AND NOT video) > 0 THEN count(DISTINCT lang) FILTER (audio AND NOT video) END AS tracks FROM f GROUP BY k""")
def f4(spark, d):
    codec = lambda flag, name: F.when(flag, F.lit(name)).otherwise("none")
    one = F.struct(
        F.col("l_linenumber").alias("n"), codec(F.col("l_returnflag") != "R", "vp9").alias("vcodec"), codec(F.col("l_linestatus") == "F", "opus").alias("acodec"),
        (F.col("l_quantity") * 20).cast("long").alias("width"), (F.col("l_partkey") % 1200).cast("long").alias("height"), F.col("l_tax").cast("string").alias("language"),
    )
    rows = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(one)).alias("formats"))
    v = X.chosen_formats(F.col("formats"))
    return rows.select("k", v["largest_side"].alias("side"), v["vertical"].alias("vertical"), v["video"]["n"].alias("v_first"), v["audio"]["n"].alias("a_first"), v["tracks"].cast("long").alias("tracks"))


@query("f14_synchronised_real", f"{SC} SELECT sample_id, label = 0 AND cell <> 'sham' AND coalesce(CASE WHEN kind = 'F' THEN 'reviewed_match' WHEN gender = 'f' THEN 'mismatch' END, 'reviewed_match') = 'reviewed_match' AS real FROM scores")
def f14(spark, d):
    s = scores(spark, d)
    status = F.when(F.col("kind") == "F", "reviewed_match").when(F.col("gender") == "f", "mismatch")
    return s.select("sample_id", X.synchronised_real(F.col("label"), F.when(F.col("cell") == "sham", "sham"), F.lit(False), status).alias("real"))


@query("f15_sync_rows", f"{SC} SELECT cell, count(*) AS n, count(*) FILTER (cell = 'sham') AS known FROM scores WHERE label = 0 AND (cell <> 'sham' OR score > 0.1) GROUP BY cell")
def f15(spark, d):
    s = scores(spark, d)
    spans = F.when((F.col("cell") == "sham") & (F.col("score") > 0.1), F.array(F.struct(F.lit(0.0).alias("a"), F.col("score").alias("b"))))
    known = X.known_mismatch(F.col("label"), F.when(F.col("cell") == "sham", "sham"), spans)
    return s.withColumn("spans", known).filter("spans IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.size("spans") > 0).alias("known"))


@query("e4_voice_fits", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN true ELSE round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) >= 0.1 END AS fits FROM embeddings")
def e4(spark, d):
    e = t(spark, d, "embeddings")
    own = F.when(F.col("vec_id") % 5 != 0, F.col("embedding"))
    return e.select("vec_id", N.voice_fits(own, F.reverse("embedding"), 0.1).alias("fits"))


# --- landmarks and frames --------------------------------------------------------------------------------------------


@query("u8_lip_ratios", f"""WITH {POINTS_SQL}, b AS (SELECT vec_id, pts, greatest(list_max([x[1] for x in pts[1:17]]) - list_min([x[1] for x in pts[1:17]]), 1e-6) AS w, greatest(list_max([x[2] for x in pts[1:17]]) - list_min([x[2] for x in pts[18:27]]), 1e-6) AS h,
  list_avg([x[1] for x in pts[49:68]]) AS cx, greatest({far('pts[49]', 'pts[55]')}, 1e-3) AS m FROM p)
  SELECT vec_id, round({far('pts[63]', 'pts[67]')} / h, 4) AS opening, round({far('pts[61]', 'pts[65]')} / w, 4) AS width, round({far('pts[49]', 'pts[5]')} / w, 4) AS left_, round((pts[52][1] - cx) / m, 4) AS x FROM b""")
def u8(spark, d):
    p = points(spark, d)
    r, lips = L.lip_ratios(F.col("pts")), L.normalized_lips(F.col("pts"))
    return p.select("vec_id", F.round(r[0], 4).alias("opening"), F.round(r[1], 4).alias("width"), F.round(r[2], 4).alias("left_"), F.round(lips[3][0], 4).alias("x"))


@query("s15_lip_series", f"""WITH {POINTS_SQL}, b AS (SELECT vec_id, {far('pts[49]', 'pts[55]')} AS w, ({far('pts[62]', 'pts[68]')} + {far('pts[63]', 'pts[67]')} + {far('pts[64]', 'pts[66]')}) / 3 AS g, (vec_id % 7)::DOUBLE AS envelope FROM p)
  SELECT vec_id, w > 1 AND vec_id % 3 <> 0 AS seen, CASE WHEN w > 1 AND vec_id % 3 <> 0 THEN round(g / greatest(w, 1e-3), 4) ELSE 0 END AS aperture, CASE WHEN w > 1 AND vec_id % 3 <> 0 THEN round(ln(greatest(envelope, 1e-5)), 4) ELSE 0 END AS loudness FROM b""")
def s15(spark, d):
    p = points(spark, d).withColumns({"envelope": (F.col("vec_id") % 7).cast("double"), "valid": F.col("vec_id") % 3 != 0})
    return L.lip_series(p, "pts", "envelope", "valid").select("vec_id", "seen", F.round("aperture", 4).alias("aperture"), F.round("loudness", 4).alias("loudness"))


@query("ts4_landmark_motion", f"""WITH {POINTS_SQL}, m AS (SELECT vec_id % 9 AS k, vec_id AS f, pts[1:5] AS pts FROM p), e AS (SELECT *, greatest({far('pts[1]', 'pts[2]')}, 1.0) AS e FROM m),
  l AS (SELECT *, lag(pts) OVER w AS q, lag(e) OVER w AS eq FROM e WINDOW w AS (PARTITION BY k ORDER BY f)) SELECT k, f, round(coalesce(list_avg([{far('pts[i]', 'q[i]')} for i in range(1, 6)]) / ((e + eq) / 2), 0), 4) AS motion FROM l""")
def ts4(spark, d):
    p = points(spark, d).select((F.col("vec_id") % 9).alias("k"), F.col("vec_id").alias("f"), F.slice("pts", 1, 5).alias("pts"))
    return L.motion(p, "k", "f", "pts").select("k", "f", F.round("motion", 4).alias("motion"))


@query("ts5_appearance_change", """WITH e AS (SELECT vec_id % 9 AS k, vec_id AS f, embedding::DOUBLE[] AS x FROM embeddings), l AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY f) AS q FROM e)
  SELECT k, f, round(coalesce(list_avg([abs(x[i] - q[i]) for i in range(1, 65)]), 0), 5) AS change FROM l""")
def ts5(spark, d):
    e = t(spark, d, "embeddings").select((F.col("vec_id") % 9).alias("k"), F.col("vec_id").alias("f"), F.col("embedding").cast("array<double>").alias("x"))
    return L.appearance(e, "k", "f", "x", 1.0).select("k", "f", F.round("change", 5).alias("change"))


@query("ts6_spectral_change")
def ts6(spark, d):
    series = frames(spark, d).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"]).alias("samples"), F.greatest(F.lit(5), F.floor(F.count("*") / 8)).alias("n"))
    stretched = series.withColumn("samples", F.flatten(F.array_repeat("samples", 80)))
    return L.spectral_change(stretched, "sample_id", "samples", "n")


@query("u12_spread_frames", """WITH c AS (SELECT o_orderkey AS k, o_custkey % 400 + 30 AS n FROM orders), h AS (SELECT k, n - 1 AS last, (n - 1) // 2 AS half, (n - 1) // 10 AS tenth, ('0x' || substr(sha256(k::VARCHAR), 1, 8))::BIGINT AS a, ('0x' || substr(sha256(k::VARCHAR), 9, 8))::BIGINT AS b FROM c),
  x AS (SELECT k, [0, greatest(1, tenth) + a % (greatest(2, half) - greatest(1, tenth)), half, half + 1 + b % (greatest(half + 2, last - tenth) - half - 1), last] AS f FROM h) SELECT k, list_aggregate(list_distinct(f), 'sum')::BIGINT AS total, len(list_distinct(f)) AS n FROM x""")
def u12(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), L.spread_frames(F.col("o_custkey") % 400 + 30, F.col("o_orderkey")).alias("f"))
    return o.select("k", F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("f").cast("long").alias("n"))


@query("l16_picked_frames")
def l16(spark, d):
    p = points(spark, d).select((F.col("vec_id") % 9).alias("k"), F.col("vec_id").alias("f"), F.transform(L.lip_ratios(F.col("pts")), lambda x: F.abs(x)).alias("ratios"))
    return L.picked(p, "k", "f", "ratios")


@query("u10_tracked", f"""{FR}, b AS (SELECT sample_id, frame, event_id % 8 AS faces, value AS x, (event_id % 50)::DOUBLE AS y, 20 + value / 2 AS w, 40.0::DOUBLE AS h FROM frames),
  g AS (SELECT *, CASE WHEN faces % 4 = 0 THEN 0 WHEN faces = 7 THEN 2 ELSE 1 END AS n, least(w, h) >= 22 AND x + w <= 150 AND y + h <= 86 AS fits FROM b), l AS (SELECT *, CASE WHEN n = 1 AND fits THEN struct_pack(x := x + w / 2, y := y + h / 2, w := w) END AS box FROM g),
  m AS (SELECT *, lag(box) OVER (PARTITION BY sample_id ORDER BY frame) AS q FROM l)
  SELECT sample_id, frame, n = 1 AND fits AND (q IS NULL OR (sqrt(pow(x + w / 2 - q.x, 2) + pow(y + h / 2 - q.y, 2)) < greatest(w, h) * 0.6 AND w / q.w > 0.5 AND w / q.w < 2)) AS valid FROM m""")
def u10(spark, d):
    f = frames(spark, d)
    kind = F.col("event_id") % 8
    n = F.when(kind % 4 == 0, 0).when(kind == 7, 2).otherwise(1)
    b = f.select("sample_id", "frame", n.alias("n"), F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), (F.col("value") / 2 + 20).alias("w"), F.lit(40.0).alias("h"), F.lit(150.0).alias("wide"), F.lit(86.0).alias("tall"))
    return L.tracked(b, "sample_id", "frame", "n", "x", "y", "w", "h", "wide", "tall", 22.0).select("sample_id", "frame", "valid")


# --- lags and trials -------------------------------------------------------------------------------------------------


def pairs(spark, d) -> DataFrame:
    """Two series of small vectors a sample: the second is the first, two frames later, with noise."""
    f = frames(spark, d)
    own = f.select("sample_id", "frame", F.array(F.col("value"), F.col("value") * F.col("value") / 50, F.lit(1.0)).alias("a"), "valid")
    late = own.select("sample_id", (F.col("frame") + 2).alias("frame"), F.transform("a", lambda x: x + 0.01).alias("v"))
    return own.join(late, ["sample_id", "frame"], "left").withColumn("v", F.coalesce("v", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))


@query("ts9_distance_lag")
def ts9(spark, d):
    return Y.distances(pairs(spark, d), "sample_id", "frame", "v", "a").select("sample_id", "offset", F.round("distance", 5).alias("distance"), F.round("confidence", 5).alias("confidence"))


@query("e10_constant_lag")
def e10(spark, d):
    return Y.constant_lags(pairs(spark, d), "sample_id", "frame", "v", "a", "valid").select("sample_id", "lag", F.round("score", 6).alias("score"))


@query("ts12_onset_profiles")
def ts12(spark, d):
    f = frames(spark, d).withColumns({"loud": F.abs(F.col("value") - 50), "seen": F.lit(True)})
    return Y.onsets(f, "sample_id", "frame", "value", "loud", "seen", 4, 2, 2)


@query("ts3_deletion_trials")
def ts3(spark, d):
    detect = lambda x: [(i + 1) / 5 for i in np.flatnonzero(np.abs(np.diff(x)) > 60).tolist()]
    found = Y.deletion_trials(frames(spark, d), "sample_id", "frame", "value", detect, 8, fps=5)
    return found.groupBy(F.coalesce("bucket", F.lit("whole")).alias("bucket")).agg(F.count("*").alias("trials"), F.count_if("hit").alias("hits"), F.count_if(F.col("found") > 0).alias("found"))


@query("i25_chunk_means")
def i25(spark, d):
    f = frames(spark, d)
    smooth = lambda x: np.full(len(x), x.mean())
    return Y.per_sample(f, "sample_id", "frame", ["value"], lambda v: [(i, float(x)) for i, x in enumerate(Y.overlapped(v.astype(float), 20, 5, smooth))], "frame long, value double")


@query("i5_frame_targets", f"""{C}, k AS (SELECT clip_id % 1000003 AS c, clip_id, duration_s AS dur, CASE WHEN clip_id % 4 = 0 THEN NULL ELSE [struct_pack(a := 0.5, b := 1.1), struct_pack(a := 2.0, b := 2.0 + duration_s / 4)] END AS visual, [struct_pack(a := 1.0, b := 1.62)] AS audio FROM clips WHERE clip_id % 50 = 0),
  g AS (SELECT *, unnest(range(0, greatest(1, ceil(round(dur * 25, 9)))::BIGINT)) AS cell FROM k), s AS (SELECT clip_id, cell, cell * 0.04 AS lo, least(cell * 0.04 + 0.04, dur) AS hi, visual, audio FROM g)
  SELECT clip_id, cell, CASE WHEN visual IS NULL THEN -1 ELSE round(least(1.0, list_sum([greatest(0, least(x.b, hi) - greatest(x.a, lo)) for x in visual]) / greatest(hi - lo, 1e-9)), 4) END AS visual,
  round(least(1.0, list_sum([greatest(0, least(x.b, hi) - greatest(x.a, lo)) for x in audio]) / greatest(hi - lo, 1e-9)), 4) AS audio FROM s""")
def i5(spark, d):
    span = lambda a, b: F.struct(F.lit(a).alias("a"), b.alias("b"))
    c = clips(spark, d).filter("clip_id % 50 = 0").select("clip_id", "duration_s", F.when(F.col("clip_id") % 4 != 0, F.array(span(0.5, F.lit(1.1)), span(2.0, F.lit(2.0) + F.col("duration_s") / 4))).alias("visual"), F.array(span(1.0, F.lit(1.62))).alias("audio"))
    out = I.frame_targets(c, "clip_id", ["visual", "audio"], "duration_s")
    return out.select("clip_id", "cell", F.round("visual", 4).alias("visual"), F.round("audio", 4).alias("audio"))


# --- selection, parts, identity --------------------------------------------------------------------------------------


@query("l5_take_spread")
def l5(spark, d):
    c = clips(spark, d).withColumns({"length": F.lit(60.0), "good": F.col("decision") != "reject"})
    return S.take_spread(c, "speaker_id", "clip_id", "start_s", "end_s", "length", "good", 6, 12)


def speaker_groups(spark, d, part: int = 40) -> list[tuple]:
    """(group, members of each gender, clips, first review) of speakers that share a customer key class."""
    s = scores(spark, d).groupBy("speaker_id").agg(F.first("gender").alias("gender"), F.count("*").alias("clips"), F.min("sample_id").alias("first"))
    g = s.groupBy((F.floor(F.col("speaker_id") / 2)).alias("g")).agg(F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m"), F.sum("clips").alias("clips"), F.min("first").alias("first"))
    return [(r["g"], {"f": r["f"], "m": r["m"]}, r["clips"], r["first"]) for r in g.collect()]  # groups of speakers, not rows


@query("g7_split_by_gender")
def g7(spark, d):
    groups = speaker_groups(spark, d)
    people = {k: sum(g[1][k] for g in groups) for k in "fm"}
    targets = {s: {k: round(people[k] * share) for k in "fm"} for s, share in (("train", 0.6), ("validation", 0.15), ("test", 0.25))}
    return spark.createDataFrame(sorted(G.allot_by_kind([g[:3] for g in groups], targets).items()), "g long, split string")


@query("g10_form_parts")
def g10(spark, d):
    groups = speaker_groups(spark, d)
    parts, left = G.form_parts(groups, {"f": 2, "m": 2}, {"train": {"f": 1, "m": 1}, "test": {"f": 1, "m": 1}})
    rows = [(g, p, s) for g, (p, s) in parts.items()] + [(g, None, None) for g in left]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "g long, part long, split string")


@query("e5_identify_batch")
def e5(spark, d):
    e = t(spark, d, "embeddings").withColumns({"registry": F.col("vec_id") % 4, "input": F.col("vec_id") % 7})
    return N.identify_batch(e, "registry", "vec_id", "input", "embedding", F.when(F.col("vec_id") % 3 == 0, F.col("embedding")), F.concat(F.lit("c"), (F.col("vec_id") % 5).cast("string")))


# --- reports ---------------------------------------------------------------------------------------------------------


@query("m15_frame_head", f"{FR} SELECT sample_id, frame, greatest(score, value / 200) AS ai FROM frames")
def m15(spark, d):
    f = frames(spark, d).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("frame", "score", "value"))).alias("x"))
    f = f.select("sample_id", F.transform("x", lambda x: x["score"]).alias("v"), F.transform("x", lambda x: x["value"] / 200).alias("a"))
    return f.select("sample_id", F.posexplode(D.frame_head({"v": "visual", "a": "audio"}, "ai")).alias("frame", "ai")).withColumn("frame", F.col("frame").cast("long"))


@query("m18_temporal_report")
def m18(spark, d):
    f = frames(spark, d)
    found = M.proposals(f, "sample_id", "frame", "score", 1.0)
    truth = materialize(I.mask_to_spans(f, "sample_id", "frame", F.col("event_type").isin("click", "view"), 1.0, F.col("score")).select("sample_id", "a", "b"), "truth")
    return D.temporal_report(found.select("sample_id", "a", "b", "score"), truth, 0.5, short=3.0)


@query("b12_flat_predictions", f"{SC} SELECT sample_id, label, split, cell AS condition, speaker_id, source_clip_id, score AS video_score, [score2, score3] AS branch_scores FROM scores")
def b12(spark, d):
    return scores(spark, d).select("sample_id", "label", "split", F.col("cell").alias("condition"), "speaker_id", "source_clip_id", F.col("score").alias("video_score"), F.array("score2", "score3").alias("branch_scores"))


@query("u25_flat_report", f"""{SC}, v AS (SELECT * FROM scores WHERE split = 'validation'), r AS (SELECT score AS s FROM v WHERE cell = 'real'),
  x AS (SELECT 'validation_auc/' || cell AS name, avg((SELECT count(*) FILTER (s < score) + 0.5 * count(*) FILTER (s = score) FROM r) / (SELECT count(*) FROM r)::DOUBLE) AS value FROM v WHERE label = 1 GROUP BY cell),
  a AS (SELECT 'validation_false_alarm/' || cell AS name, avg((score >= 0.25)::INT) AS value FROM v WHERE label = 0 GROUP BY cell) SELECT name, round(value, 6) AS value FROM x UNION ALL SELECT name, round(value, 6) FROM a""")
def u25(spark, d):
    v = scores(spark, d).filter("split = 'validation'")
    return D.flat_report(v, "cell", "score", F.col("cell") == "real", 0.25).select("name", F.round("value", 6).alias("value"))


SWAPS = {"the": "that", "in the": "on the", "river": "road", "one": "two"}


@query("p9_word_edits")
def p9(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.lower(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\s+"), 1, 12), " ")).alias("phrase"))
    return docs.select("doc_id", X.edited_words(F.col("phrase"), SWAPS, ["one", "two", "three"], F.col("doc_id")).alias("e")).select("doc_id", "e.text", "e.kind")


@query("s14_timeline_checks", f"""{FR}, s AS (SELECT sample_id, min(t) AS first, max(step) - min(step) AS spread, count(*) AS n FROM (SELECT sample_id, frame * 0.2 + CASE WHEN event_id % 97 = 0 THEN 0.1 ELSE 0 END AS t, t - lag(t) OVER (PARTITION BY sample_id ORDER BY frame) AS step FROM frames) GROUP BY sample_id)
  SELECT sample_id, CASE WHEN first <> 0 THEN 'start' WHEN round(coalesce(spread, 0), 6) > 0 THEN 'step' ELSE 'ok' END AS state FROM s""")
def s14(spark, d):
    f = frames(spark, d).withColumn("t", F.col("frame") * 0.2 + F.when(F.col("event_id") % 97 == 0, 0.1).otherwise(0.0))
    return E.timeline_state(f, "sample_id", "frame", "t").select("sample_id", "state")


@query("s16_audio_blocks", f"""{FR}, a AS (SELECT sample_id, frame * 3 AS pos, value FROM frames WHERE valid), g AS (SELECT sample_id, unnest(range(0, max(pos) + 1)) AS pos FROM a GROUP BY sample_id)
  SELECT g.sample_id, g.pos // 8 AS block, round(sum(coalesce(value, 0)), 3) AS total, 8 AS size FROM g LEFT JOIN a ON a.sample_id = g.sample_id AND a.pos = g.pos GROUP BY 1, 2""")
def s16(spark, d):
    f = frames(spark, d).filter("valid").select("sample_id", (F.col("frame") * 3).alias("at"), "value")
    b = E.blocks(f, "sample_id", "at", "value", 8)
    return b.select("sample_id", "block", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), F.size("samples").alias("size"))


# --- joins, sets, identities and sound -------------------------------------------------------------------------------


@query("j2_identified_videos", "SELECT o_orderkey AS video_id, c_name AS input FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def j2(spark, d):
    inputs = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("input"))
    open_ = t(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderpriority != '5-LOW'")
    return open_.join(inputs, "o_custkey").select(F.col("o_orderkey").alias("video_id"), "input")


@query("j19_spans_on_cells", f"""{C}, s AS (SELECT clip_id, start_s, end_s, unnest(range(floor(start_s / 5)::BIGINT, ceil(end_s / 5)::BIGINT)) AS cell FROM clips) SELECT clip_id, cell, round(least(end_s, cell * 5 + 5) - greatest(start_s, cell * 5), 4) AS covered FROM s""")
def j19(spark, d):
    return I.on_cells(clips(spark, d), "clip_id", "start_s", "end_s", 5.0).select("clip_id", "cell", F.round("covered", 4).alias("covered"))


@query("o5_same_ids", "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer) SELECT count(*) FILTER (b.id IS NULL) AS only_a, count(*) FILTER (a.id IS NULL) AS only_b, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS both FROM a FULL JOIN b ON a.id = b.id")
def o5(spark, d):
    from strandline.operators.tables import same_ids

    return same_ids(t(spark, d, "orders").select(F.col("o_custkey").alias("id")), t(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("g2_identity_nodes", """WITH r AS (SELECT l_returnflag AS dataset, l_partkey::VARCHAR AS source_id, l_suppkey::VARCHAR AS s, md5(l_shipdate::VARCHAR) AS sha, l_linestatus FROM lineitem),
  n AS (SELECT dataset AS scope, 'source' AS kind, source_id AS id FROM r UNION ALL SELECT dataset, 'speaker', s FROM r UNION ALL SELECT dataset, 'speaker', 'x' || s FROM r WHERE l_linestatus = 'O' UNION ALL SELECT 'global', 'media_sha256', sha FROM r) SELECT scope, kind, count(DISTINCT id) AS ids, count(*) AS n FROM n GROUP BY ALL""")
def g2(spark, d):
    item = t(spark, d, "lineitem")
    more = F.when(F.col("l_linestatus") == "O", F.concat(F.col("l_suppkey").cast("string"), F.lit("; x"), F.col("l_suppkey").cast("string"), F.lit(";nan;"))).otherwise(F.col("l_suppkey").cast("string"))
    rows = item.select(F.col("l_returnflag").alias("dataset"), F.col("l_partkey").alias("source_id"), more.alias("speaker_ids"), F.md5(F.col("l_shipdate").cast("date").cast("string")).alias("sha256"))
    nodes = rows.select(F.explode(G.identity_nodes(rows)).alias("x")).select("x.*")
    return nodes.groupBy("scope", "kind").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n"))


@query("u7_frame_loudness", f"""{FR}, f AS (SELECT sample_id, frame // 4 AS frame, sqrt(avg(pow(CASE WHEN valid THEN value ELSE 0.01 END, 2))) AS rms FROM frames GROUP BY 1, 2), d AS (SELECT *, 20 * log10(greatest(rms, 1e-6)) AS db FROM f), m AS (SELECT *, db > max(db) OVER (PARTITION BY sample_id) - 6 AS loud FROM d)
  SELECT sample_id, frame, round(rms, 4) AS rms, round(db, 4) AS db, frame BETWEEN min(frame) FILTER (loud) OVER (PARTITION BY sample_id) AND max(frame) FILTER (loud) OVER (PARTITION BY sample_id) AS kept FROM m""")
def u7(spark, d):
    f = frames(spark, d).withColumn("x", F.when(F.col("valid"), F.col("value")).otherwise(0.01))
    return E.loudness(f, "sample_id", "frame", "x", 4, 6.0).select("sample_id", "frame", F.round("rms", 4).alias("rms"), F.round("db", 4).alias("db"), "kept")


@query("u6_video_targets", f"{SC} SELECT sample_id, label AS ai, (cell IN ('video', 'audio') AND kind = 'F')::INT AS visual, (cell = 'audio')::INT AS audio, (cell = 'sham')::INT AS mismatch FROM scores")
def u6(spark, d):
    s = scores(spark, d)
    visual, audio, mismatch = F.col("cell").isin("video", "audio") & (F.col("kind") == "F"), F.col("cell") == "audio", F.when(F.col("cell") == "sham", F.array(F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))))
    return s.select("sample_id", *[X.target(k, F.col("label"), visual, audio, mismatch).cast("int").alias(k) for k in ("ai", "visual", "audio", "mismatch")])


@query("ts19_mel_bands")
def ts19(spark, d):
    series = frames(spark, d).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"] / 1000).alias("samples"))
    return Y.mel_bands(series.withColumn("samples", F.flatten(F.array_repeat("samples", 20))), "sample_id", "samples").select("sample_id", "frame", F.transform("energies", lambda x: F.round(x, 4)).alias("energies"))
