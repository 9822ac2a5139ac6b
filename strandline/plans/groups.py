"""Queries of the vector, graph, resampling, contract and detection operators (survey 2.11, 2.12, 2.14 to 2.16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import contracts as Q
from strandline.operators import detection as D
from strandline.operators import graph as G
from strandline.operators import intervals as I
from strandline.operators import ranking as R
from strandline.operators import resample as B
from strandline.operators import segmentation as C
from strandline.operators import vectors as E
from strandline.plans.base import FRAMES_SQL, SCORES_SQL, frames, query, scores, t
from strandline.session import materialize

VEC = "v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), nv AS (SELECT vec_id, label, i, x / greatest(1e-8, sqrt(sum(x * x) OVER (PARTITION BY vec_id))) AS u FROM v)"
CEN = "s AS (SELECT label AS owner, i, sum(x) AS s FROM v GROUP BY ALL), c AS (SELECT owner, i, s / greatest(1e-8, sqrt(sum(s * s) OVER (PARTITION BY owner))) AS c FROM s)"
SIM = "sim AS (SELECT vec_id, label, owner, round(sum(u * c), 9) AS sim FROM nv JOIN c USING (i) GROUP BY ALL)"


def _vectors(spark, d):
    return t(spark, d, "embeddings")


@query("e1_normalize", f"WITH {VEC} SELECT vec_id, round(sum(u * u), 6) AS norm, round(max(u), 6) AS top FROM nv GROUP BY vec_id")
def e1(spark, d):
    n = _vectors(spark, d).select("vec_id", E.normalized(F.col("embedding")).alias("u"))
    return n.select("vec_id", F.round(E.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.array_max("u"), 6).alias("top"))


@query("e3_registry_match", f"""WITH {VEC}, {CEN}, {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, owner) AS r FROM sim), b AS (SELECT vec_id, max(owner) FILTER (r = 1) AS owner, max(sim) FILTER (r = 1) AS sim, max(sim) FILTER (r = 2) AS second FROM r GROUP BY vec_id)
  SELECT vec_id, owner, round(sim, 5) AS sim, CASE WHEN sim >= 0.5 AND sim - coalesce(second, -1) >= 0.05 THEN 'matched' WHEN sim >= 0.3 THEN 'suggested' ELSE 'new' END AS decision FROM b""")
def e3(spark, d):
    v = _vectors(spark, d)
    out = E.match(v, "vec_id", "embedding", E.centroids(v, "label", "embedding"), "label", "centroid", 0.5, 0.3, 0.05)
    return out.select("vec_id", "owner", F.round("sim", 5).alias("sim"), "decision")


@query("e6_threshold_calibration", f"""WITH {VEC}, {CEN}, {SIM}, b AS (SELECT vec_id, max(sim) FILTER (owner = label) AS same, max(sim) FILTER (owner <> label) AS other FROM sim GROUP BY vec_id)
  SELECT round(quantile_cont(same, 0.05), 5) AS same_p5, round(quantile_cont(same, 0.5), 5) AS same_p50, round(quantile_cont(other, 0.5), 5) AS other_p50, round(quantile_cont(other, 0.95), 5) AS other_p95 FROM b""")
def e6(spark, d):
    v = _vectors(spark, d)
    out = E.same_and_other(v, "vec_id", "embedding", "label", E.centroids(v, "label", "embedding"), "centroid")
    q = lambda c, p, n: F.round(F.percentile(c, F.lit(p)), 5).alias(n)
    return out.agg(q("same", 0.05, "same_p5"), q("same", 0.5, "same_p50"), q("other", 0.5, "other_p50"), q("other", 0.95, "other_p95"))


@query("e7_vector_moves", "WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label, i, x, 0 AS n FROM v UNION ALL SELECT label, i, -x, -1 FROM v WHERE label = 3 UNION ALL SELECT 4, i, x, 1 FROM v WHERE label = 3) , s AS (SELECT label, i, sum(x) AS x FROM m GROUP BY ALL) SELECT s.label, round(sum(s.x), 3) AS total, (SELECT count(*) FROM embeddings e WHERE e.label = s.label) + (SELECT coalesce(sum(n), 0)::BIGINT FROM m WHERE m.label = s.label AND m.i = 1) AS n FROM s GROUP BY s.label")
def e7(spark, d):
    v = _vectors(spark, d)
    moved = v.filter("label = 3")
    moves = moved.select("label", F.col("embedding").alias("vector"), F.lit(-1).alias("sign")).unionByName(moved.select(F.lit(4).alias("label"), F.col("embedding").alias("vector"), F.lit(1).alias("sign")))
    out = E.move(E.centroids(v, "label", "embedding"), "label", moves)
    return out.select("label", F.round(F.aggregate("total", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), "n")


@query("e9_consistency", f"WITH {VEC}, {CEN}, {SIM} SELECT label, round(min(sim), 5) AS consistency FROM sim WHERE owner = label GROUP BY label")
def e9(spark, d):
    v = _vectors(spark, d)
    return E.consistency(v, "label", "embedding", E.centroids(v, "label", "embedding")).select("label", F.round("consistency", 5).alias("consistency"))


@query("e2_leader_clusters")
def e2(spark, d):
    v = _vectors(spark, d).withColumn("source", (F.col("vec_id") % 16).cast("long"))
    return E.leader_clusters(v, "source", "vec_id", "embedding", 0.45)


ROWS_SQL = "rows_ AS (SELECT doc_id, lang || '/' || source || '/' || n_chars AS a, md5(text) AS b, source AS split FROM documents)"
GROUP_SQL = f"""WITH RECURSIVE {ROWS_SQL}, e AS (SELECT x.doc_id AS s, y.doc_id AS o FROM rows_ x JOIN rows_ y ON x.doc_id <> y.doc_id AND x.a = y.a UNION SELECT x.doc_id, y.doc_id FROM rows_ x JOIN rows_ y ON x.doc_id <> y.doc_id AND x.b = y.b),
  r AS (SELECT doc_id, doc_id AS other FROM rows_ UNION SELECT r.doc_id, e.o FROM r JOIN e ON e.s = r.other), g AS (SELECT doc_id, min(other) AS group_id FROM r GROUP BY doc_id)"""


def _groups(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("n_chars").cast("string")).alias("a"), F.md5("text").alias("b"), F.col("source").alias("split"))
    return rows, G.identity_groups(rows, "doc_id", {"shape": F.col("a"), "sha": F.col("b")})


@query("g3_connected_groups", f"{GROUP_SQL} SELECT doc_id, group_id FROM g")
def g3(spark, d):
    return _groups(spark, d)[1]


@query("g5_leakage_check", f"{GROUP_SQL} SELECT group_id, count(DISTINCT split) AS splits, count(*) AS rows FROM g JOIN rows_ USING (doc_id) GROUP BY group_id HAVING count(DISTINCT split) > 1")
def g5(spark, d):
    rows, groups = _groups(spark, d)
    return G.leaking_groups(groups, rows, "doc_id", "split")


@query("g6_group_split", None)
def g6(spark, d):
    _, groups = _groups(spark, d)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    chosen = G.allot([tuple(r) for r in sizes.collect()], {"train": 0.6, "validation": 0.15, "test": 0.25})
    return groups.join(spark.createDataFrame(list(chosen.items()), "group_id long, split string"), "group_id").groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"))


@query("g4_speaker_groups", """WITH RECURSIVE k AS (SELECT DISTINCT s_nationkey AS n, s_suppkey AS s FROM supplier), r AS (SELECT s, s AS other FROM k UNION SELECT r.s, b.s FROM r JOIN k a ON a.s = r.other JOIN k b ON b.n = a.n) SELECT s AS speaker_id, min(other) AS group_id FROM r GROUP BY s""")
def g4(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("speaker_id"), F.col("s_nationkey").alias("n"))
    return G.identity_groups(s, "speaker_id", {"video": F.col("n")})


@query("g1_identity_lists", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([source, lang, 'unknown', source], lambda x: x <> 'unknown'))), ',') AS ids FROM documents")
def g1(spark, d):
    raw = F.concat_ws(";", F.col("source"), F.concat(F.lit(" "), F.col("lang")), F.lit("unknown"), F.lit(""), F.col("source"))
    return t(spark, d, "documents").select("doc_id", F.array_join(G.identity_list(raw), ",").alias("ids"))


# --- resampling ------------------------------------------------------------------------------------------------------


@query("b1_paired_delta", None)
def b1(spark, d):
    return B.paired_delta(scores(spark, d).filter("split = 'test'"), "speaker_id", "score", "score2")


@query("b2_auc_interval", None)
def b2(spark, d):
    return B.interval(B.bootstrap_auc(scores(spark, d).filter("split = 'test'"), "source_clip_id", ["score3"]), "auc", ["name"])


AUC_RUNS = f"""g AS (SELECT split, generator, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY split, generator ORDER BY score) - neg / 2.0 AS below FROM g),
  runs AS (SELECT split, generator, round((sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 6) AS auc FROM c GROUP BY ALL)"""


@query("b6_seed_summary", f"WITH {SCORES_SQL}, {AUC_RUNS} SELECT split, round(avg(auc), 5) AS mean, round(stddev_pop(auc), 5) AS std, count(*) AS seeds FROM runs GROUP BY split")
def b6(spark, d):
    runs = R.auc(scores(spark, d), ["split", "generator"]).withColumn("auc", F.round("auc", 6))
    return B.seed_summary(runs, ["split"], "auc").select("split", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "seeds")


@query("b5_seed_ensemble", f"WITH {SCORES_SQL} SELECT source_clip_id, round(avg(CASE WHEN score < 0.1 THEN NULL ELSE score END), 6) AS score FROM scores GROUP BY source_clip_id")
def b5(spark, d):
    nan = F.when(F.col("score") < 0.1, F.lit(float("nan"))).otherwise(F.col("score"))
    return scores(spark, d).groupBy("source_clip_id").agg(F.round(F.avg(F.when(~F.isnan(nan), nan)), 6).alias("score"))


@query("b7_gate_table", f"WITH {SCORES_SQL}, {AUC_RUNS}, m AS (SELECT split, max(auc) FILTER (generator = 'g0') AS a, max(auc) FILTER (generator = 'g1') AS b FROM runs GROUP BY split) SELECT split, round(a - b, 6) AS delta, a - b > 0 AS passed FROM m")
def b7(spark, d):
    runs = R.auc(scores(spark, d), ["split", "generator"]).withColumn("auc", F.round("auc", 6))
    m = runs.groupBy("split").pivot("generator", ["g0", "g1"]).agg(F.max("auc"))
    return m.select("split", F.round(F.col("g0") - F.col("g1"), 6).alias("delta"), (F.col("g0") - F.col("g1") > 0).alias("passed"))


@query("b11_model_names", "SELECT DISTINCT regexp_extract(event_type || '_seed' || (user_id % 3), '^(.*)_seed', 1) AS model, event_type || '_seed' || (user_id % 3) AS folder FROM events")
def b11(spark, d):
    folder = F.concat("event_type", F.lit("_seed"), (F.col("user_id") % 3).cast("string"))
    return t(spark, d, "events").select(F.regexp_extract(folder, "^(.*)_seed", 1).alias("model"), folder.alias("folder")).distinct()


@query("b10_cost_projection", "SELECT event_type, round(avg(value) * count(*) / 3600, 5) AS hours, round(avg(value) * count(*) / 3600 * 10, 4) AS hours_x10 FROM events GROUP BY event_type")
def b10(spark, d):
    h = F.avg("value") * F.count("*") / 3600
    return t(spark, d, "events").groupBy("event_type").agg(F.round(h, 5).alias("hours"), F.round(h * 10, 4).alias("hours_x10"))


# --- contracts -------------------------------------------------------------------------------------------------------

RULES = {
    "has text": lambda: F.col("n_chars") > 0,
    "length": lambda: F.length("text") == F.col("n_chars"),
    "known language": lambda: F.col("lang").isin("en", "de", "fr"),
    "source id": lambda: Q.valid_id(F.col("source")),
    "not long": lambda: F.col("n_chars") <= 10000,
}
RULES_SQL = """SELECT doc_id, unnest(list_filter([CASE WHEN NOT coalesce(n_chars > 0, false) THEN 'has text' END, CASE WHEN NOT coalesce(length(text) = n_chars, false) THEN 'length' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'known language' END,
  CASE WHEN NOT coalesce(regexp_full_match(source, '[A-Za-z0-9_-]+'), false) THEN 'source id' END, CASE WHEN NOT coalesce(n_chars <= 10000, false) THEN 'not long' END], lambda x: x IS NOT NULL)) AS rule FROM documents"""


@query("q1_row_rules", RULES_SQL)
def q1(spark, d):
    return Q.violations(t(spark, d, "documents"), "doc_id", {k: v() for k, v in RULES.items()})


@query("q1_first_violation", f"WITH v AS ({RULES_SQL}) SELECT doc_id, arg_min(rule, list_position(['has text', 'length', 'known language', 'source id', 'not long'], rule)) AS rule FROM v GROUP BY doc_id")
def q1f(spark, d):
    return Q.first_violation(t(spark, d, "documents"), "doc_id", {k: v() for k, v in RULES.items()})


@query("q2_repeated_content", "SELECT md5(text) AS sha, count(*) AS rows, 'duplicate media' AS rule FROM documents GROUP BY 1 HAVING count(*) > 1")
def q2(spark, d):
    return Q.repeated(t(spark, d, "documents").select(F.md5("text").alias("sha")), ["sha"], "duplicate media")


@query("q2_content_across_splits", "SELECT md5(text) AS sha, count(DISTINCT source) AS groups, 'sha across splits' AS rule FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def q2s(spark, d):
    return Q.crossing(t(spark, d, "documents").select(F.md5("text").alias("sha"), "source"), "sha", "source", "sha across splits")


@query("q3_safe_paths", "SELECT page_id, NOT regexp_matches(substr(url, 9), '(^/)|(//)|(/$)|((^|/)\\.{1,2}(/|$))') AND substr(url, 9) <> '' AS safe FROM pages")
def q3(spark, d):
    return t(spark, d, "pages").select("page_id", Q.safe_path(F.expr("substring(url, 9)")).alias("safe"))


@query("q7_signatures", "SELECT sha256('{\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}') AS signature, count(*) AS n FROM orders GROUP BY 1")
def q7(spark, d):
    return t(spark, d, "orders").groupBy(Q.signature([F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")]).alias("signature")).agg(F.count("*").alias("n"))


@query("q8_cache_freshness", "SELECT c_custkey AS k, CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'stale' END AS state FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE s_suppkey IS NULL OR s_nationkey <> c_nationkey")
def q8(spark, d):
    wanted = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("signature"))
    return Q.stale(wanted, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("signature")), "k", ["signature"])


@query("q10_archive_preconditions", "SELECT o_custkey % 23 AS batch, count(*) FILTER (o_orderstatus = 'O') AS unfinished, count(*) FILTER (o_totalprice < 2000) AS missing FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0")
def q10(spark, d):
    return t(spark, d, "orders").groupBy((F.col("o_custkey") % 23).alias("batch")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("unfinished"), F.count_if(F.col("o_totalprice") < 2000).alias("missing")).filter("unfinished > 0")


# --- temporal detection ----------------------------------------------------------------------------------------------


@query("m17_temporal_ap", None)
def m17(spark, d):
    f = frames(spark, d)  # spans in whole frames, where overlaps are exact
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), F.desc("a"), F.desc("b"))
    found = materialize(C.proposals(f, "sample_id", "frame", "score", 1.0).withColumn("seq", (F.row_number().over(order) - 1).cast("long")), "proposals")
    truth = materialize(I.mask_to_spans(f, "sample_id", "frame", F.col("event_type").isin("click", "view"), 1.0, F.col("score")).select("sample_id", "a", "b"), "truth")
    hits = D.match_proposals(found, truth, [0.5, 0.75, 0.95])
    recall = D.average_recall(found, truth)
    return D.temporal_ap(hits, truth.count()).crossJoin(recall).select("threshold", F.round("ap", 6).alias("ap"), "matched", "segments", *[F.round(f"ar_{n}", 6).alias(f"ar_{n}") for n in (1, 5, 10)])


@query("m20_localization_by_type", f"WITH {FRAMES_SQL} SELECT event_type, round(avg(score) FILTER (valid) - avg(score) FILTER (NOT valid), 5) AS lift, count(*) AS cells FROM frames GROUP BY event_type")
def m20(spark, d):
    return frames(spark, d).groupBy("event_type").agg(F.round(F.avg(F.when(F.col("valid"), F.col("score"))) - F.avg(F.when(~F.col("valid"), F.col("score"))), 5).alias("lift"), F.count("*").alias("cells"))


@query("m20_localization_by_type_full", f"""WITH {FRAMES_SQL}, c AS (SELECT event_type, sample_id, avg(score) FILTER (valid) - avg(score) FILTER (NOT valid) AS lift, arg_max(valid, struct_pack(s := score, f := -frame)) AS top FROM frames GROUP BY ALL HAVING bool_or(valid) AND NOT bool_and(valid)),
  g AS (SELECT event_type, score, count(*) FILTER (valid) AS pos, count(*) FILTER (NOT valid) AS neg FROM frames SEMI JOIN c USING (event_type, sample_id) GROUP BY ALL), b AS (SELECT *, sum(neg) OVER (PARTITION BY event_type ORDER BY score) - neg / 2.0 AS below FROM g),
  a AS (SELECT event_type, sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM b GROUP BY ALL), m AS (SELECT event_type, count(*) AS clips, avg(lift) AS lift, avg(top::INT) AS peak FROM c GROUP BY ALL)
  SELECT e.event_type, coalesce(clips, 0) AS clips, round(auc::DOUBLE, 5) AS cell_auc, round(lift, 5) AS lift, round(peak, 5) AS peak_rate FROM (SELECT DISTINCT event_type FROM frames) e LEFT JOIN m USING (event_type) LEFT JOIN a USING (event_type)""")
def m20_full(spark, d):
    out = D.localization_by(frames(spark, d), "event_type", "sample_id", "frame", "valid", "score")
    return out.select("event_type", "clips", *[F.round(c, 5).alias(c) for c in ("cell_auc", "lift", "peak_rate")])
