"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket.  Each source's budget falls into
one bucket of that histogram; only the rows of the boundary bucket are summed
again by their next bits, until the threshold is one hash value.  A row is
taken by comparing its hash with its source's threshold, so nothing is sorted.

Defined results: a null text has size 0; a null source is a source of its own,
last; rows with the same id hash alike and are taken together, so a repeated
id may move its source's sum by all its rows; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import global_rank, maybe_broadcast, table, word_count
from strandline.session import materialize

BITS, LEVELS = 12, 5
WEIGHTS, CAP = (5, 2, 1), 3


def key_hash(column) -> F.Column:
    """60 bits of SHA-256 over the id's text; a null id hashes as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target of each source (columns src, source_size): shares of the whole by weight, none above cap times its size.

    Weights repeat over the sources in code-point order, null last.  What a
    capped source can't take goes to the others by weight, round by round; a
    round is one aggregate over the sources and brings three numbers back.
    """
    ranked = global_rank(sizes, [F.col("src").isNull(), F.col("src")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double")), "targets")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = (F.col("weight") * level) > F.col("most")
        row = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - row[1]) / row[2]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))).drop("_rank", "weight", "most")


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies, and the hash up to which rows get one copy more (edge: whether that hash itself does)."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = targets.withColumn("copies", F.floor(ratio)).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.select("src", "source_size", "target", "copies", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("mass"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        s = maybe_broadcast(state.select(F.col("src").alias("s"), "prefix"))
        live = rows.filter(F.col("size") > 0).join(s, F.col("src").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")), "inner")
        sums = live.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("m"))
        w = Window.partitionBy("s").orderBy("bucket")
        sums = sums.withColumn("below", F.sum("m").over(w) - F.col("m"))
        st = state.select(F.col("src"), "source_size", "target", "copies", "budget", "base")
        joined = st.join(sums, F.col("src").eqNullSafe(F.col("s")), "left").withColumn("at", F.col("base") + F.coalesce("below", F.lit(0)))
        inside = (F.col("at") <= F.col("budget")) & F.col("bucket").isNotNull()
        best = F.max_by(F.struct("bucket", "at", "m"), F.when(inside, F.col("bucket")).otherwise(F.lit(-1)))
        state = joined.groupBy("src", "source_size", "target", "copies", "budget").agg(best.alias("b"))
        state = state.select("src", "source_size", "target", "copies", "budget", F.coalesce("b.bucket", F.lit(0)).alias("prefix"), F.coalesce("b.at", F.lit(0)).alias("base"), F.coalesce("b.m", F.lit(0)).alias("mass"))
        state = materialize(state, f"threshold{level}")
    gap = F.col("budget") - F.col("base")
    return state.withColumn("edge", (F.col("mass") - gap) < gap)


def mix_sources(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per input row: doc_id, src, size, source_size, target, copies (how often the mix takes the row), taken."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), key_hash(id_col).alias("h"))
    rows = materialize(rows, "sizes")
    targets = source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, cap)
    edges = _thresholds(rows, targets)
    t = maybe_broadcast(edges.withColumnRenamed("src", "s"))
    out = rows.join(t, F.col("src").eqNullSafe(F.col("s")), "inner")
    more = (F.col("h") < F.col("prefix")) | ((F.col("h") == F.col("prefix")) & F.col("edge"))
    copies = (F.col("copies") + F.when(more & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "src", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mixed(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it; texts don't travel where sources are few."""
    names = docs.columns
    rows = docs.select(F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), key_hash(id_col).alias("h"))
    rows = materialize(rows, "sizes")
    edges = _thresholds(rows, source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, cap))
    edges = maybe_broadcast(edges.select(F.col("src").alias("__mix_src"), F.col("copies").alias("__mix_copies"), F.col("prefix").alias("__mix_prefix"), F.col("edge").alias("__mix_edge")))
    keyed = docs.withColumns({"__mix_size": word_count(F.col(text_col)), "__mix_h": key_hash(id_col)})
    out = keyed.join(edges, F.col(source_col).eqNullSafe(F.col("__mix_src")))
    more = (F.col("__mix_h") < F.col("__mix_prefix")) | ((F.col("__mix_h") == F.col("__mix_prefix")) & F.col("__mix_edge"))
    times = (F.col("__mix_copies") + F.when(more & (F.col("__mix_size") > 0), 1).otherwise(0)).cast("int")
    out = out.withColumn("__mix_times", times).filter("__mix_times > 0")
    return out.withColumn("__mix_nth", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*names)


def op1_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src IS NULL, src) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY src),
lv AS (
  SELECT 0 AS i, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s) AS level
  UNION ALL
  SELECT i + 1, ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE weight * level > 3 * source_size))::DOUBLE
                / (SELECT sum(weight) FROM s WHERE weight * level <= 3 * source_size) FROM lv WHERE i < 30),
t AS (SELECT src, source_size, least(weight * (SELECT level FROM lv WHERE i = 30), 3.0 * source_size)::DOUBLE AS target FROM s),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
c AS (
  SELECT d.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         sum(size) OVER (PARTITION BY d.src ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS below
  FROM d JOIN b ON d.src IS NOT DISTINCT FROM b.src)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN below <= budget AND (below + size <= budget OR below + size - budget < budget - below) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
