"""Relational operators over ledger-like tables: rollups, status, joins, set operations, upserts and registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranking import numbered


def conditional_rollup(df: DataFrame, by: list[str], sums: dict[str, Column], hits: dict[str, Column]) -> DataFrame:
    """Rows, sums and conditional counts of each group; a sum over nothing is 0, a null condition doesn't count."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()], *[F.count_if(c).alias(n) for n, c in hits.items()])


def sums_in_order(df: DataFrame, by: list[str], sums: dict[str, Column], order: list[str]) -> DataFrame:
    """Sums of each group whose rows are added one by one in the order of these columns, which must tell all rows apart.

    Sums of floats depend on that order; partial sums of tasks are added as they arrive.  A sum over nothing is null.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = df.select(*by, F.struct(*order).alias("_place"), *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    return running.groupBy(*by).agg(*[F.max_by(n, "_place").alias(n) for n in sums])


def counts_by_dimension(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts of each value of each dimension in one pass over the rows: dim, value, rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims]))
    return df.select(pairs.alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("rows"))


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null; a null condition doesn't hold."""
    out = F
    for name, condition in rules:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def first_owner(df: DataFrame, key: str, order: list) -> tuple[DataFrame, DataFrame]:
    """Rows that own their key first in the order, and the later rows with the owner's row as `kept`."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumns({"_nth": F.row_number().over(w)})
    return ranked.filter("_nth = 1").drop("_nth"), ranked.filter("_nth > 1").drop("_nth")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows without those whose key is among the changes, and the changes (insert or replace)."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base rows with the changes' non-null values for the columns both have."""
    shared = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in shared])
    return base.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c) for c in base.columns])


def register(existing: DataFrame, incoming: DataFrame, key: str, fixed: list[str]) -> tuple[DataFrame, DataFrame]:
    """New keys to insert, and conflicts: known keys whose fixed columns differ."""
    old = existing.select(key, *[F.col(c).alias(f"_old_{c}") for c in fixed])
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    conflicts = incoming.join(old, key).filter(differs).drop(*[f"_old_{c}" for c in fixed])
    return incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key]), conflicts


def next_keys(df: DataFrame, existing: DataFrame, key: str, order: list, prefix: str = "spk_", width: int = 4) -> DataFrame:
    """Number rows after the largest existing number and make padded ids of the numbers."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    out = numbered(df, order, "_nth").crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("_nth")).cast("long")).drop("_top", "_nth")
    return out.withColumn(f"{key}_id", F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), width, "0")))


def merge_outputs(parts: DataFrame, key: str, content: str, priority: list) -> tuple[DataFrame, DataFrame]:
    """The newest row of each key, and the keys that come with different contents."""
    w = Window.partitionBy(key).orderBy(*priority)
    newest = parts.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
    clashes = parts.groupBy(key).agg(F.countDistinct(content).alias("contents")).filter("contents > 1")
    return newest, clashes


def pending(plan: DataFrame, records: DataFrame, key: str, redo: Column | None = None) -> DataFrame:
    """Planned jobs without a record, or whose record asks to be done again."""
    done = records if redo is None else records.filter(~F.coalesce(redo, F.lit(False)))
    return plan.join(done.select(key), key, "left_anti")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many ids are only in a, only in b, and in both."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def overlapping_partners(df: DataFrame, same: list[str], key: str, duration: str, source: str, start: str, end: str, shorter_s: float = 0.0) -> DataFrame:
    """Pairs (key, partner): same group, another clip, long enough, from another source or a stretch that doesn't overlap."""
    a = df.select(*same, key, F.col(duration).alias("_d"), F.col(source).alias("_s"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    b = df.select(*same, F.col(key).alias("partner"), F.col(duration).alias("_pd"), F.col(source).alias("_ps"), F.col(start).alias("_pa"), F.col(end).alias("_pb"))
    apart = (F.col("_s") != F.col("_ps")) | (F.col("_b") <= F.col("_pa")) | (F.col("_pb") <= F.col("_a"))
    fits = (F.col(key) != F.col("partner")) & (F.col("_pd") >= F.col("_d") - shorter_s - 1e-6) & apart
    return a.join(b, same).filter(fits).select(key, "partner")


def best_reference(df: DataFrame, same: list[str], key: str, duration: str, source: str) -> DataFrame:
    """For each row the reference of its group: another source first, then the longest, then the smallest key; itself if alone.

    A group needs only its best rows from two sources, so no pairs are made.
    """
    w = Window.partitionBy(*same, source).orderBy(F.desc(duration), key)
    tops = df.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").select(*same, F.col(source).alias("_s"), F.col(key).alias("_k"), F.col(duration).alias("_d"), "_n")
    first = Window.partitionBy(*same).orderBy(F.desc("_d"), "_k")
    best = tops.filter("_n = 1").withColumn("_r", F.row_number().over(first)).filter("_r <= 2")
    best = best.groupBy(*same).agg(F.max(F.when(F.col("_r") == 1, F.struct("_s", "_k"))).alias("_one"), F.max(F.when(F.col("_r") == 2, F.struct("_s", "_k"))).alias("_two"))
    own = tops.groupBy(*same, "_s").agg(F.max(F.when(F.col("_n") == 1, F.col("_k"))).alias("_own1"), F.max(F.when(F.col("_n") == 2, F.col("_k"))).alias("_own2"))
    joined = df.join(best, same).join(own.withColumnRenamed("_s", source), [*same, source])
    other = F.when(F.col("_one._s") != F.col(source), F.col("_one._k")).otherwise(F.col("_two._k"))
    mine = F.when(F.col("_own1") != F.col(key), F.col("_own1")).otherwise(F.col("_own2"))
    return joined.select(*df.columns, F.coalesce(other, mine, F.col(key)).alias("reference"))


def latest_complete(runs: DataFrame, key: str, complete: str, epochs: str) -> DataFrame:
    """Of each run's copies the one that is complete, then has most epochs."""
    return runs.groupBy(key).agg(F.max(F.struct(complete, epochs)).alias("b")).select(key, f"b.{complete}", f"b.{epochs}")


def missing_combinations(left: DataFrame, right: DataFrame, done: DataFrame) -> DataFrame:
    """All combinations of two small declared lists that aren't done."""
    return left.crossJoin(F.broadcast(right)).join(done, [*left.columns, *right.columns], "left_anti")


def ordered_distinct(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Per group the distinct values in the order in which they come first."""
    first = df.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))


def lock_history(locks: DataFrame, clip: str, split: str, part: str, upto: int) -> tuple[DataFrame, DataFrame]:
    """The split of each clip of earlier parts (below `upto`) on which all locks agree, and problems: clips with several splits, earlier parts without a lock."""
    old = locks.filter(F.col(part) < upto)
    agreed = old.groupBy(clip).agg(F.min(split).alias(split), F.min(part).alias(part), F.countDistinct(split).alias("_n"))
    torn = agreed.filter("_n > 1").select(F.lit("splits").alias("problem"), F.col(clip).cast("string").alias("what"))
    every = locks.sparkSession.range(1, upto).select(F.col("id").alias(part))
    gaps = every.join(old.select(part).distinct(), part, "left_anti").select(F.lit("part").alias("problem"), F.col(part).cast("string").alias("what"))
    return agreed.filter("_n = 1").drop("_n"), torn.unionByName(gaps)


def held_locks(runs: DataFrame, key: str, order: list[str], stamp: str) -> DataFrame:
    """`runs` with accepted: whether a run's stamp is that of its key's first run, which locks the key."""
    first = F.first(stamp).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("accepted", F.col(stamp).eqNullSafe(first))


def merge_owners(owners: DataFrame, merges: DataFrame, key: str, total: str, n: str, lists: list[str], review: str) -> DataFrame:
    """Owners after merges (key, into): vectors and numbers summed, lists united and sorted; an owner that took others and was done is pending again.

    A merge into one that is itself merged is followed to its end beforehand by the caller.
    """
    target = owners.join(merges.select(F.col(key).alias("_from"), F.col("into").alias("_into")), F.col(key) == F.col("_from"), "left")
    rows = target.withColumn("_own", F.col("_into").isNull()).withColumn("_to", F.coalesce("_into", key))
    sums = rows.select("_to", F.posexplode(total).alias("_i", "_x")).groupBy("_to", "_i").agg(F.sum("_x").alias("_x"))
    sums = sums.groupBy("_to").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias(total))
    rest = rows.groupBy("_to").agg(
        F.sum(n).alias(n), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
        F.max(F.when(F.col("_own"), F.col(review))).alias("_review"), F.count_if(~F.col("_own")).alias("_took"),
    )
    state = F.when((F.col("_took") > 0) & (F.col("_review") == "done"), "pending").otherwise(F.col("_review"))
    return rest.join(sums, "_to").select(F.col("_to").alias(key), total, n, *lists, state.alias(review))


def attach(sources: list[tuple[str, DataFrame]], key: str, strict: bool = True) -> DataFrame:
    """Rows of all sources with their source's name; a key that comes from several raises, or (not strict) is marked `shared`."""
    out = None
    for name, rows in sources:
        rows = rows.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    shared = out.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    if strict:
        if not shared.isEmpty():
            raise ValueError("keys come from several sources: " + ", ".join(str(r[0]) for r in shared.orderBy(key).limit(5).collect()))
        return out
    return out.join(shared.withColumn("shared", F.lit(True)), key, "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def finalize(plan: DataFrame, records: DataFrame, review: DataFrame, key: str, rows: str, row_key: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of a finished plan, and its problems (problem, what).

    Each planned key needs a record; a record's array of rows is exploded; rows
    whose review (row_key, decision) says reject go; the others must keep all rules.
    """
    missing = plan.join(records.select(key), key, "left_anti").select(F.lit("missing").alias("problem"), F.col(key).cast("string").alias("what"))
    flat = records.join(plan.select(key), key, "left_semi").select(key, F.explode(rows).alias("_r")).select(key, "_r.*")
    kept = flat.join(review.filter("decision = 'reject'").select(row_key), row_key, "left_anti")
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    bad = kept.select(F.explode(broken).alias("problem"), F.col(row_key).cast("string").alias("what"))
    return kept, missing.unionByName(bad)
