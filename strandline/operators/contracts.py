"""Data contracts as violation tables: rules per row, rules across rows, and incremental freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised with the counts of the rules that a table breaks."""


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each key and rule that it breaks; a rule is the condition that must hold, null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def first_violation(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The first broken rule of each key, in the order they are declared."""
    out = F
    for name, c in rules.items():
        out = out.when(~F.coalesce(c, F.lit(False)), F.lit(name))
    return df.select(key, out.otherwise(F.lit(None).cast("string")).alias("rule")).filter("rule IS NOT NULL")


def repeated(df: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Values of the columns that several rows have."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("rule", F.lit(rule))


def crossing(df: DataFrame, value: str, group: str, rule: str) -> DataFrame:
    """Values that stand in more than one group, such as a content hash in two splits."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(group).alias("groups")).filter("groups > 1").withColumn("rule", F.lit(rule))


def safe_path(path: Column) -> Column:
    """A relative POSIX path without parent steps, backslashes, drives or empty parts."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"(^/)|(\\)|(^[A-Za-z]:)|(//)|(/$)|((^|/)\.{1,2}(/|$))")


def valid_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_-]+$")


def enforce(table: DataFrame) -> None:
    """Raise with the count of each rule if the violation table has rows."""
    counts = {r["rule"]: r["count"] for r in table.groupBy("rule").count().collect()}
    if counts:
        raise ContractError(", ".join(f"{k}: {v}" for k, v in sorted(counts.items())))


def signature(columns: list[Column]) -> Column:
    """SHA-256 over the columns' JSON: equal content, equal signature."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stale(wanted: DataFrame, cached: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Keys that are missing from the cache, or whose signature, source or file hash differs."""
    c = cached.select(key, F.lit(True).alias("_there"), *[F.col(p).alias(f"_{p}") for p in parts])
    same = F.coalesce(F.col("_there"), F.lit(False))
    for p in parts:
        same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
    return wanted.join(c, key, "left").filter(~same).select(key, F.when(F.col("_there"), "stale").otherwise("missing").alias("state"))
