"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import materialize, ship_package

#: Words are maximal runs of anything outside 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only after its rows are counted and found to be at most this many narrow rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; also makes sure that Python workers can import this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a narrow table has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the counted size allows; otherwise the planner shuffles and AQE splits hot keys."""
    return F.broadcast(df) if small(df, rows) else df


def global_rank(df: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """Number rows from 0 in a total order without a single-task sort.

    Rows are dealt into ranges, numbered inside each range, and shifted by the
    counts of the ranges before.  Only one count a range reaches the driver.
    """
    spark = df.sparkSession
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    shifts, total = [], 0
    for part, n in counts:
        shifts.append((part, total))
        total += n
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    if not shifts:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_range")
    offset = F.element_at(F.create_map(*[F.lit(x) for s in shifts for x in s]), F.col("_range")) if len(shifts) <= 64 else None
    ranked = dealt.withColumn("_inside", inside)
    if offset is None:
        ranked = ranked.join(F.broadcast(spark.createDataFrame(shifts, "_range int, _shift long")), "_range")
        offset = F.col("_shift")
    return ranked.withColumn(name, (F.col("_inside") + offset).cast("long")).drop("_inside", "_range", "_shift")
