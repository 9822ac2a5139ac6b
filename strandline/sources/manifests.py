"""Manifests, bundles and parts."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Spellings of the number of speakers in planning files (fixed values).
SPEAKERS = {"1": "1", "one": "1", "2": "2", "two": "2", "n": "n", "many": "n"}


class SourceError(ValueError):
    """An input that breaks its contract."""


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Planning CSV (url, speakers, note): comment and blank lines skipped, byte-order mark removed, speakers normalised; a bad row raises."""
    raw = spark.read.option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    raw = raw.select([F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in raw.columns])
    rows = raw.filter(F.coalesce(F.trim("url"), F.lit("")) != "")
    known = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    value = F.element_at(known, F.lower(F.trim("speakers")))
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("unknown number of speakers: "), F.coalesce("speakers", F.lit("")))))
    return rows.select(F.trim("url").alias("url"), checked.cast("string").alias("speakers"), F.coalesce(F.trim("note"), F.lit("")).alias("note"))


def read_manifest(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema: null and [] stay apart; blank lines are skipped; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def file_sha(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes, hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def load_bundle(spark: SparkSession, folder: str, schema: StructType | str, kind: str, manifest: str = "manifest.jsonl") -> DataFrame:
    """A folder with receipt.json and a manifest: schema name, manifest hash and row count must match the receipt."""
    receipt = json.loads(_read_text(spark, f"{folder}/receipt.json"))
    if receipt.get("schema") != kind:
        raise SourceError(f"schema {receipt.get('schema')!r}, not {kind!r}")
    if file_sha(spark, f"{folder}/{manifest}") != receipt.get("manifest_sha256"):
        raise SourceError("the manifest's hash differs from the receipt")
    rows = read_manifest(spark, f"{folder}/{manifest}", schema)
    if rows.count() != receipt.get("rows"):
        raise SourceError("the manifest's rows differ from the receipt")
    return rows


def list_parts(spark: SparkSession, root: str, names: Iterable[str] | str = "all", prefix: str = "part_", marker: str = "receipt.json") -> list[tuple[str, str]]:
    """(name, path) of the chosen parts, sorted; a part may lie one folder deeper; unsafe and repeated names raise."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if names == "all":
        chosen = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName().startswith(prefix))
    else:
        chosen = sorted(names)
    if any("/" in n or "\\" in n or n in ("", ".", "..") for n in chosen):
        raise SourceError("a part's name must be one folder")
    if len(set(chosen)) != len(chosen):
        raise SourceError("a part is named twice")
    out = []
    for name in chosen:
        here = f"{root.rstrip('/')}/{name}"
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{here}/{marker}")):
            found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{here}/*/{marker}")) or []
            if len(found) != 1:
                raise SourceError(f"{name}: {len(found)} folders hold {marker}")
            here = found[0].getPath().getParent().toString()
        out.append((name, here))
    if not out:
        raise SourceError("no parts")
    return out


def union_parts(parts: list[tuple[str, DataFrame]], sha: str = "sha256") -> DataFrame:
    """Rows of all parts with their part's name; content that stands in two parts raises."""
    out = None
    for name, rows in parts:
        rows = rows.withColumn("dataset_part", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    shared = out.filter(F.col(sha).isNotNull()).groupBy(sha).agg(F.countDistinct("dataset_part").alias("n")).filter("n > 1")
    if not shared.isEmpty():
        raise SourceError("content stands in two parts")
    return out


def layered(roots: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first root that has each key."""
    out = None
    for place, rows in enumerate(roots):
        rows = rows.withColumn("_place", F.lit(place))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_place")
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_place")


def scored_runs(runs: list[tuple[str, DataFrame]], key: str = "sample_id") -> DataFrame:
    """Union of score tables, one a run; runs over different samples raise."""
    out = None
    for name, rows in runs:
        rows = rows.withColumn("run", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    per = out.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("h"))
    if per.select("n", "h").distinct().count() > 1:
        raise SourceError("the runs cover different samples")
    return out
