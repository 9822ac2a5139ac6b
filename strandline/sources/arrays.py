"""Array archives (npz) of score tables and features, read and written through Spark's own file access."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.manifests import SourceError


def _opened(content: bytes):
    return np.load(io.BytesIO(content), allow_pickle=False)


def read_scores(spark: SparkSession, path: str, task: str, ids: str = "sample_ids") -> DataFrame:
    """sample_id, score of a task's array in score archives; a missing score is null.  Arrays of unequal length raise."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with _opened(content) as z:
                    if task not in z or ids not in z or len(z[ids]) != len(z[task]):
                        raise SourceError(f"{name}: no {task} for each of {ids}")
                    yield pd.DataFrame({"sample_id": z[ids].astype(str), "score": z[task].astype(float)})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "sample_id string, score double")
    return found.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def first_file(spark: SparkSession, roots: list[str], name: str) -> str:
    """The path of a file under the first root that has it, else under the first root."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    return f"{roots[0].rstrip('/')}/{name}"


def read_features(spark: SparkSession, path: str, arrays: tuple[str, ...] = ("audio", "visual"), masks: tuple[str, ...] = ("audio_valid", "visual_valid"), times: str = "times_s") -> DataFrame:
    """path, frame, time, valid (all masks hold), and each array's row, of feature archives; lengths that differ raise."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with _opened(content) as z:
                    at = z[times]
                    if any(z[a].ndim != 2 or len(z[a]) != len(at) for a in arrays) or any(z[m].shape != at.shape for m in masks):
                        raise SourceError(f"{name}: arrays and timeline differ")
                    valid = np.logical_and.reduce([z[m].astype(bool) for m in masks])
                    yield pd.DataFrame({"path": name, "frame": np.arange(len(at)), "time": at.astype(float), "valid": valid, **{a: list(z[a].astype(float)) for a in arrays}})

    schema = "path string, frame long, time double, valid boolean" + "".join(f", {a} array<double>" for a in arrays)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def write_scores(df: DataFrame, path: str, key: str, tasks: list[str]) -> None:
    """A small score table as one archive: keys in order, an array a task, missing scores NaN."""
    spark = df.sparkSession
    table = df.select(key, *tasks).orderBy(key).toPandas()
    held = io.BytesIO()
    np.savez(held, sample_ids=table[key].astype(str).to_numpy().astype("U"), **{t: table[t].astype(float).to_numpy() for t in tasks})
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)
