"""The corpus pipeline: documents in, packed sequences of the documents that are kept out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its rows are written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact, jaccard, mixing, packing, quality
from strandline.llm.common import table
from strandline.session import materialize, release


#: Bytes of text that a packing task encodes at once; executors that ran the other stages have less room than fresh ones.
SLICE = 5 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    release(spark)
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    release(spark)
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    release(spark)
    return jaccard.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    release(spark)
    return mixing.take_mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix, packed into sequences."""
    release(spark)
    packed = packing.pack(packing.token_pieces(docs, slice_bytes=SLICE))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-duplicate join", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]
#: The classifier is fitted and the tokeniser is a library: SQL can't express them; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
