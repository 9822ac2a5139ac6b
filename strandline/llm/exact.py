"""Exact dedup by progressive refinement: byte length, then a hash of the first characters, then a hash of the whole text.

1. Lengths are counted.  A row whose length no other row has is settled.
2. Only rows of repeated lengths have their first PREFIX_CHARS characters
   hashed; a (length, prefix hash) pair that occurs once settles its row.
3. Only rows that are left have their whole content hashed with SHA-256.

What a step leaves is told to the next scan as a table of bits, which is
broadcast: one bit for each of LENGTH_BITS or PREFIX_BITS classes of keys, so
that its size is fixed (65,536 and 262,144 rows of 64 bits at most).  Keys that share a class let a row through that a step
would settle; it is hashed for nothing, and results are the same.  Texts never
travel: each scan works on them where they are read.

Texts are equal when identical after lower-casing A-Z; a null text equals the
empty one.  Of equal texts the row with the largest id stays.  Null ids lose
to any id; rows repeating both text and id count as copies, of which one
stays.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ascii_lower, maybe_broadcast, table
from strandline.session import materialize

PREFIX_CHARS = 64
LENGTH_BITS, PREFIX_BITS = 22, 24


def _bits(keys: DataFrame, key: Column, bits: int, name: str) -> DataFrame:
    """A table of bits (word, mask under `name`) with one set for each key's class."""
    at = F.pmod(key, F.lit(1 << bits))
    words = keys.select(F.shiftright(at, 6).alias(f"{name}_word"), (at % 64).cast("int").alias("bit"))
    mask = F.bit_or(F.expr("shiftleft(1L, bit)")).alias(name)
    return F.broadcast(materialize(words.groupBy(f"{name}_word").agg(mask), name))


def _in(rows: DataFrame, table: DataFrame, key: Column, bits: int, name: str) -> DataFrame:
    """`rows` with a boolean column `name`: whether the key's class is set in the table of bits."""
    at = F.pmod(key, F.lit(1 << bits))
    out = rows.withColumn("_at", at).join(table, F.shiftright("_at", 6) == F.col(f"{name}_word"), "left")
    set_ = F.expr(f"coalesce(shiftright({name}, CAST(_at % 64 AS INT)) & 1L = 1L, false)")
    return out.withColumn(name, set_).drop(f"{name}_word", "_at")


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))  # lower-casing A-Z keeps the length


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", digest_all: bool = False) -> DataFrame:
    """doc_id, digest, candidate: the whole-text hash of the rows that refinement left (of all rows with digest_all)."""
    rows = _sized(docs, id_col, text_col)
    lengths = rows.groupBy("_bytes").agg(F.count("*").alias("n")).filter("n > 1")
    rows = _in(rows, _bits(lengths, F.col("_bytes"), LENGTH_BITS, "_same_length"), F.col("_bytes"), LENGTH_BITS, "_same_length")
    rows = rows.withColumn("_prefix", F.when(F.col("_same_length"), F.xxhash64("_bytes", ascii_lower(F.substring("_text", 1, PREFIX_CHARS)))))
    prefixes = rows.filter("_same_length").groupBy("_bytes", "_prefix").agg(F.count("*").alias("n")).filter("n > 1")
    key = F.coalesce("_prefix", F.lit(0).cast("long"))
    rows = _in(rows, _bits(prefixes, F.col("_prefix"), PREFIX_BITS, "_same_prefix"), key, PREFIX_BITS, "_same_prefix")
    candidate = F.col("_same_length") & F.col("_same_prefix")
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    return rows.select("doc_id", (digest if digest_all else F.when(candidate, digest)).alias("digest"), candidate.alias("candidate"))


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest."""
    rows = fingerprints(docs, id_col, text_col, digest_all).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "fingerprints")
    best = F.max(F.struct("doc_id", (-F.col("_row")).alias("last")))
    groups = rows.filter("candidate").groupBy(F.col("digest").alias("_digest")).agg(best.alias("_best"), F.count("*").alias("_size")).filter("_size > 1")
    rows = rows.join(maybe_broadcast(materialize(groups, "groups")), F.when(F.col("candidate"), F.col("digest")) == F.col("_digest"), "left")
    alone = F.col("_digest").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("_best.doc_id"))
    stays = alone | (F.col("_row") == -F.col("_best.last"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"), stays.alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of `docs`, all columns, without the copies."""
    names = docs.columns
    verdict = exact_dedup(docs, id_col, text_col)
    dropped = materialize(verdict.filter("NOT kept").select(F.col("doc_id").alias("__gone_id"), "digest", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("__repeat")), "dropped")
    gone = dropped.filter("NOT __repeat").select("__gone_id", "digest")
    repeats = dropped.filter("__repeat").select("__gone_id", "digest").distinct()
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumn("__own_digest", F.sha2(norm, 256))
    same = lambda side: keyed["__own_digest"].eqNullSafe(side["digest"]) & keyed[id_col].eqNullSafe(side["__gone_id"])
    gone = maybe_broadcast(gone.distinct())
    kept = keyed.join(gone, same(gone), "left_anti")
    if not dropped.filter("__repeat").isEmpty():
        own = F.xxhash64(F.to_json(F.struct(*names)))  # of rows that repeat id and text the same one stays in every run
        once = kept.join(maybe_broadcast(repeats), same(repeats), "left_semi").groupBy(id_col, "__own_digest").agg(F.min_by(F.struct(*names), own).alias("__one"))
        kept = kept.join(maybe_broadcast(repeats), same(repeats), "left_anti").select(*names).unionByName(once.select("__one.*"))
    return kept.select(*names)


def op2_exact_dedup(spark, sf_dir):
    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
