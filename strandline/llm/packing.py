"""Best-fit packing of token pieces into sequences of fixed capacity, in bulk-synchronous rounds.

Pieces of full length are sequences of their own.  For the others so many
sequences are opened as their tokens need at least (or as there are pieces
longer than half a sequence).  A round then

1. sorts what is left, pieces by length and gaps by room, into ranges over the
   cluster; ties are broken by number, so a hot length spreads over ranges;
2. sweeps the ranges for successors: going up, a piece waits until a gap comes
   that holds it, and a gap takes the longest piece that waits.  Claims of
   several pieces on one gap are thus settled by rank.  The sweep needs no
   single task: with +1 for a piece and -1 for a gap, running sums (carried over
   ranges by one count for each range and size) give every row a level, and the
   rows of one level, at most two for each size, are pairs of neighbours;
3. places the pairs and lessens the room of their gaps.

Rounds repeat until no piece is left; where none finds a gap, sequences are
opened for the rest.  A round places one piece a sequence, so that the number of
rounds is that of pieces in a sequence.  It is bounded for any input: of pieces
shorter than 1 / TINY of the capacity all beyond KEEP a sequence are first laid
into crates of at most twice that size, which are packed as pieces are.  What
finds no gap later is short pieces for few sequences as a rule: all beyond LOOSE
a sequence (the second time, all) of those up to 1 / SHORT of the capacity are
laid into crates again, one a sequence where nothing longer is left, and the
others fill up what the crates leave.

Defined results: a null or empty text is the closing id alone; a text longer
than the capacity is cut into full pieces and a rest; rows with the same id
are packed each for itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import words
from strandline.llm.common import table
from strandline.llm.tokens import piece_ids, tokenizer_path
from strandline.session import batch_rows, discard, materialize, trim

CAPACITY = 2048
#: Pieces below 1 / TINY of the capacity go into crates where a sequence would get more than KEEP of them.
TINY, KEEP = 32, 12
#: Of pieces that found no gap, those up to 1 / SHORT of the capacity go into crates where a new sequence would get more than LOOSE of them.
SHORT, LOOSE = 8, 2
#: Bytes of text that a task encodes at once: larger slices repeat fewer pieces and take more memory.
SLICE = 16 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, id_col="doc_id", text_col="text", slice_bytes: int = SLICE) -> DataFrame:
    """Encode each whole text, close it with end_id, and cut what is longer than the capacity; slice_bytes of text are encoded at once."""
    path = path or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_ids(path)
        for batch in words.gathered(batches, 1, slice_bytes):
            rows: list[list] = [[], [], [], [], []]
            docs_ = batch.column(0).to_pylist()
            for first, ids, bounds in known.encode_many(batch.column(1), slice_bytes):
                bounds = bounds.tolist()
                for doc, a, b in zip(docs_[first:], bounds, bounds[1:]):
                    for piece, at in enumerate(range(0, b - a + 1, capacity)):
                        length = min(capacity, b - a + 1 - at)
                        crc = zlib.crc32(ids[a + at : min(b, a + at + length)])
                        if at + length > b - a:
                            crc = zlib.crc32(end, crc)
                        for column, value in zip(rows, (doc, piece, at, length, crc)):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(words.frugal(cut), PIECES)


def sweep(state: DataFrame) -> DataFrame:
    """Match pieces (gap false, size: length) with gaps (gap true, size: room), best fit, one piece a gap.

    `state` (id, size, gap) comes back with mate and mate_size, null where a row has none.  Equal sizes match.
    """
    order = ["size", "gap", "id"]
    ranged = state.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    runs = ranged.groupBy("size", "gap", part).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))  # two for each size, and one a range
    step = F.when(F.col("gap"), -F.col("n")).otherwise(F.col("n"))
    before = Window.orderBy("size", "gap", "_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum(step).over(before), F.lit(0))).select("size", "gap", "_part", "_first", "_base")
    nth = F.col("_at") - F.col("_first")
    level = F.when(F.col("gap"), F.col("_base") - nth).otherwise(F.col("_base") + nth + 1)
    levels = ranged.withColumn("_part", part).join(F.broadcast(runs), ["size", "gap", "_part"]).select("id", "size", "gap", level.alias("_level"))
    w = Window.partitionBy("_level").orderBy("size", "gap")
    beside = lambda f: f(F.struct("id", "size", "gap")).over(w)
    mate = F.when(F.col("gap"), beside(F.lag)).otherwise(beside(F.lead))
    out = levels.withColumn("_mate", mate).withColumn("_mate", F.when(F.col("_mate.gap") != F.col("gap"), F.col("_mate")))
    out = materialize(out.select("id", "size", "gap", F.col("_mate.id").alias("mate"), F.col("_mate.size").alias("mate_size")), "swept")
    discard(ranged)
    return out


def _crates(tiny: DataFrame, width: int) -> DataFrame:
    """Lay short pieces (id, size) side by side: id, crate, place (offset in the crate); a crate is shorter than the width and its longest piece together."""
    order = ["size", "id"]
    ranged = tiny.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("_part", F.shiftright("_at", 33).cast("int")), "tiny")
    sums = ranged.groupBy("_part", "size").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))  # one for each short size, and one a range
    before = Window.orderBy("_part", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0))).drop("n")
    start = F.col("_base") + (F.col("_at") - F.col("_first")) * F.col("size")
    laid = ranged.join(F.broadcast(sums), ["_part", "size"]).select("id", "size", start.alias("_start"), F.floor(start / width).alias("crate"))
    return laid.withColumn("place", F.col("_start") - F.min("_start").over(Window.partitionBy("crate"))).select("id", "size", "crate", "place")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with a column length between 1 and the capacity) with sequence_id and offset."""
    spark = pieces.sparkSession
    with batch_rows(spark, 1000):
        pieces = materialize(pieces.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    size = F.col("length").cast("int").alias("size")
    width = max(1, capacity // TINY)
    short = (F.col("length") < width) & (F.col("length") < capacity)
    tokens, tiny, large = pieces.filter(F.col("length") < capacity).agg(F.sum("length"), F.count_if(short), F.count_if(F.col("length") * 2 > capacity)).first()
    opening = max(-(-(tokens or 0) // capacity), large or 0)
    items = pieces.filter(F.col("length") < capacity).select(F.col("_id").alias("id"), size)
    laid, crates = [], 0

    def crated(short: DataFrame, width: int, most: int) -> DataFrame:
        """The crates (id, size) of short pieces, numbered below all others; they are at most so many."""
        nonlocal crates
        rows = materialize(_crates(short, width).withColumn("crate", F.col("crate") + crates), "crates")
        laid.append(rows)
        crates += most
        return rows.groupBy("crate").agg(F.sum("size").cast("int").alias("size")).select((-F.col("crate") - 1).alias("id"), "size")

    if tiny > KEEP * opening:
        share = F.lit(round(KEEP * opening / tiny * 2**20))
        loose = (F.col("size") >= width) | (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
        items = items.filter(loose).unionByName(crated(items.filter(~loose), width, tiny))
    state = items.withColumn("gap", F.lit(False))
    opened, placed, again = 0, None, False
    left, rest = items.agg(F.count("*"), F.min("size")).first()
    while left:
        if opening:
            fresh = spark.range(opened, opened + opening).select("id", F.lit(capacity).alias("size"), F.lit(True).alias("gap"))
            state, opened = state.unionByName(fresh), opened + opening
        swept = sweep(state)
        matched, room = F.col("mate").isNotNull(), F.col("size") - F.coalesce("mate_size", F.lit(0))
        pairs = swept.filter(~F.col("gap") & matched).select("id", F.col("mate").alias("sequence"), (F.lit(capacity) - F.col("mate_size")).cast("long").alias("offset"))
        placed = pairs if placed is None else placed.unionByName(pairs)
        loose = ~F.col("gap") & ~matched
        left, rest, longest, widest = swept.agg(F.count_if(loose), F.min(F.when(loose, F.col("size"))), F.max(F.when(loose, F.col("size"))), F.max(F.when(F.col("gap"), room))).first()
        opening, wide, boxed = 0, 0, F.lit(False)
        if left and longest > widest:  # what no gap can hold now, none will
            stuck, short = loose & (F.col("size") > widest), F.col("size") * SHORT <= capacity
            fit = range(1, SHORT + 1)  # of pieces longer than 1 / (k + 1) of the capacity a sequence holds k
            over = [F.count_if(F.col("size") * (k + 1) > capacity) for k in fit]
            tokens, n, n_short, longest, *over = swept.filter(stuck).agg(F.sum("size"), F.count("*"), F.count_if(short), F.max(F.when(short, F.col("size"))), *over).first()
            opening = max(-(-tokens // capacity), *[-(-m // k) for k, m in zip(fit, over)])
            few, again = (0 if again else LOOSE) * opening, True  # a second rest is small
            if n_short > few:
                boxed = stuck & short & (F.pmod(F.xxhash64("id", F.lit(opened)), F.lit(1 << 20)) >= F.lit(round(few / n_short * 2**20)))
                tokens = swept.filter(boxed).agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
                wide = min(capacity - longest + 1, -(-tokens // opening)) if n == n_short else capacity * 2 // SHORT - longest + 1
        trim(spark)  # plans of many rounds
        kept = (loose & ~boxed) | (F.col("gap") & (room >= F.lit(rest)))
        state = swept.filter(kept).select("id", F.when(F.col("gap"), room).otherwise(F.col("size")).alias("size"), "gap")
        if wide:
            state = state.unionByName(crated(swept.filter(boxed).select("id", "size"), wide, tokens // wide + 1).withColumn("gap", F.lit(False)))
    whole = pieces.filter(F.col("length") >= capacity).select(F.col("_id").alias("id"), (F.col("_id") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed is not None:
        for rows in reversed(laid):  # crates may stand in later crates
            outer = placed.filter("id < 0").select((-F.col("id") - 1).alias("crate"), "sequence", F.col("offset").alias("_offset"))
            inside = rows.join(outer, "crate").select("id", "sequence", (F.col("_offset") + F.col("place")).alias("offset"))
            placed = placed.unionByName(materialize(inside, "inside"))
        whole = whole.unionByName(placed.filter("id >= 0").select("id", (F.col("sequence") * 2 + 1).alias("sequence_id"), "offset"))
    return pieces.join(whole.withColumnRenamed("id", "_id"), "_id").drop("_id")


def op3_best_fit_packing(spark, sf_dir):
    packed = pack(token_pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
