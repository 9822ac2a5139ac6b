"""Token-id output: blocks of concatenated ids with Elias-Fano coded document boundaries.

File format: Parquet files of blocks, so that any store Spark writes to will
do and its commit protocol covers lost executors.  Each block has the columns

  part, block   position in the order of document ids
  n_docs, n_tokens, width   width: bytes an id (2 if every id is below 65536)
  doc_ids       the documents' ids, in order
  ids           the ids of all documents, one after the other, little-endian
  low_bits, low, high, samples   the documents' ends (running token counts)

Ends e_0 <= e_1 <= ... below u are split: `low_bits` low bits each, packed one
after the other in `low`; the rest in unary in `high`, where the i-th one bit
stands at (e_i >> low_bits) + i.  `samples` holds the place of every 64th one
as an unsigned 32-bit number, so select reads a few words: about
2 + log2(u / n) bits a document rather than 64.

Defined results: a null or empty text is the closing id alone; rows with a
null id come first; rows with equal ids stand next to each other; an empty
table makes no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import words
from strandline.llm.common import table
from strandline.llm.tokens import piece_ids, tokenizer_path
from strandline.session import batch_rows, scratch_path

BLOCK_TOKENS = 1 << 20
#: Bytes of text that a task encodes at once: larger slices repeat fewer pieces.
SLICE = 24 << 20
SAMPLE = 64
BLOCKS = "part int, block int, n_docs long, n_tokens long, width int, doc_ids array<long>, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with constant-time access by select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        values = values.astype(np.uint64)
        low_bits = max(0, int(int(values[-1] + np.uint64(1)) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def decode(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.zeros(self.n, np.int64)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(self.n)) << self.low_bits) | low

    def __getitem__(self, i: int) -> int:
        """The i-th value: from the sample before it, forward over at most SAMPLE ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, nth = int(np.frombuffer(self.samples, "<u4", 1, 4 * (i // SAMPLE))[0]), i - i % SAMPLE
        while nth < i:
            place += 1
            byte = self.high[place >> 3] >> (place & 7)
            if not byte:
                place |= 7
            elif byte & 1:
                nth += 1
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (self.low[at >> 3] >> (at & 7) & 1) << k
        return (place - i) << self.low_bits | low

    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + len(self.samples)


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS, id_col="doc_id", text_col="text") -> None:
    """Encode every text, close it with end_id, and write the blocks in ascending order of ids."""
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def pack(part: int, block: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(ids), "<u4")
        width = 2 if flat.max(initial=0) < 1 << 16 else 4
        ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids]))
        row = (part, block, len(ids), len(flat), width, doc_ids, flat.astype(f"<u{width}").tobytes(), ends.low_bits, ends.low, ends.high, ends.samples)
        i32, i64, raw = pa.int32(), pa.int64(), pa.binary()
        kinds = (i32, i32, i64, i64, i32, pa.list_(i64), raw, i32, raw, raw, raw)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, doc_ids, ids, size, block, part = piece_ids(tokenizer), [], [], 0, 0, 0
        for batch in words.gathered(batches, 1, SLICE):
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            docs_ = batch.column(0).to_pylist()
            for first, coded, bounds in known.encode_many(batch.column(1), SLICE):
                bounds = bounds.tolist()
                for doc, a, b in zip(docs_[first:], bounds, bounds[1:]):
                    doc_ids.append(doc)
                    ids.append(coded[a:b].tobytes() + end)
                    size += b - a + 1
                    if size >= block_tokens:
                        yield pack(part, block, doc_ids, ids)
                        doc_ids, ids, size, block = [], [], 0, block + 1
        if ids:
            yield pack(part, block, doc_ids, ids)

    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id")
    with batch_rows(docs.sparkSession, 1000):
        ranged.sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()).mapInArrow(words.frugal(blocks), BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in no order."""
    store = spark.read.schema(BLOCKS).parquet(path)
    sizes = store.select("part", "block", "n_tokens")
    before, starts = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # a row a range
        starts.append((part, before))
        before += n
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    parts = F.broadcast(spark.createDataFrame(starts, "part int, _before long"))
    base = sizes.withColumn("_inside", inside).join(parts, "part").select("part", "block", (F.col("_inside") + F.col("_before")).alias("_base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"]).decode()
                first = np.concatenate(([0], ends[:-1]))
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first.tolist(), ends.tolist())]
                n, i32, i64 = r["n_docs"], pa.int32(), pa.int64()
                columns = [pa.array([r["part"]] * n, i32), pa.array([r["block"]] * n, i32), pa.array(r["doc_ids"], i64), pa.array(first, i64), pa.array(ends - first, i64), pa.array(crcs, i64)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "_at", "n_tokens", "ids_crc32"])

    docs = store.mapInArrow(documents, "part int, block int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "block"]).select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_output(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
