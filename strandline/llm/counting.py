"""Token counts by overlap resynchronisation.

A text of at most CHUNK characters is encoded as a whole.  A longer one is cut
into chunks that overlap; the chunks are dealt over the cluster and encoded
with offsets.  Two neighbours are spliced at a boundary between tokens that
both have in their overlap and that is proven stable: the two characters
around it stand side by side in no piece of the vocabulary, so no merge ever
crosses it and what lies left and right of it is encoded independently, in the
chunk and in the whole text alike.  Documents with an overlap that has no such
boundary are cut again with chunks and overlaps twice as long, until all
splice or the chunk is the whole text.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; rows are
counted one by one, whatever ids they share; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.tokens import tokenizer_path
from strandline.session import materialize

CHUNK, OVERLAP = 1 << 15, 512
LIMIT = 4096
_SPACE = "▁"


class Pieces:
    """A sentencepiece model, and the pairs of characters that stand side by side inside its pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.joined: set[str] = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                self.joined.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self._plain: dict[str, bool] = {" ": True}

    def _unchanged(self, char: str) -> bool:
        """Whether the model's normaliser leaves a character as it is."""
        known = self._plain.get(char)
        if known is None:
            known = self._plain[char] = self.model.normalize(char).lstrip(_SPACE) == char
        return known

    def stable(self, left: str, right: str) -> bool:
        pair = (left + right).replace(" ", _SPACE)
        return pair not in self.joined and self._unchanged(left) and self._unchanged(right)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def begins(self, text: str) -> np.ndarray:
        """The character at which each token of a text begins."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.concatenate((np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]))
        return char[np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)]

    def boundaries(self, text: str, begins: np.ndarray, low: int, high: int) -> tuple[list[int], list[int]]:
        """Stable boundaries of a text at characters in [low, high), and the number of tokens before each."""
        first, last = np.searchsorted(begins, (max(low, 1), high))
        at = [(int(begins[i]), int(i)) for i in range(first, last) if begins[i - 1] < begins[i] and self.stable(text[begins[i] - 1], text[begins[i]])]
        return [a for a, _ in at], [i for _, i in at]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


CUT = "doc_id long, n_bytes long, n_tokens long, row long, chunk int, chunks int, text string"


def _cut(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[at : at + chunk + overlap] for at in range(0, max(1, len(text)), chunk)]


def _count_short(path: str, chunk: int, overlap: int):
    """Count the short texts; cut the long ones, each under a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = _pieces(path), TaskContext.get().partitionId() << 33
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                counts = iter(pieces.counts([t for t in texts if len(t) <= chunk]))
                rows: list[tuple] = []
                for doc, text in zip(ids, texts):
                    size = len(text.encode())
                    if len(text) <= chunk:
                        rows.append((doc, size, next(counts), None, None, None, None))
                    else:
                        parts = _cut(text, chunk, overlap)
                        rows += [(doc, size, None, row, i, len(parts), p) for i, p in enumerate(parts)]
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in CUT.split(", ")])

    return run


ENCODED = "doc_id long, n_bytes long, row long, chunk int, chunks int, n long, head array<long>, head_no array<long>, tail array<long>, tail_no array<long>"


def _encode_chunks(path: str, chunk: int, overlap: int):
    """Token number of each chunk, and its stable boundaries in the overlaps with both neighbours (characters of the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        i64, i32, many = pa.int64(), pa.int32(), pa.list_(pa.int64())
        kinds = (i64, i64, i64, i32, i32, i64, many, many, many, many)
        for batch in batches:
            rows = []
            for doc, size, row, no, chunks, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                begins, base = pieces.begins(text), no * chunk
                head = pieces.boundaries(text, begins, 0, overlap) if no else ([], [])
                tail = pieces.boundaries(text, begins, chunk, chunk + overlap) if no + 1 < chunks else ([], [])
                rows.append((doc, size, row, no, chunks, len(begins), [base + x for x in head[0]], head[1], [base + x for x in tail[0]], tail[1]))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in ENCODED.split(", ")])

    return run


def _recut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            rows = []
            for doc, size, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = _cut(text, chunk, overlap)
                rows += [(doc, size, row, i, len(parts), p) for i, p in enumerate(parts)]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "row", "chunk", "chunks", "text"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, chunks (1 where the text was encoded whole)."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = materialize(rows.mapInArrow(_count_short(path, chunk, overlap), CUT), "counted")
    out = first.filter("row IS NULL").select("doc_id", "n_bytes", "n_tokens", F.lit(1).alias("chunks"))
    left = first.filter("row IS NOT NULL").select("doc_id", "n_bytes", "row", "chunk", "chunks", "text")
    while not left.isEmpty():
        encoded = materialize(left.repartition("row", "chunk").mapInArrow(_encode_chunks(path, chunk, overlap), ENCODED), "encoded")
        order = Window.partitionBy("row").orderBy("chunk")
        common = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
        spliced = encoded.withColumn("splice", common).withColumn("before", F.lag("splice").over(order))
        number = lambda at, no, where: F.element_at(F.col(no), F.array_position(F.col(at), F.col(where)).cast("int"))
        upto = F.when(F.col("chunk") + 1 == F.col("chunks"), F.col("n")).when(F.col("splice").isNotNull(), number("tail", "tail_no", "splice"))
        since = F.when(F.col("chunk") == 0, F.lit(0)).when(F.col("before").isNotNull(), number("head", "head_no", "before"))
        sums = spliced.withColumn("part", upto - since).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("part").alias("n_tokens"), F.count("*").cast("int").alias("chunks"), F.count("part").alias("whole"))
        sums = materialize(sums, "spliced")
        out = out.unionByName(sums.filter("whole = chunks").select("doc_id", "n_bytes", "n_tokens", "chunks"))
        again = left.join(sums.filter("whole < chunks").select("row"), "row", "left_semi")
        body = F.struct("chunk", F.when(F.col("chunk") + 1 == F.col("chunks"), F.col("text")).otherwise(F.substring("text", 1, chunk)).alias("core"))
        again = again.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(body)).alias("parts"))
        chunk, overlap = chunk * 2, overlap * 2
        again = again.select("doc_id", "n_bytes", "row", F.array_join("parts.core", "").alias("text"))
        left = materialize(again.mapInArrow(_recut(chunk, overlap), "doc_id long, n_bytes long, row long, chunk int, chunks int, text string"), "again")
    return out


def op6_token_counts(spark, sf_dir):
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
