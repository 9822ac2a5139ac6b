"""Substring dedup with suffix automata of reference shards.

A window is 50 consecutive words of one document.  Each window has a shard
key: the smallest hash among its runs of 20 words, so equal windows have equal
keys wherever they stand, and about one key in sixteen words is new.

1. Keys that documents share are found by one aggregate over (key, document).
2. Consecutive windows with one shared key make a segment.  Equal segments are
   one reference text, with the smallest document id that has it; in all other
   documents the whole segment goes.
3. The references of a key are dealt into shards of about SHARD_WORDS words.  A
   shard's suffix automaton holds for every state the smallest id among the
   references it occurs in.  The key's references, in parts of the same size,
   are streamed through each of its shards' automata: matching statistics at 50
   words give the windows that a smaller document holds, word by word.  A shard
   goes to the tasks that stream its own key's texts only; so much as one shard
   and one part is in a task, and nothing of unbounded size is broadcast.  A key
   with one reference needs no automaton.
4. Of a key with several shards (a passage that stands in very many different
   contexts) the references are first cut down to runs of windows whose hash
   two of them have.  What is left repeats, so step 2 is done once more; the
   contexts, which made the references differ, are gone.  Hashes only leave
   out what nothing can match; automata decide.
5. The spans whose windows start in a smaller document are removed.

Equal segments are told by 128-bit hashes of their words.

Defined results: a null or blank text has no words; documents with a null id
are left as they are and remove nothing; rows with the same id don't remove
each other's words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import words
from strandline.llm.common import maybe_broadcast, table
from strandline.session import batch_rows, materialize

WINDOW, GRAM = 50, 20
#: Words of a reference shard, and of what a task streams through its automaton.
SHARD_WORDS = 60_000
#: Windows in one segment at most; a longer run of one key is cut into several segments.
SEGMENT = 2048


def window_keys(w: words.Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and first word of every window of a slice: the least hash of the runs of `gram` words in it."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = words._WORDS.get(len(w.hash))
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * up[: len(w.hash)], dtype=np.uint64, out=sums[1:])
    least = words.mix((sums[gram:] - sums[:-gram]) * down[: len(w.hash) - gram + 1])
    span, have = size - gram + 1, 1
    while have * 2 <= span:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return least[at].view(np.int64), at


class SuffixAutomaton:
    """Suffix automaton over several sequences of symbols, with the least id of the sequences each state occurs in."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [None]
        self.last, self.ends = 0, 0

    def _push(self, symbol, doc) -> None:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        self.least.append(doc)
        p = self.last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                self.least.append(None)
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def add(self, sequence: list, doc: int) -> None:
        for symbol in sequence:
            self._push(symbol, doc)
        self.ends += 1
        self._push(("end", self.ends), None)  # no text has this symbol, so nothing matches across

    def finish(self) -> None:
        """Carry each state's least id to the states of its suffixes."""
        least, link = self.least, self.link
        for state in sorted(range(1, len(link)), key=self.len.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and least[state] is not None and (least[up] is None or least[state] < least[up]):
                least[up] = least[state]

    def statistics(self, sequence: list, size: int) -> list:
        """For each run of `size` symbols the least id of the sequences that hold it, or None."""
        state = length = 0
        out = []
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            state = self.next[state].get(symbol, 0)
            length = length + 1 if state else 0
            while state and self.len[self.link[state]] >= size:
                state = self.link[state]
            length = min(length, self.len[state])
            if i >= size - 1:
                out.append(self.least[state] if length >= size else None)
        return out


def _arrays(names, kinds, rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


I64, I32, TEXT, RAW = pa.int64(), pa.int32(), pa.string(), pa.binary()


def _doc_keys(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, w in words.slices(batch.column(2)):
                key, at = window_keys(w, size, gram)
                cut = np.searchsorted(w.doc[at], np.arange(len(w.count) + 1))
                rows = [(ids[first + d], tags[first + d], np.unique(key[cut[d] : cut[d + 1]])) for d in range(len(w.count)) if cut[d] < cut[d + 1]]
                yield _arrays(["doc_id", "tag", "keys"], (I64, I64, pa.list_(I64)), rows)

    return run


SEGMENTS = "key long, sid binary, doc_id long, tag long, first int, n int, text string"
_SEGMENT_KINDS = (I64, RAW, I64, I64, I32, I32, TEXT)


def _segments(size: int, gram: int):
    """The runs of windows with a shared key; a task gives each text once, later rows have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set = set()
        for batch in batches:
            ids, tags, shared = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for first, w in words.slices(batch.column(2)):
                keys, at = window_keys(w, size, gram)
                cut = np.searchsorted(w.doc[at], np.arange(len(w.count) + 1))
                rows = []
                for d in range(len(w.count)):
                    key, place = keys[cut[d] : cut[d + 1]], at[cut[d] : cut[d + 1]]
                    if not len(key):
                        continue
                    wanted = np.sort(shared[first + d].values.to_numpy())
                    mine = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                    change = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    for a, b in zip(change.tolist(), [*change[1:].tolist(), len(key)]):
                        if not mine[a]:
                            continue
                        for s in range(a, b, SEGMENT):
                            n = min(SEGMENT, b - s)
                            text = w.text(place[s], place[s] + n + size - 1)
                            name = (int(key[a]), xxhash.xxh3_128_digest(text))
                            rows.append((*name, ids[first + d], tags[first + d], int(place[s] - w.first[d]), n, None if name in told else text.decode()))
                            if len(told) < 1 << 20:
                                told.add(name)
                yield _arrays([c.split()[0] for c in SEGMENTS.split(", ")], _SEGMENT_KINDS, rows)

    return run


SPANS = "key long, sid binary, spans array<struct<begin:int,stop:int>>"


def _below(least: list, doc: int, size: int) -> list[dict]:
    """The spans of words in windows that a document smaller than doc holds."""
    out, start = [], None
    for j, smallest in enumerate([*least, None]):
        gone = smallest is not None and smallest < doc
        if gone and start is None:
            start = j
        elif not gone and start is not None:
            out.append({"begin": start, "stop": j - 1 + size})
            start = None
    return out


def _shards(size: int):
    """Rows come sorted by key, shard, part and role; a shard's references make an automaton and the part's texts are streamed through it.

    Roles: 0 reference, 1 text, 2 both (of a key with one shard, whose rows are held until the automaton is whole).
    """
    names, kinds = ["key", "sid", "spans"], (I64, RAW, pa.list_(pa.struct([("begin", I32), ("stop", I32)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        automaton, codes, whole = SuffixAutomaton(), {}, False

        def stream(key, sid, text, doc):
            nonlocal whole
            if not whole:
                automaton.finish()
                whole = True
            spans = _below(automaton.statistics([codes.get(x, -1) for x in text.split(" ")], size), doc, size)
            if spans:
                out.append((key, sid, spans))

        for batch in batches:
            for key, shard, part, role, sid, text, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (key, shard, part):
                    for row in held:
                        stream(*row)
                    at, held = (key, shard, part), []
                    automaton, codes, whole = SuffixAutomaton(), {}, False
                if role != 1:
                    automaton.add([codes.setdefault(x, len(codes)) for x in text.split(" ")], doc)
                if role == 1:
                    stream(key, sid, text, doc)
                elif role == 2:
                    held.append((key, sid, text, doc))
                if len(out) >= 2000:
                    yield _arrays(names, kinds, out)
                    out = []
        for row in held:
            stream(*row)
        yield _arrays(names, kinds, out)

    return run


def _window_hashes(size: int):
    """Hash of every window of each reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, w in words.slices(batch.column(2)):
                value, at = words.windows(w, size)
                doc = w.doc[at]
                rows = [pa.array([keys[first + d] for d in doc.tolist()], I64), pa.array([sids[first + d] for d in doc.tolist()], RAW), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays(rows, names=["key", "sid", "nth", "hash"])

    return run


def _trim(size: int):
    """The runs of the windows `nth` (sorted) of each segment, as segments of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc, tag, first, text, nth in zip(*(c.to_pylist() for c in batch.columns)):
                parts, nth = text.split(" "), np.array(nth)
                ends = np.flatnonzero(np.concatenate((np.diff(nth) != 1, [True])))
                for a, b in zip(np.concatenate(([0], ends[:-1] + 1)).tolist(), ends.tolist()):
                    words_ = " ".join(parts[nth[a] : nth[b] + size])
                    rows.append((key, xxhash.xxh3_128_digest(words_.encode()), doc, tag, int(first + nth[a]), b - a + 1, words_))
            yield _arrays([c.split()[0] for c in SEGMENTS.split(", ")], _SEGMENT_KINDS, rows)

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for first, w in words.slices(batch.column(1)):
            rows = []
            for d, n in enumerate(w.count.tolist()):
                base, keep = int(w.first[d]), np.ones(n, bool)
                for s in spans[first + d] or ():
                    keep[s["begin"] : s["stop"]] = False
                edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])))).reshape(-1, 2).tolist()
                kept = b" ".join(w.text(base + a, base + b) for a, b in edges)
                rows.append((ids[first + d], n, n - int(np.count_nonzero(keep)), kept.decode()))
            yield _arrays([c.split()[0] for c in KEPT.split(", ")], (I64, I64, I64, TEXT), rows)


def _references(segments: DataFrame) -> DataFrame:
    """key, sid, text, least (the smallest document that has it), n, of the distinct segments of keys."""
    return segments.groupBy("key", "sid").agg(F.max("text").alias("text"), F.min("doc_id").alias("least"), F.max("n").alias("n"))


def _whole(segments: DataFrame, references: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Spans of the segments that a smaller document has too, and the segments that none has (key, sid, doc_id, tag, first)."""
    here = segments.select("key", "sid", "doc_id", "tag", "first", "n").join(references.select("key", "sid", "least"), ["key", "sid"])
    gone = here.filter("least < doc_id").select("doc_id", "tag", F.col("first").alias("begin"), (F.col("first") + F.col("n") + size - 1).alias("stop"))
    return gone, here.filter("least = doc_id").select("key", "sid", "doc_id", "tag", "first")


def _matched(references: DataFrame, size: int) -> DataFrame:
    """key, sid, spans: the windows of each reference that a smaller document holds, by the automata of its key's shards."""
    keys = references.groupBy("key").agg(F.count("*").alias("texts"), F.sum(F.col("n") + size - 1).alias("words")).filter("texts > 1")
    shards = F.ceil(F.col("words") / SHARD_WORDS).cast("int")
    rows = references.join(keys.select("key", shards.alias("shards")), "key")
    own, every = F.pmod(F.xxhash64("sid"), F.col("shards")).cast("int"), F.sequence(F.lit(0), F.col("shards") - 1)
    columns = [F.col(c) for c in ("sid", "text", "least")]
    one = rows.filter("shards = 1").select("key", F.lit(0).alias("shard"), F.lit(0).alias("part"), F.lit(2).alias("role"), *columns)
    several = rows.filter("shards > 1").withColumn("own", own).withColumn("other", F.explode(every))
    refs = several.select("key", F.col("own").alias("shard"), F.col("other").alias("part"), F.lit(0).alias("role"), *columns)
    texts = several.select("key", F.col("other").alias("shard"), F.col("own").alias("part"), F.lit(1).alias("role"), *columns)
    dealt = one.unionByName(refs).unionByName(texts).repartition("key", "shard", "part").sortWithinPartitions("key", "shard", "part", "role")
    return dealt.mapInArrow(_shards(size), SPANS)


def repeated_spans(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, tag, spans (array of word ranges begin, stop) of `docs` (doc_id, tag, text) that smaller documents hold too."""
    spark = docs.sparkSession
    numbered = docs.filter("doc_id IS NOT NULL")
    with batch_rows(spark, 1000):
        keyed = numbered.mapInArrow(_doc_keys(size, gram), "doc_id long, tag long, keys array<long>")
        flat = materialize(keyed.select(F.explode("keys").alias("key"), "doc_id", "tag"), "keys")
        shared = flat.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("key")
        lists = flat.join(shared, "key").groupBy("doc_id", "tag").agg(F.collect_list("key").alias("keys"))
        segments = numbered.join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "keys").mapInArrow(_segments(size, gram), SEGMENTS)
        segments = materialize(segments, "segments")
        references = materialize(_references(segments), "references")
        gone, first = _whole(segments, references, size)
        first = materialize(first, "first")
        large = references.groupBy("key").agg(F.count("*").alias("texts"), F.sum(F.col("n") + size - 1).alias("words")).filter((F.col("texts") > 1) & (F.col("words") > SHARD_WORDS))
        large = maybe_broadcast(materialize(large.select("key"), "large"))
        wide = materialize(references.join(large, "key", "left_semi"), "wide")
        hashes = materialize(wide.select("key", "sid", "text").mapInArrow(_window_hashes(size), "key long, sid binary, nth int, hash long"), "windows")
        name = F.xxhash64("sid")
        again = hashes.groupBy("key", "hash").agg(F.min(name).alias("a"), F.max(name).alias("b")).filter("a != b").select("key", "hash")
        nth = hashes.join(again, ["key", "hash"]).groupBy("key", "sid").agg(F.sort_array(F.collect_list("nth")).alias("nth"))
        cut = first.join(wide.select("key", "sid", "text"), ["key", "sid"]).join(nth, ["key", "sid"]).select("key", "doc_id", "tag", "first", "text", "nth")
        cut = materialize(cut.mapInArrow(_trim(size), SEGMENTS), "cut")
        cut_references = materialize(_references(cut), "references")
        cut_gone, cut_first = _whole(cut, cut_references, size)
        rest = references.join(large, "key", "left_anti").unionByName(cut_references)
        spans = materialize(_matched(rest, size), "spans")
    first = first.join(large, "key", "left_anti").unionByName(cut_first)
    part = first.join(spans, ["key", "sid"]).select("doc_id", "tag", "first", F.explode("spans").alias("s"))
    part = part.select("doc_id", "tag", (F.col("first") + F.col("s.begin")).alias("begin"), (F.col("first") + F.col("s.stop")).alias("stop"))
    found = gone.unionByName(cut_gone).unionByName(part)
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    spans = materialize(repeated_spans(docs, size, gram), "spans")
    return docs.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, KEPT)


def op8_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS t FROM v),
m AS (SELECT t, min(doc_id) AS least FROM h GROUP BY t),
g AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS j FROM h JOIN m USING (t) WHERE m.least < h.doc_id),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
k AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x ANTI JOIN g USING (doc_id, j) GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
