"""Set-similarity join on word shingles with token-combination prefixes, and the components of its links.

Documents with the same shingle set are one node.  A node's shingles are put
in one order for all: shingles known to be frequent come last, by frequency
class, the rest by hash.  Two sets whose Jaccard similarity is at least t share

* a shingle among the first n - ceil(t n) + 1 of each, and the first shingle
  they share in this order is there.  If it is a rare one, the single shingle
  is the index key;
* if it is a frequent one, all they share are frequent, and the prefix of each
  set must hold a frequent one (else a set has no such keys).  Then the prefixes are
  extended to 0.4 n + 2 shingles (for t = 0.8): there the shared shingles
  outnumber the others of both sets together by two, so that some two shared
  frequent shingles are neighbours in both orders.  Neighbouring pairs of
  frequent shingles are the index keys: two-token combinations, one a shingle.

So the keys of a set grow with its size only.  The list of frequent shingles
is bounded (FREQUENT) and decides the order alone; any list gives the same
links.

With each key goes the set's room there: how many shingles it can share at
most if this key holds the first one shared (those from the key's place on, or
the frequent ones).  Sets of n and m shingles that link share at least
t / (1 + t) (n + m), so the room bounds a partner's size: `reach`.  Two members
of a key are a candidate pair only if each is within the other's reach; a true
link is within it at the key of the first shingle it shares.  Members that
nobody in their key can reach leave it.

A key's members aren't paired with each other.  The member whose shingles are
the most common ones, as an unedited original's are, is compared with the
others; links join components; members of one component need no further
comparison.  Then, as long as a key's members that had no turn can reach some
of another component (told by a profile of sizes, reaches and components, of
bounded length), some more of them are compared with those.  Of keys with the
same members the first in the order stands for all.  Near sets meet in many
keys: the few that nodes name by hash are worked on first, and in other keys a
pair that met in one of those isn't made again.  Pairs are judged by an upper
bound on their overlap from parity maps, then by the whole sets.

Defined results: a null or blank text has an empty set and links with nothing;
fewer words than a shingle make one shingle; rows with a null id take part,
and a component's id is the smallest id in it that isn't null; repeated rows
are members like any others; an empty table gives no rows; other columns are
ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import words
from strandline.llm.common import maybe_broadcast, table
from strandline.operators.graph import connected_components
from strandline.session import batch_rows, discard, materialize, release

SIZE = 5
PERCENT = 80
#: At most so many frequent shingles are listed (8 bytes each, sent to every worker); they only decide the order.
FREQUENT, FREQUENT_MIN = 1 << 17, 16
#: A key's members are compared in turns of GROWTH, GROWTH**2, ... of them, after the first.
GROWTH = 8
#: Each node names so many of its keys, by hash, to be worked on before all others.
LEADS = 4
#: A key's profile has a row for each class of sizes that differ by a factor of CLASS.
CLASS = 1.02
MAP_BITS = 256
#: Shingles that a task holds while it looks for frequent ones; texts that go to a Python worker at once.
_BUFFER, _ROWS = 1 << 20, 1000


def _node(shingles: np.ndarray) -> int | None:
    return None if not len(shingles) else xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parity(shingles: np.ndarray) -> bytes:
    """For each class of hashes whether the set has an odd number of them; two to four classes a shingle."""
    bits = max(MAP_BITS, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else MAP_BITS
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Classes that differ in parity: no more than the shingles that only one of two sets has.  The longer map is folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


DESCRIBED = "doc_id long, n long, node long, map binary, token long, times long"


def _describe(size: int):
    """Rows for documents (node, set size, parity map), and rows for shingles that a task saw three times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        amount = 0

        def frequent() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= 3
            token, times = token[keep].view(np.int64), times[keep]
            none = [None] * len(token)
            return _batch(DESCRIBED, none, none, none, none, token, times)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, w in words.slices(batch.column(1), lower=True):
                sets = words.shingle_sets(w, size)
                nodes = [_node(s) for s in sets]
                none = [None] * len(sets)
                yield _batch(DESCRIBED, ids[first : first + len(sets)], [len(s) for s in sets], nodes, [_parity(s) for s in sets], none, none)
                for node, s in zip(nodes, sets):
                    if node is not None and node not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(node)
                        held.append(s)
                        amount += len(s)
                if amount > _BUFFER:
                    yield frequent()
                    held, amount = [], 0
        if held:
            yield frequent()

    return run


KEYED = "doc_id long, node long, n int, score int, keys array<long>, reaches array<int>"


def _keys(size: int, percent: int, listed):
    """Index keys of every document's set under the order that the broadcast list of frequent shingles gives.

    score: how common the set's shingles are, 0 to 2**15.  reaches: with each key the largest size of a partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = listed.value
        i64, i32 = pa.int64(), pa.int32()
        kinds = (i64, i64, i32, i32, pa.list_(i64), pa.list_(i32))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, w in words.slices(batch.column(1), lower=True):
                out: list[list] = [[] for _ in kinds]
                for doc, s in zip(ids[first:], words.shingle_sets(w, size)):
                    n = len(s)
                    if not n:
                        continue
                    rank = np.zeros(n, np.int8)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        rank = np.where(known[at] == s, classes[at], 0).astype(np.int8)
                    order = np.argsort(rank, kind="stable")  # s is sorted, so ties stay in hash order
                    rare = n - int(np.count_nonzero(rank))
                    prefix = n - -(-percent * n // 100) + 1
                    single = s[order[: min(rare, prefix)]]
                    extend = min(n, (100 - percent) * 2 * n // 100 + 2) if rare < prefix else rare
                    extended = s[order[rare:extend]]
                    pairs = words.mix(words.mix(extended[:-1]) + extended[1:]) if len(extended) > 1 else extended[:0]
                    room = np.concatenate((n - np.arange(len(single)), np.full(len(pairs), n - rare)))
                    reach = room * (100 + percent) // percent - n
                    score = int(rank.sum(dtype=np.int64) * 256 // n)
                    for column, value in zip(out, (doc, _node(s), n, score, np.concatenate((single, pairs)).view(np.int64), reach.astype(np.int32))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[c.split()[0] for c in KEYED.split(", ")])

    return run


SETS = "node long, members binary"


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in words.slices(batch.column(0), lower=True):
                sets = [s for s in words.shingle_sets(w, size) if len(s)]
                yield _batch(SETS, [_node(s) for s in sets], [s.tobytes() for s in sets])

    return run


def _linked(overlap, a, b, percent):
    return 100 * overlap >= percent * (a + b - overlap)


def _by_maps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(a):
                continue
            apart = np.array([_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            keep = _linked((na + nb - apart) // 2, na, nb, percent)
            yield _batch("a long, b long", a[keep], b[keep])

    return run


def _by_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                keep.append(_linked(int(np.count_nonzero(x[at] == y)), len(x), len(y), percent))
            mask = pa.array(keep, pa.bool_())
            yield _batch("a long, b long", batch.column(0).filter(mask), batch.column(1).filter(mask))

    return run


def _one_of_each(entries: DataFrame) -> DataFrame:
    """key, pivot (score, node, n, reach of the member with the most common shingles): of keys with the same members the one with the largest reaches."""
    own = F.xxhash64("node")
    marks = entries.groupBy("key").agg(F.max(F.struct("score", "node", "n", "reach")).alias("pivot"), F.count("*").alias("members"), F.bit_xor(own).alias("x"), F.sum(F.shiftrightunsigned(own, 20).cast("decimal(20,0)")).alias("s"), F.sum("reach").alias("sum"))
    return marks.filter("members > 1").groupBy("pivot.node", "members", "x", "s").agg(F.max(F.struct("sum", "key", "pivot")).alias("k")).select("k.key", "k.pivot")


class _Join:
    """One run of the join: the tables it works on, and the links it has found."""

    def __init__(self, docs: DataFrame, size: int, percent: int) -> None:
        self.docs, self.size, self.percent = docs, size, percent
        spark = docs.sparkSession
        with batch_rows(spark, _ROWS):
            described = materialize(docs.mapInArrow(words.frugal(_describe(size)), DESCRIBED), "described")
        self.rows = described.filter("token IS NULL").select("doc_id", "n", "node")
        nodes = described.filter("node IS NOT NULL").groupBy("node")
        self.nodes = materialize(nodes.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("map").alias("map"), F.count("*").alias("copies")), "nodes")
        counts = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT_MIN)
        top = counts.orderBy(F.desc("times"), "token").limit(FREQUENT).toPandas()
        known = top["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(known)
        classes = np.floor(np.log2(np.maximum(top["times"].to_numpy(np.float64), 1))).astype(np.int8)
        self.listed = spark.sparkContext.broadcast((known[order], classes[order]))
        self.links: list[DataFrame] = []

    def entries(self) -> DataFrame:
        """key, node, n, reach, score, and the pivot (score, node, n, reach) of each key that several nodes have.

        Of keys with the same members (as the shingles of a shared passage have) the first in the order stays:
        there every member's reach is largest.
        """
        spark = self.docs.sparkSession
        with batch_rows(spark, _ROWS):
            keyed = materialize(self.docs.mapInArrow(words.frugal(_keys(self.size, self.percent, self.listed)), KEYED), "keyed")
        several = maybe_broadcast(self.nodes.filter("copies > 1").select("node", "rep"))
        once = keyed.join(several, "node", "left").filter(F.col("rep").isNull() | F.col("doc_id").eqNullSafe(F.col("rep")))
        flat = once.select("node", "n", "score", F.explode(F.arrays_zip("keys", "reaches")).alias("k")).select(F.col("k.keys").alias("key"), "node", "n", "score", F.col("k.reaches").alias("reach"))
        shared = flat.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min("n").alias("least"), F.max("reach").alias("most")).filter("first != last")
        every = flat.join(shared.select("key", "least", "most"), "key").filter("least <= reach AND n <= most").drop("least", "most")
        every = materialize(every, "entries")
        del flat, shared, once
        discard(keyed)
        release(spark)
        out = materialize(every.join(_one_of_each(every), "key"), "entries")
        discard(every)
        return out

    def compare(self, pairs: DataFrame) -> bool:
        """Judge pairs (a, b) and keep those that link; whether any do."""
        spark = self.docs.sparkSession
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        meta = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}"))
        judged = pairs.join(meta("a"), "a").join(meta("b"), "b").select("a", "b", "na", "nb", "ma", "mb")
        with batch_rows(spark, 2000):
            judged = materialize(judged.mapInArrow(words.frugal(_by_maps(self.percent)), "a long, b long"), "survivors")
        if judged.isEmpty():
            return False
        wanted = judged.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialize(wanted.join(self.nodes, "node").select("node", F.col("rep").alias("id")), "wanted")
        ids = maybe_broadcast(wanted.select("id"))
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        sets = texts.mapInArrow(words.frugal(_sets(self.size)), SETS).join(maybe_broadcast(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])
        side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"s{x}"))
        whole = judged.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
        with batch_rows(spark, 64):  # two whole sets a row
            found = materialize(whole.mapInArrow(words.frugal(_by_sets(self.percent)), "a long, b long"), "links")
        del whole, sets, texts
        release(spark)
        if found.isEmpty():
            return False
        self.links.append(found)
        return True

    def group(self) -> None:
        """found: node, component of the nodes that links join; the links give way to the stars they make."""
        edges = self.docs.sparkSession.createDataFrame([], "a long, b long")
        for more in self.links:
            edges = edges.unionByName(more)
        self.found = materialize(connected_components(edges, "a", "b"), "components")
        for more in self.links:
            discard(more)
        self.links = [self.found.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))]

    def reachable(self, live: DataFrame) -> DataFrame:
        """`live` (key, node, n, reach, ...) with component: the members that can reach one of another component in their key."""
        live = live.join(self.found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS))).cast("int").alias("class")
        classes = live.groupBy("key", size).agg(F.min("n").alias("n"), F.max("reach").alias("reach"), F.min("component").alias("a"), F.max("component").alias("b"))
        profile = classes.groupBy("key").agg(F.collect_list(F.struct("n", "reach", "a", "b")).alias("profile"), F.min("a").alias("a"), F.max("b").alias("b")).filter("a != b").select("key", "profile")
        other = F.exists("profile", lambda p: (p["n"] <= F.col("reach")) & (p["reach"] >= F.col("n")) & ((p["a"] != F.col("component")) | (p["b"] != F.col("component"))))
        return live.join(profile, "key").filter(other).drop("profile")

    def settle(self, live: DataFrame, turn: int) -> None:
        """Compare the members of each key in turns, the ones with the most common shingles first, until none can reach another component."""
        while True:
            reached = materialize(self.reachable(live), "reached")
            live = materialize(reached.join(_one_of_each(reached).select("key"), "key"), "live")
            discard(reached)
            if live.isEmpty():
                return
            nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))  # Spark cuts such ranks before it shuffles
            chosen = materialize(live.withColumn("nth", nth).filter(F.col("nth") <= turn).drop("nth"), "chosen")
            left = chosen.select("key", F.col("node").alias("a"), F.col("n").alias("m"), F.col("reach").alias("far"), F.col("component").alias("kind"), F.col("done").alias("had"))
            fits = F.expr("component != kind AND n <= far AND m <= reach AND NOT (a < node AND turned) AND NOT arrays_overlap(done, had)")
            turned = live.join(chosen.select("key", "node", F.lit(True).alias("turned")), ["key", "node"], "left").withColumn("turned", F.coalesce("turned", F.lit(False)))
            if self.compare(left.join(turned, "key").filter(fits).select("a", F.col("node").alias("b"))):
                self.group()
            live = live.drop("component").join(chosen.select("key", "node"), ["key", "node"], "left_anti")
            turn *= GROWTH

    def components(self) -> DataFrame:
        """node, component of all nodes that link with others."""
        entries = self.entries()
        stars = entries.filter("node != pivot.node AND n <= pivot.reach AND pivot.n <= reach")
        self.compare(stars.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")))
        self.group()
        left = entries.filter("node != pivot.node").select("key", "node", "n", "reach", "score")
        left = materialize(self.reachable(left).drop("component"), "left")
        place = F.struct(F.xxhash64("key").alias("h"), "key")
        leads = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(place)), 1, LEADS).alias("k")).select(F.explode("k.key").alias("key")).distinct()
        leads = materialize(leads, "leads")
        first = materialize(left.join(leads, "key", "left_semi"), "first")
        self.settle(first.withColumn("done", F.expr("CAST(array() AS array<long>)")), GROWTH)
        done = first.groupBy("node").agg(F.collect_list("key").alias("done"))
        rest = left.join(leads, "key", "left_anti").join(done, "node", "left").withColumn("done", F.coalesce("done", F.expr("CAST(array() AS array<long>)")))
        rest = materialize(rest, "rest")
        members = rest.groupBy("key").agg(F.count("*").alias("members"))
        met = rest.select("key", F.explode("done").alias("d")).groupBy("key", "d").agg(F.count("*").alias("members"))
        settled = met.join(members, ["key", "members"], "left_semi").select("key").distinct()
        self.settle(rest.join(settled, "key", "left_anti"), GROWTH**4)  # few pairs are left here, so large turns are cheap
        return self.found


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, node (set id, null if empty), component_id."""
    if not 67 <= percent <= 100:
        raise ValueError("the prefixes are proven for similarities of 67 to 100 percent")
    join = _Join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), size, percent)
    found = join.components()
    labels = join.nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = labels.join(least, "component").select("node", "component_id")
    rows = join.rows.join(labels, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of `docs`, all columns, with one row of each component: one with the smallest id; a null id loses to any.

    Rows are told apart by a hash of id and text, so others that share an id
    with one that goes stay, and of rows that repeat both one stays.
    """
    own = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col)))
    found = jaccard_components(own, "__row", text_col).filter("node IS NOT NULL").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__component"))
    found = materialize(found.groupBy("__row", "__component").agg(F.count("*").alias("__times")), "found")
    several = found.groupBy("__component").agg(F.sum("__times").alias("rows")).filter("rows > 1").select("__component")
    members = materialize(found.join(maybe_broadcast(several), "__component"), "members")
    named = own.select("__row", F.col(id_col).alias("__id")).join(maybe_broadcast(members), "__row")
    first = named.groupBy("__component").agg(F.min_by("__row", F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__first"))
    judged = materialize(members.join(maybe_broadcast(materialize(first, "first")), "__component"), "judged")
    kept = own.join(maybe_broadcast(judged.filter("__row != __first").select("__row")), "__row", "left_anti")
    repeats = judged.filter("__row = __first AND __times > 1").select("__row")
    if not repeats.isEmpty():
        repeats = maybe_broadcast(repeats)
        whole = F.xxhash64(F.to_json(F.struct(*docs.columns)))
        once = kept.join(repeats, "__row", "left_semi").groupBy("__row").agg(F.min_by(F.struct(*docs.columns), whole).alias("__one")).select("__one.*")
        kept = kept.join(repeats, "__row", "left_anti").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)


def op10_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)] END) AS sh FROM w)),
n AS (SELECT w.doc_id, count(sh) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n_shingles + ny.n_shingles - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT n.doc_id, n.n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n_shingles
"""
