"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are one node.  Nodes are dealt into shards of about SHARD nodes
by a hash.  In each shard a graph is built: greedy searches from the node
nearest to the middle propose neighbours for each node; relaxed distance
pruning drops a proposal that a nearer neighbour already covers (by the factor
RELAX), so that edges stay diverse; edges are added both ways and pruned again
where a node has too many.  Queries go in blocks of bounded size (BLOCK_BYTES)
to every shard of their dimension; shards stay where they are written.  A beam
search walks the graph, what it has met is ranked by the exact cosine in double
precision, and a task sends on the nearest that its shards gave each query.

Vectors are scaled by the power of two next to their largest component, which
changes no digit, so squares neither overflow nor vanish.

Every row is indexed.  Vectors that are null, empty, zero, or hold null or
non-finite components take no part.  Vectors of different length are never
compared.  Of rows with equal vectors the TOP + 1 smallest ids are kept with
the node, which is all that a query (whose own row is left out) can return.
Rows that repeat both id and vector count once; rows with the query's id are
its own; rows with a null id take no part.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import maybe_broadcast, table
from strandline.session import batch_rows, materialize

SHARD = 1024
#: Queries are sent to the shards in blocks of so many bytes at most.
BLOCK_BYTES = 8 << 20
DEGREE, BEAM, SEARCH_BEAM, RELAX, TOP = 28, 48, 96, 1.2, 5
_WIDE = 8  # nodes that a beam search expands at once


def beam_search(unit: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and squared distances of the `beam` nearest nodes that a greedy walk meets (id -1: none)."""
    n, q = len(unit), len(queries)
    ids = np.full((q, beam), -1, np.int32)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    met = np.zeros((q, n + 1), bool)  # the last column stands for "no node"
    ids[:, 0], met[:, entry], met[:, n] = entry, True, True
    far[:, 0] = 2 - 2 * (queries @ unit[entry])
    live = np.arange(q)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
        pick = np.argpartition(waiting, _WIDE - 1, axis=1)[:, :_WIDE] if beam > _WIDE else np.argsort(waiting, axis=1)[:, :_WIDE]
        open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = open_.any(axis=1)
        live, pick, open_ = live[some], pick[some], open_[some]
        if not len(live):
            break
        flags = done[live]
        np.put_along_axis(flags, pick, np.take_along_axis(flags, pick, 1) | open_, 1)
        done[live] = flags
        heads = np.where(open_, np.take_along_axis(ids[live], pick, 1), n)
        new = edges[heads].reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new = np.where(met[live[:, None], new], n, new)
        met[live[:, None], new] = True
        there = unit[np.minimum(new, n - 1)]
        d = np.where(new == n, np.inf, 2 - 2 * np.einsum("qrd,qd->qr", there, queries[live], optimize=True)).astype(np.float32)
        all_d = np.concatenate((far[live], d), axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        far[live] = np.take_along_axis(all_d, keep, 1)
        all_i = np.concatenate((ids[live], np.where(new == n, -1, new)), axis=1)
        ids[live] = np.take_along_axis(all_i, keep, 1)
        all_f = np.concatenate((done[live], np.zeros(new.shape, bool)), axis=1)
        done[live] = np.take_along_axis(all_f, keep, 1)
    return ids, far


def robust_prune(unit: np.ndarray, node: int, proposals: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Nearest proposals first; each kept one drops those that it is nearer to, by the factor relax, than the node is."""
    proposals = np.unique(proposals)
    proposals = proposals[(proposals >= 0) & (proposals != node)]
    if not len(proposals):
        return proposals
    d = 2 - 2 * (unit[proposals] @ unit[node])
    order = np.argsort(d, kind="stable")[: 4 * degree]
    proposals, d = proposals[order], d[order]
    between = 2 - 2 * (unit[proposals] @ unit[proposals].T)
    covered = relax * relax * between <= d[None, :]  # [i, j]: i covers j
    alive, kept = np.ones(len(d), bool), []
    for i in range(len(d)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= ~covered[i]
    return proposals[kept]


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (n + 1 rows, absent ones n) and the entry node."""
    n = len(unit)
    entry = int(np.argmax(unit @ unit.mean(axis=0)))
    edges = np.full((n + 1, degree), n, np.int32)
    rng = np.random.default_rng(seed)
    if n > 1:
        start = rng.integers(0, n, (n, min(degree // 2, n)))
        edges[:n, : start.shape[1]] = np.where(start == np.arange(n)[:, None], n, start)
        order = rng.permutation(n)
        size = 512
        for factor in (1.0, relax):
            for at in range(0, n, size):
                nodes = order[at : at + size]
                met, _ = beam_search(unit, edges, entry, unit[nodes], beam)
                back: dict[int, list[int]] = {}
                for node, proposals in zip(nodes.tolist(), met):
                    old = edges[node]
                    kept = robust_prune(unit, node, np.concatenate((proposals, old[old < n])), factor, degree)
                    edges[node] = n
                    edges[node, : len(kept)] = kept
                    for k in kept.tolist():
                        back.setdefault(k, []).append(node)
                for k, sources in back.items():
                    old = edges[k]
                    old = old[old < n]
                    new = np.union1d(old, np.array(sources, np.int32))
                    if len(new) > degree:
                        new = robust_prune(unit, k, new, factor, degree)
                    edges[k] = n
                    edges[k, : len(new)] = new
    return edges, entry


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest component is between a half and one."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=0.0))[1][:, None])


def _unit(raw: np.ndarray) -> np.ndarray:
    """float32 rows of length one; of rows as _scaled() gives them."""
    return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).astype(np.float32)


INDEX = "dim int, shard int, entry int, edges binary, raw binary, ids array<array<long>>"


def _index_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    raw = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    edges, entry = build_graph(_unit(_scaled(raw)))
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "entry": [entry], "edges": [edges.tobytes()], "raw": [raw.tobytes()], "ids": [[list(map(int, x)) for x in rows["ids"]]]})


FOUND = "query_id long, query int, vec_id long, score double"


def _search_shards(block, top: int):
    """Search each shard of a task for the queries of a block, and give the nearest `top` of all shards of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, dim = block.value
        q = _scaled(np.frombuffer(vectors, np.float64).reshape(-1, dim))
        unit, length = _unit(q), np.sqrt((q * q).sum(axis=1))
        best: list[list] = [[] for _ in names]
        for batch in batches:
            for row in batch.to_pylist():
                raw = _scaled(np.frombuffer(row["raw"], np.float64).reshape(-1, dim))
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(raw) + 1, -1)
                graph, norm, sets = _unit(raw), np.sqrt((raw * raw).sum(axis=1)), row["ids"]
                for at in range(0, len(q), 256):
                    ids, _ = beam_search(graph, edges, row["entry"], unit[at : at + 256], min(SEARCH_BEAM, max(len(raw), 1)))
                    for i, nodes in enumerate(ids, at):
                        nodes = nodes[nodes >= 0]
                        scores = raw[nodes] @ q[i] / (norm[nodes] * length[i])
                        near = np.argsort(-scores, kind="stable")
                        cut = scores[near[min(top, len(near) - 1)]] if len(near) else 0.0  # the query's own node may be among them
                        hits = [(-s, v) for s, node in zip(scores.tolist(), nodes.tolist()) if s >= cut for v in sets[node] if v != names[i]]
                        best[i] = sorted([*best[i], *hits])[:top]
        rows = [(names[i], i, v, -s) for i, hits in enumerate(best) for s, v in hits]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def valid_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = F.col(id_col).isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), used.alias("_used")).filter("_used").drop("_used")


def build_index(rows: DataFrame, shard: int = SHARD, keep: int = TOP + 1) -> DataFrame:
    """One row a shard, written to the shared folder: the graph, the vectors, and the ids of each node."""
    few = Window.partitionBy("vector").orderBy("vec_id")
    nodes = rows.dropDuplicates(["vec_id", "vector"]).withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= keep)
    nodes = nodes.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("dim", F.size("vector")), "nodes")
    sizes = materialize(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "shards")
    dealt = nodes.join(maybe_broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(max(1, min(sizes.agg(F.sum("shards")).first()[0] or 1, tasks)), "dim", "shard")  # a shard's graph takes long, so few share a task
    return materialize(dealt.select("dim", "shard", "vector", "ids").groupBy("dim", "shard").applyInPandas(_index_shard, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, block_bytes: int = BLOCK_BYTES, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id, vector): the nearest found in all shards of its dimension."""
    spark = index.sparkSession
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim")).dropDuplicates(["query_id", "vector"])
    asked = materialize(asked, "queries")
    found = None
    for dim, n in sorted(map(tuple, asked.groupBy("dim").agg(F.count("*")).collect())):  # a row a dimension
        blocks = max(1, math.ceil(n * dim * 8 / block_bytes))
        own = asked.filter(F.col("dim") == dim).withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int"))
        for b in range(blocks):
            part = own.filter(F.col("block") == b).orderBy("query_id", "vector").select("query_id", "vector").toArrow()  # a block's bytes at most, or near
            names = part["query_id"].to_pylist()
            if not names:
                continue
            vectors = np.asarray(part["vector"].combine_chunks().flatten(), np.float64)
            block = spark.sparkContext.broadcast((names, vectors.tobytes(), dim))
            hits = index.filter(F.col("dim") == dim).select("entry", "edges", "raw", "ids").mapInArrow(_search_shards(block, top), FOUND)
            with batch_rows(spark, 8):  # a shard a row
                hits = materialize(hits.withColumn("block", F.lit(b)).withColumn("dim", F.lit(dim)), "found")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("dim", "block", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir):
    rows = valid_vectors(table(spark, sf_dir, "embeddings"))
    return search(build_index(rows), rows.filter(F.col("vec_id") % 50 == 0))
