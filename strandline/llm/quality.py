"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence comes from logistic models over the shape of its
text and the presence of telling words (hashed), fitted on a bounded sample of
labelled rows (MAX_LABELLED ids, by hash of the id; of rows that share an id
the one with the least text hash).  All documents are scored, for bad quality
and for toxic content.  For either, grouped sums of the scores then give each
host a posterior rate, shrunk toward the rate of the whole corpus, and each
path of a host a rate shrunk toward its host's; how strongly follows from how
much hosts, and paths, differ (moments).  A document's final odds are its
evidence times the odds of its path without the document itself, relative to
the corpus.  Sparse sites thus stay near the corpus rate, and large ones speak
for themselves.  The test tables name no host or path of a document; there
`source` is the host and `lang` the path.

Rejected are documents with a final probability of bad quality, or of toxic
content, above THRESHOLD.

Defined results: a null text counts as empty and is scored by its shape; null
hosts and paths are groups of their own; without labels of both kinds a model
says the corpus rate and rejects nothing; rows with the same id are scored each
for itself (labels apply to all of them); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import words
from strandline.llm.common import maybe_broadcast, table
from strandline.llm.mixing import key_hash
from strandline.session import batch_rows, materialize, release

#: Labelled rows that the models are fitted on, at most; texts that go to a Python worker at once.
MAX_LABELLED, _ROWS = 20_000, 1000
#: Words are hashed to 2**HASH_BITS; of these at most TELLING are in a model.
HASH_BITS, TELLING = 18, 256
#: Rows of the sample that a model's fit works on at once.
PART = 2048
THRESHOLD = 0.5
_CLASSES = (b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b".,", b"|#$%&*{}<>")
_MEMBER = np.zeros((len(_CLASSES), 256), np.float32)
for _i, _c in enumerate(_CLASSES):
    _MEMBER[_i, list(_c)] = 1
SHAPE = 2 * len(_CLASSES) + 8


def describe(w: words.Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shape of each text (SHAPE numbers) and the hash buckets of its distinct words, without punctuation."""
    n, out = len(w.count), np.zeros((len(w.count), SHAPE), np.float64)
    sizes = np.diff(w.bounds).astype(np.float64)
    for i in range(len(_CLASSES)):
        sums = np.concatenate(([0.0], np.cumsum(_MEMBER[i][w.data], dtype=np.float64)))
        share = (sums[w.bounds[1:]] - sums[w.bounds[:-1]]) / np.maximum(sizes, 1)
        out[:, 2 * i], out[:, 2 * i + 1] = share, np.sqrt(share)
    k, count = 2 * len(_CLASSES), np.maximum(w.count, 1)
    length = (w.end - w.start).astype(np.float64)
    tail = _MEMBER[0][w.data[w.end - 1]] if len(w.end) else length
    for column, value in ((k, length), (k + 1, length <= 2), (k + 2, length > 14), (k + 3, tail)):
        out[:, column] = np.bincount(w.doc, weights=value, minlength=n) / count
    out[:, k + 4] = np.log1p(w.count)
    buckets, bare = [], words.Words(w.data, w.bounds, True, words.PLAIN)
    for d in range(n):
        value, times = np.unique(w.hash[w.first[d] : w.first[d + 1]], return_counts=True)
        buckets.append(np.unique(bare.hash[bare.first[d] : bare.first[d + 1]] >> np.uint64(64 - HASH_BITS)).astype(np.int32))
        if len(value):
            total = times.sum()
            out[d, k + 5 : k + 8] = len(value) / total, times.max() / total, math.sqrt(times.max() / total)
    return out, buckets


class Model:
    """A logistic model: means and scales of the shape, telling buckets (sorted), coefficients."""

    def __init__(self, rate: float, mean=None, scale=None, telling=None, weights=None) -> None:
        self.rate, self.mean, self.scale, self.telling, self.weights = rate, mean, scale, telling, weights

    def _hits(self, buckets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(buckets), len(self.telling)), bool)
        if len(self.telling):
            for row, b in zip(out, buckets):
                at = np.minimum(np.searchsorted(self.telling, b), len(self.telling) - 1)
                row[at[self.telling[at] == b]] = True
        return out

    def _matrix(self, shape: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(shape), 1)), np.clip((shape - self.mean) / self.scale, -8, 8), hits), axis=1)

    def logits(self, shape: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(shape), math.log(self.rate / (1 - self.rate)))
        return self._matrix(shape, self._hits(buckets)) @ self.weights

    @classmethod
    def fit(cls, shape: np.ndarray, buckets: list[np.ndarray], label: np.ndarray, ridge: float = 0.3) -> Model:
        """Telling words by their likelihood ratio, then a ridge-penalised Newton fit."""
        good, bad = int((label == 0).sum()), int((label == 1).sum())
        if not good or not bad:
            return cls(0.01)
        size = 1 << HASH_BITS
        a, b = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for part in range(0, len(buckets), PART):  # in parts, here and below, so that nothing as large as the whole sample is made again
            for into, kind in ((a, label[part : part + PART] == 1), (b, label[part : part + PART] == 0)):
                if kind.any():
                    into += np.bincount(np.concatenate([x for x, y in zip(buckets[part : part + PART], kind) if y]), minlength=size)
        both, all_ = (a + b) / (good + bad), good + bad
        term = lambda seen, wanted: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(wanted, 1e-12)), 0.0)
        g = 2 * (term(a, bad * both) + term(b, good * both) + term(bad - a, bad * (1 - both)) + term(good - b, good * (1 - both)))
        found = np.flatnonzero((g >= 24) & (a + b >= 8) & (a + b < all_))
        telling = np.sort(found[np.argsort(-g[found], kind="stable")][:TELLING]).astype(np.int32)
        model = cls(bad / (good + bad), shape.mean(axis=0), shape.std(axis=0) + 1e-6, telling, None)
        hits, y = model._hits(buckets), label.astype(np.float64)
        wide = 1 + SHAPE + len(telling)
        w, penalty = np.zeros(wide), np.full(wide, ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            gram, slope = np.diag(penalty), penalty * w
            for part in range(0, len(y), PART):
                some = model._matrix(shape[part : part + PART], hits[part : part + PART])
                p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
                gram += (some * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ some
                slope += some.T @ (p - y[part : part + PART])
            step = np.linalg.solve(gram, slope)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        model.weights = w
        return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, w in words.slices(batch.column(2), lower=True):
            shape, buckets = describe(w)
            names = [batch.column(i).slice(first, len(shape)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(shape), pa.list_(pa.float64())), pa.array(buckets, pa.list_(pa.int32()))], names=["quality", "toxic", "shape", "buckets"])


def fit_models(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", most: int = MAX_LABELLED) -> tuple[Model, Model]:
    """Models of bad quality (label quality 0) and of toxic content (label toxic 1), from at most `most` labelled rows."""
    sample = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    sample = sample.groupBy("_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(key_hash("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    with batch_rows(docs.sparkSession, _ROWS):
        got = rows.select("quality", "toxic", "text").mapInArrow(words.frugal(_features), "quality int, toxic int, shape array<double>, buckets array<int>").toArrow()
    if not got.num_rows:
        return Model(0.01), Model(0.01)
    shape = np.asarray(got["shape"].combine_chunks().flatten()).reshape(got.num_rows, SHAPE)
    buckets = [np.asarray(b.values) for b in got["buckets"]]
    models = []
    for name, hit in (("quality", 0), ("toxic", 1)):
        value = got[name].to_pylist()
        at = [i for i, v in enumerate(value) if v is not None]
        models.append(Model.fit(shape[at], [buckets[i] for i in at], np.array([int(value[i] == hit) for i in at])) if at else Model(0.01))
    del got, shape, buckets
    words.give_back()
    release(docs.sparkSession)
    return tuple(models)


SCORED = "doc_id long, tag long, host string, path string, bad double, ill double"
#: What is judged: the column of its evidence (log odds), and the names of its final probability and rates.
KINDS = (("bad", "bad", ""), ("ill", "toxic", "toxic_"))


def _score(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, w in words.slices(batch.column(4), lower=True):
                shape, buckets = describe(w)
                odds = [pa.array(np.clip(m.logits(shape, buckets), -30, 30)) for m in models.value]
                columns = [batch.column(i).slice(first, len(shape)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, *odds], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, kind: str, center: str) -> float:
    """Pseudo-count of a prior, from the spread of group rates (columns n, s_kind) round their centers beyond chance."""
    rate = F.col(f"s_{kind}") / F.col("n")
    chance = F.col(center) * (1 - F.col(center))
    row = groups.agg(F.sum(F.col("n") * (rate - F.col(center)) ** 2), F.sum(chance), F.sum(F.col("n") * chance), F.count("*"), F.sum("n")).first()
    spread, noise, scaled, k, n = (float(x or 0) for x in row)
    between = (spread - noise) / n if n and k > 1 else 0.0
    return min(1e6, max(1.0, scaled / n / between - 1)) if between > 1e-12 else 1e6


def posteriors(scored: DataFrame) -> DataFrame:
    """`scored` (host, path, and log odds under each of KINDS) with the shrunk rates of host and path, and the final probability, of each kind."""
    sums = [F.sum(_expit(F.col(k))).alias(f"s_{k}") for k, *_ in KINDS]
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k, *_ in KINDS])
    total = hosts.agg(F.sum("n"), *[F.sum(f"s_{k}") for k, *_ in KINDS]).first()
    centers = {k: min(1 - 1e-6, max(1e-6, (total[i] or 0.0) / total[0])) if total[0] else 0.5 for i, (k, *_) in enumerate(KINDS, 1)}
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), *[F.col(f"s_{k}").alias(f"host_s_{k}") for k, *_ in KINDS], *[F.lit(c).alias(f"center_{k}") for k, c in centers.items()])
    hosts = materialize(hosts, "hosts")
    by_host = hosts.select(F.col("host_n").alias("n"), *[F.col(f"host_s_{k}").alias(f"s_{k}") for k, *_ in KINDS], *[f"center_{k}" for k in centers])
    strong = {k: _strength(by_host, k, f"center_{k}") for k in centers}
    for k, c in centers.items():
        hosts = hosts.withColumn(f"host_rate_{k}", (F.col(f"host_s_{k}") + strong[k] * c) / (F.col("host_n") + strong[k]))
    sites = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    firm = {k: _strength(sites, k, f"host_rate_{k}") for k in centers}
    own = [c for c in sites.columns if c not in ("host", "path")]
    sites = maybe_broadcast(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), *own))
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    for k, name, prefix in KINDS:
        p, c = _expit(F.col(k)), F.lit(centers[k])
        others = (F.col(f"host_s_{k}") - p + strong[k] * c) / (F.col("host_n") - 1 + strong[k])
        rate = (F.col(f"s_{k}") - p + firm[k] * others) / (F.col("n") - 1 + firm[k])
        out = out.withColumns({f"{prefix}host_rate": F.col(f"host_rate_{k}"), f"{prefix}path_rate": rate, f"_final_{name}": _expit(F.col(k) + _logit(rate) - _logit(c))})
    rates = [f"{prefix}{x}_rate" for _, _, prefix in KINDS for x in ("host", "path")]
    return out.select(*[c for c in scored.columns if c not in centers], *[F.col(k).alias(f"{prefix}evidence") for k, _, prefix in KINDS], *rates, *[F.col(f"_final_{name}").alias(name) for _, name, _ in KINDS])


def score_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, tag, host, path, evidence (log odds) and shrunk rates, bad and toxic (final probabilities), keep."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast(fit_models(docs, labels, id_col, text_col))
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    with batch_rows(spark, _ROWS):
        scored = materialize(rows.mapInArrow(words.frugal(_score(models)), SCORED), "scored")
    return posteriors(scored).withColumn("keep", (F.col("bad") <= THRESHOLD) & (F.col("toxic") <= THRESHOLD))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of `docs`, all columns, without those that the classifier rejects."""
    gone = score_documents(docs, labels, id_col, text_col).filter("NOT keep").select(F.col("doc_id").alias("__gone_id"), F.col("tag").alias("__gone_tag")).distinct()
    gone = maybe_broadcast(materialize(gone, "rejected"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text_col) == F.col("__gone_tag")), "left_anti")


def op9_quality(spark, sf_dir):
    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "bad", "toxic_evidence", "toxic_host_rate", "toxic_path_rate", "toxic", "keep")
