"""Search of a stated query set against all points: dense, sparse, fused by reciprocal ranks, in tiers of scopes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tolqyn.runtime import new_path, staged

BLOCK = 2048  # queries that travel to the tasks at once


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, and start and length of each row."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    starts = np.cumsum(lengths) - lengths
    return flat, starts, lengths


class Best:
    """The k best rows of every query seen so far, a key counted once with its best score, ties by key."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, key, score))
        self.held += len(query)
        if self.held > 500_000:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        query, key, score = (np.concatenate(x) for x in zip(*self.parts))
        names, place = np.unique(key, return_inverse=True)
        order = np.lexsort((-score, place, query))  # copies of a key side by side, the best first
        order = order[np.r_[True, (np.diff(query[order]) != 0) | (np.diff(place[order]) != 0)]] if len(order) else order
        order = order[np.lexsort((place[order], -score[order], query[order]))]
        query, place, score = query[order], place[order], score[order]
        first = np.flatnonzero(np.r_[True, np.diff(query) != 0]) if len(query) else np.zeros(0, int)
        kept = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < self.k
        return query[kept], names[place[kept]], score[kept]


def _rounded(score: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL rounds."""
    return np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6


def _top(score: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what may be among the k largest of each row, above `least`."""
    at = max(0, score.shape[1] - k)
    cut = np.partition(score, at, axis=1)[:, at]
    return np.nonzero((score >= cut[:, None]) & (score > least))


def _in_blocks(rows: DataFrame, asked: DataFrame, pack, score, k: int, query: str, key: str) -> DataFrame:
    """Ranks rows for the queries of `asked` (column q) in blocks of about BLOCK, one after the other, so that no more than one block is with
    the driver and the tasks. pack: pandas block -> what is sent; score: (sent, batches) -> batches of (q, key, score)."""
    spark = rows.sparkSession
    asked = staged(asked, "queries")
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    schema = f"q {kinds['q']}, key {kinds['key']}, score double"
    path = new_path(spark, "ranked")
    blocks = 1 + asked.count() // BLOCK
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(pack(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()))
        rows.mapInArrow(lambda batches, sent=sent: score(sent.value, batches), schema).write.mode("append").parquet(path)
        sent.destroy()
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    out = spark.read.schema(schema).parquet(path).groupBy("q", "key").agg(F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("key").alias(key), "score", "rank")


def dense_topk(
    points: DataFrame, queries: DataFrame, k: int, key: str = "point_id", vector: str = "dense", query: str = "query_id", scope: str | None = None,
) -> DataFrame:
    """(query, key, score, rank): the k rows of highest cosine, ties by key; with `scope` among the rows whose scope column equals the
    query's (scopes filter before ranking; a null scope matches nothing).

    queries: (query, vector), a stated set. Each task keeps k rows per query, so what is shuffled grows with the tasks, not
    with the rows read. Vectors never leave their task, and a repeated key counts once."""
    tag = F.col(scope).cast("string") if scope else F.lit("")

    def fit(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.where(F.size(vector) > 0).select(F.col(name).alias(to), F.col(vector).cast("array<double>").alias("v"), tag.alias("scope")).where("scope is not null")

    def pack(block):
        by_dim = {}
        for d, own in block.groupby(block.v.map(len)):
            m = np.stack([np.asarray(v, "f8") for v in own.v])
            norm = np.linalg.norm(m, axis=1)
            by_dim[int(d)] = (own.q.to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0][:, None], own.scope.to_numpy()[norm > 0].astype(str))
        return by_dim

    def score(by_dim, batches):
        best = {d: Best(k) for d in by_dim}
        for batch in batches:
            flat, starts, lengths = _matrix(batch.column("v"))
            names = batch.column("key").to_numpy(zero_copy_only=False)
            scopes = batch.column("scope").to_numpy(zero_copy_only=False).astype(str)
            once = np.zeros(len(names), bool)
            once[np.unique(names, return_index=True)[1]] = True
            for d, (q, m, qs) in by_dim.items():
                own = np.flatnonzero((lengths == d) & once)
                x = flat[(starts[own][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                norm = np.linalg.norm(x, axis=1)
                own, x = own[norm > 0], x[norm > 0] / norm[norm > 0][:, None]
                for tag in np.unique(scopes[own]):
                    a, b = np.flatnonzero(qs == tag), np.flatnonzero(scopes[own] == tag)
                    if len(a):
                        s = _rounded(m[a] @ x[b].T)
                        i, j = _top(s, k, -2.0)
                        best[d].add(a[i], names[own[b[j]]], s[i, j])
        for d, found in best.items():
            i, name, s = found.result()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(by_dim[d][0][i]), pa.array(name), pa.array(s)], ["q", "key", "score"])

    return _in_blocks(fit(points, key, "key"), fit(queries, query, "q"), pack, score, k, query, key)


def sparse_topk(points: DataFrame, queries: DataFrame, k: int, key: str = "point_id", query: str = "query_id", indices: str = "sparse_indices", values: str = "sparse_values") -> DataFrame:
    """(query, key, score, rank) by the sum of products over shared indices.

    The terms of a block of queries are with the tasks; each adds up its rows and keeps k per query. No pair of query and row
    is shuffled before that, so a term that most rows share costs no more than the rows that hold it."""

    def fit(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.where(F.size(indices) > 0).select(F.col(name).alias(to), F.col(indices).cast("array<bigint>").alias("i"), F.col(values).cast("array<double>").alias("w"))

    def pack(block):
        q = block.q.to_numpy()
        term = np.concatenate([np.asarray(x, "i8") for x in block.i]) if len(q) else np.zeros(0, "i8")
        weight = np.concatenate([np.asarray(x, "f8") for x in block.w]) if len(q) else np.zeros(0)
        owner = np.repeat(np.arange(len(q)), block.i.map(len).to_numpy(int)) if len(q) else np.zeros(0, int)
        order = np.argsort(term, kind="stable")
        terms, first = np.unique(term[order], return_index=True)
        return q, terms, np.r_[first, len(term)], owner[order], weight[order]

    def score(sent, batches):
        q, terms, first, owner, weight = sent
        best = Best(k)
        for whole in batches:
            for lo in range(0, whole.num_rows if len(q) else 0, 1000):
                batch = whole.slice(lo, 1000)
                flat, starts, lengths = _matrix(batch.column("i"))
                values_, n = batch.column("w").flatten().to_numpy(zero_copy_only=False), batch.num_rows
                row, term = np.repeat(np.arange(n), lengths), flat.astype("i8")
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                hit = terms[at] == term
                row, at, w = row[hit], at[hit], values_[hit]
                size = first[at + 1] - first[at]  # queries that hold the term
                entry = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                cell = owner[entry] * n + np.repeat(row, size)
                total = np.bincount(cell, weights=weight[entry] * np.repeat(w, size), minlength=len(q) * n).reshape(len(q), n)
                met = np.bincount(cell, minlength=len(q) * n).reshape(len(q), n) > 0
                s = np.where(met, _rounded(total), -np.inf)
                i, j = _top(s, k, -np.inf)
                best.add(i, batch.column("key").to_numpy(zero_copy_only=False)[j], s[i, j])
        i, name, s = best.result()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(name), pa.array(s)], ["q", "key", "score"])

    return _in_blocks(fit(points, key, "key"), fit(queries, query, "q"), pack, score, k, query, key)


def rrf(ranked: list[DataFrame], k: int, top: int, key: str = "point_id", query: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists that hold a row."""
    both = ranked[0].select(query, key, "rank")
    for r in ranked[1:]:
        both = both.unionByName(r.select(query, key, "rank"))
    fused = both.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(query, key, "score", "rank")


def tiered(tiers: list[DataFrame], top: int, key: str = "point_id", query: str = "query_id") -> DataFrame:
    """Lists of scopes from narrow to broad: a row counts in its first tier, tiers follow each other, and the list is cut at top. A
    tier that is not needed to fill the list gives nothing to it."""
    all_ = None
    for n, t in enumerate(tiers):
        t = t.select(query, key, "score", "rank", F.lit(n).alias("tier"))
        all_ = t if all_ is None else all_.unionByName(t)
    first = Window.partitionBy(query, key).orderBy("tier", "rank")
    all_ = all_.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    w = Window.partitionBy(query).orderBy("tier", "rank", key)
    return all_.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(query, key, "score", "tier", "place")
