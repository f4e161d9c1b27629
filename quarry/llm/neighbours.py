"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; its bucket in a table is
the nearest signed axis. With `hashes` above 1 a bucket is that of so many rotations together, the last of
which may look at its first `last` coordinates alone, so that large tables have buckets enough. A query
probes its `probes` nearest buckets in each of `tables` tables: those with the least sum of squared
distances to the nearest axis of each rotation. Each bucket is a grid of cells of at most about CELL vectors by CELL queries, so no task holds a bucket that a third
of all rows fall into, and every vector of a probed bucket is scored: there is no cap. Queries that find
fewer than k vectors so are scored against all, by the same grid. Scores are inner products of the
original vectors in double precision.

Vectors that are null, zero, of another length than `dim` (by default the most frequent one), or hold null
or non-finite components take no part, nor do rows without an id. Rows that repeat an id and a vector count once. Ties go to smaller ids. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

TABLES, PROBES, K = 10, 12, 20
CELL = 512
#: A row for each bucket is broadcast: so many at most, about 24 bytes each.
MOST_BUCKETS = 1 << 20


class CrossPolytope:
    def __init__(self, dim: int, tables: int, hashes: int = 1, last: int | None = None, seed: int = 3):
        self.dim, self.width, self.tables = dim, 1 << max(1, (dim - 1).bit_length()), tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * hashes, 3, self.width))
        #: Coordinates that each hash of a table looks at.
        self.coordinates = [self.width] * (hashes - 1) + [min(last or self.width, self.width)]
        self.buckets = prod(2 * c for c in self.coordinates)
        if tables * self.buckets > MOST_BUCKETS:
            raise ValueError(f"{tables} tables of {self.buckets} buckets are more than {MOST_BUCKETS}: take fewer hashes or a smaller last one")

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Tables x rows x probes: each row's nearest buckets."""
        y, found = self.rotations(x), []
        for t in range(self.tables):
            bucket, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for k, n in enumerate(self.coordinates):
                part = y[t * len(self.coordinates) + k][:, :n]
                near = np.concatenate((part, -part), axis=1)
                own = (near.max(axis=1, keepdims=True) - near) ** 2
                axis, own = least(own, np.broadcast_to(np.arange(2 * n), own.shape), probes)
                both = (cost[:, :, None] + own[:, None, :]).reshape(len(x), -1)
                bucket, cost = least(both, (bucket[:, :, None] * (2 * n) + axis[:, None, :]).reshape(len(x), -1), probes)
            found.append(bucket)
        return np.stack(found)

    def rotations(self, x: np.ndarray) -> np.ndarray:
        """Rotations x rows x width."""
        padded = np.zeros((len(x), self.width))
        padded[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for rounds in self.signs:
            y = padded
            for sign in rounds:
                y = hadamard(y * sign)
            out.append(y)
        return np.stack(out)


def least(cost: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the n entries that cost least, and their costs."""
    if cost.shape[1] > n:
        at = np.argpartition(cost, n - 1, axis=1)[:, :n]
        return np.take_along_axis(of, at, axis=1), np.take_along_axis(cost, at, axis=1)
    return of, cost


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, kept at its length."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    e = F.col("embedding")
    whole = e.isNotNull() & (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & whole & F.exists(e, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), e)


def hashed(vectors: DataFrame, hashing: CrossPolytope, probes: int) -> DataFrame:
    """vec_id, embedding, and a row for each table and each of the nearest `probes` buckets: table, bucket."""
    step = max(1, (1 << 22) // (len(hashing.signs) * hashing.width + probes * probes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                best = hashing.nearest(np.stack(part["embedding"]).astype(np.float64), probes)
                t, n, p = best.shape
                yield pd.DataFrame({
                    "vec_id": np.tile(np.repeat(part["vec_id"].to_numpy(), p), t),
                    "embedding": [part["embedding"].iat[i] for i in np.tile(np.repeat(np.arange(n), p), t)],
                    "table": np.repeat(np.arange(t, dtype=np.int32), n * p), "bucket": best.reshape(-1),
                })

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInPandas(run, f"vec_id long, embedding {kind}, table int, bucket long")


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k best vectors but its own: a matrix product finds the candidates, and sums in one fixed order score them, so equal vectors tie."""
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
    for q in range(len(queries)):
        hit = np.flatnonzero((rough[q] >= least[q] - 1e-9 * (1 + abs(least[q]) if np.isfinite(least[q]) else 1)) & np.isfinite(rough[q]))
        score = (vectors[hit] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[hit], -score))[:k]
        yield np.full(len(order), query_ids[q]), ids[hit][order], score[order]


def nearest(vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, probes: int = PROBES, dim: int | None = None, hashes: int = 1, last: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector where is_query holds."""
    schema = "query_id long, vec_id long, score double"
    if dim is None:
        lengths = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("length")).count()
        most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
        dim = most["length"] if most else 1
    hashing = CrossPolytope(dim, tables, hashes, last)
    good = usable(vectors, dim)
    index = checkpointed(hashed(good, hashing, 1))
    queries = checkpointed(hashed(good.filter(is_query), hashing, min(probes, hashing.buckets)))

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("table", "bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))

    key = ["table", "bucket", "row", "column"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "vec_id", "score"])
        matrix = lambda t: np.asarray(t["embedding"].combine_chunks().flatten()).astype(np.float64).reshape(t.num_rows, dim)
        found = list(best_of(left["vec_id"].to_numpy(), matrix(left), right["vec_id"].to_numpy(), matrix(right), k))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    def ranked(index: DataFrame, queries: DataFrame) -> DataFrame:
        # A row a bucket: MOST_BUCKETS at most, whatever the input.
        grid = F.broadcast(cells(index, "rows").join(cells(queries, "columns"), ["table", "bucket"]))
        mine = F.xxhash64("vec_id", F.lit("cell"))
        index = index.join(grid, ["table", "bucket"]).withColumn("row", F.pmod(mine, F.col("rows")).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
        queries = queries.join(grid, ["table", "bucket"]).withColumn("column", F.pmod(mine, F.col("columns")).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        pick = lambda df: df.select(*key, "vec_id", "embedding")
        hits = pick(queries).groupBy(*key).cogroup(pick(index).groupBy(*key)).applyInArrow(score, schema)
        # Several tables find the same pair: equal pairs share a dense rank.
        by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.dense_rank().over(by_query)).filter(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")

    probed = checkpointed(ranked(index, queries))
    counts = probed.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("rank").alias("found"))
    short = checkpointed(good.filter(is_query).join(counts, "vec_id", "left").filter(F.coalesce("found", F.lit(0)) < k).select("vec_id", "embedding"))
    if short.isEmpty():
        return probed
    fresh = lambda df: df.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"), F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"))
    rest = ranked(fresh(good), fresh(short))
    return probed.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
