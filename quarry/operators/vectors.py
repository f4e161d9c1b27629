"""Vector table operations: exact top-k, add, remove, membership, and embedding by a model's client."""

from __future__ import annotations

import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def scored(vectors: DataFrame, query: Sequence[float]) -> Column:
    """The inner product with a query in double precision; a task fails on a vector of another length."""
    fits = F.when(F.size("embedding") == len(query), F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {len(query)} components expected")))
    return S.dot(fits, F.array(*[F.lit(float(x)) for x in query]))


def nearest(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """chunk_id, score: the k largest inner products, ties to smaller ids. A TakeOrdered, no full sort."""
    if k < 0:
        raise ValueError("k must not be negative")
    return vectors.select("chunk_id", scored(vectors, query).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def nearest_of_each(vectors: DataFrame, queries: Sequence[Sequence[float]], k: int) -> DataFrame:
    """query (its number), chunk_id, score: `nearest` for several queries in one pass; each task keeps its own k best."""
    if len(queries) == 1:
        return nearest(vectors, queries[0], k).select(F.lit(0).alias("query"), "chunk_id", "score")
    all_ = F.array(*[F.struct(F.lit(i).alias("query"), scored(vectors, q).alias("score")) for i, q in enumerate(queries)])
    rows = vectors.select("chunk_id", F.explode(all_).alias("hit")).select("hit.query", "chunk_id", "hit.score")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("__rank", best).filter(F.col("__rank") <= k).drop("__rank")


def added(vectors: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """vectors and new; a task fails on a vector of another length or an id that is there already."""
    right = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {dim} components expected"))))
    many = F.count("*").over(W.partitionBy("chunk_id")) > 1
    twice = F.when(many, F.raise_error(F.concat(F.lit("duplicate id "), F.col("chunk_id"))).cast("array<float>")).otherwise(F.col("embedding"))
    return vectors.unionByName(right.select("chunk_id", "embedding")).withColumn("embedding", twice)


def removed(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def contained(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    return ids.join(vectors.select("chunk_id"), "chunk_id", "left_semi")


def shared_ids(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of new that are there already."""
    return new.select("chunk_id").intersect(vectors.select("chunk_id"))


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active chunks without a vector: what a rebuild embeds."""
    return chunks.filter("active").join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


class Embedder(ABC):
    """Turns texts into vectors: chunks as a DataFrame, a query's text on the driver."""

    @abstractmethod
    def chunks(self, chunks: DataFrame) -> DataFrame:
        """chunk_id, embedding of rows of id and text."""

    @abstractmethod
    def query(self, text: str) -> Sequence[float]: ...


def embedded(chunks: DataFrame, dim: int = 32) -> DataFrame:
    """chunk_id, embedding by the deterministic hash embedder; a model's `ClientEmbedder` takes its place in production."""
    return chunks.select(F.col("id").alias("chunk_id"), S.hash_embedding(F.col("text"), dim).alias("embedding"))


class ClientError(Exception):
    """What a model client raises; status is that of HTTP, or None where the server wasn't reached."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def unreachable(e: Exception) -> bool:
    """Whether a task failed in a client or on the way to its server, by the last error of its trace."""
    said = [line for line in str(e).splitlines() if re.match(r"\s*[\w.]+(Error|Exception)\b", line)]
    return any(re.match(r"\s*[\w.]*(ClientError|ConnectionError|Connection\w+Error|TimeoutError|OSError|URLError)\b", line) for line in said)


@dataclass(frozen=True)
class ClientEmbedder(Embedder):
    """Embeds through a client, a picklable `client(model, texts) -> vectors`, in batches on the executors.

    Texts are cut to max_chars. A batch is tried up to `attempts` times on status 429 and 5xx and where the
    server isn't reached, with waits of 1 s, 2 s and so on; on 404 the next model takes over, in this task
    from then on. A vector of another length than dim fails the task.
    """

    client: Callable[[str, list[str]], list[Sequence[float]]]
    models: tuple[str, ...]
    dim: int = 1024
    batch_size: int = 32
    max_chars: int = 6000
    attempts: int = 3
    wait: Callable[[float], None] = time.sleep

    def batch(self, texts: list[str], first: int = 0) -> tuple[list[list[float]], int]:
        """Vectors, and the number of the model that gave them."""
        cut = [(t or "")[: self.max_chars] if self.max_chars > 0 else t or "" for t in texts]
        for k in range(first, len(self.models)):
            for attempt in range(1, self.attempts + 1):
                try:
                    got = [list(map(float, v)) for v in self.client(self.models[k], cut)]
                except ClientError as e:
                    if e.status == 404 and k + 1 < len(self.models):
                        break
                    again = e.status is None or e.status == 429 or 500 <= e.status <= 599
                    if not again or attempt == self.attempts:
                        raise
                    self.wait(2.0 ** (attempt - 1))
                    continue
                if len(got) != len(texts) or any(len(v) != self.dim for v in got):
                    raise ValueError(f"{len(texts)} vectors of {self.dim} components expected")
                return got, k
        raise ValueError("no model")

    def chunks(self, chunks: DataFrame) -> DataFrame:
        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = 0
            for texts in parts:
                out: list[list[float]] = []
                for at in range(0, len(texts), self.batch_size):
                    got, model = self.batch(texts.iloc[at : at + self.batch_size].tolist(), model)
                    out += got
                yield pd.Series(out, dtype=object)

        return chunks.select(F.col("id").alias("chunk_id"), embed("text").alias("embedding"))

    def query(self, text: str) -> Sequence[float]:
        try:
            return self.batch([text])[0][0]
        except ClientError as e:
            raise OSError(str(e)) from e
