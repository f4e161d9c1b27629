"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import checkpointed, new_path, removed, spread, width

__all__ = ["WORD", "by_key", "checkpointed", "discarded", "fold", "least_draws", "mark", "spread", "table", "width", "written"]

#: ASCII white space, written as the contracts of the operators write it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again; later passes prune its columns."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How much has been written so far, for `discarded`."""
    return len(_WRITTEN)


def discarded(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was `written` since a mark, but for the files that keep reads. Frames over the others can't be used any more."""
    needed = keep.inputFiles() if keep is not None else []
    gone = [p for p in _WRITTEN[since:] if not any(p.rpartition("/")[2] in f for f in needed)]
    removed(spark, *gone)
    _WRITTEN[:] = [p for p in _WRITTEN if p not in gone]


def fold(doc_id: Column, n: int, k: int) -> Column:
    """Whether crc32 of the id's text modulo n is k; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == k, F.lit(False))


def least_draws(rows: DataFrame, by: str, draw: Column, n: int) -> DataFrame:
    """At most n rows for each value of `by`: those with the least draws (64-bit hashes), so that repeated draws can't pass the bound.

    The number of different draws, counted in each task first, says below which draw about 1.5 n of them
    are; only those rows meet in one task a value, at most n from each task.
    """
    drawn = rows.withColumn("__draw", F.shiftrightunsigned(draw, 1))
    known = drawn.groupBy(by).agg(F.approx_count_distinct("__draw").alias("__known"))
    below = known.select(by, (F.lit(float(1 << 63)) * F.least(F.lit(1.0), (1.5 * n + 100) / F.col("__known"))).alias("__below"))
    near = drawn.join(F.broadcast(below), by).filter(F.col("__draw") < F.col("__below"))  # a row for each value: languages or classes
    return near.withColumn("__nth", F.row_number().over(W.partitionBy(by).orderBy("__draw"))).filter(F.col("__nth") <= n).drop("__draw", "__below", "__nth")


#: A key is hot if it holds at least one in so many of the rows; there are at most that many such keys.
HOT = 1000


def by_key(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of left with right, which has at most one row a key, however the rows of left are dealt over the keys.

    Hot keys are joined where left's rows are: they are at most HOT rows, so those of right are broadcast.
    The other keys, each under a HOTth of the rows, are shuffled. counts: rows of left for each key, as
    `company`, if they are known (rows that left has lost since may count). Null keys are in no result.
    left is read twice, and once more without counts.
    """
    counts = left.groupBy(keys).agg(F.count("*").alias("company")) if counts is None else counts
    total = counts.agg(F.sum("company").alias("n")).first()["n"] or 0
    hot = counts.filter(F.col("company") >= max(1, -(-total // HOT))).select(keys)
    near = left.join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys)
    return near.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys))
