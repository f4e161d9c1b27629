"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source queues its documents in a shuffled order, up to `repeats` times over; a copy's virtual
finish time is the source's tokens so far divided by its weight. All copies are range-sorted by that
time and the queue is cut at the total budget. Sources that run dry drop out and the others go on by
weight, so each source's share is `min(repeats * size, weight * t)` with one t for all: its target.

Null sources are a source of their own, last. Null texts and empty ones have size 0 and take nothing.
Repeated rows are separate documents; equal ones are interchangeable. An empty table gives an empty
result. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table, width

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
#: Hex digits of the shuffle key that bin a source's queue: 16**3 bins, so that no source's prefix sum is one task's work.
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """What a source's queue is ordered by: id and text, so that rows that share an id, or have none, are in different bins."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def shares(sizes: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """source, source_size, rank, weight, target from one row a source (the only unpartitioned windows: a row a source)."""
    by_name, dry_first = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("__dry", "rank")
    ahead, rest = dry_first.rowsBetween(W.unboundedPreceding, -1), dry_first.rowsBetween(0, W.unboundedFollowing)
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("__most", F.col("source_size") * repeats)
        .withColumn("__dry", F.col("__most") / F.col("weight"))
        # t if the sources that run dry sooner than this one give all they have
        .withColumn("__t", (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("__most").over(ahead), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("__t", F.max(F.when(F.col("__t") <= F.col("__dry"), F.col("__t"))).over(W.partitionBy()))
        .withColumn("target", F.least(F.col("__most").cast("double"), F.col("weight") * F.col("__t")))
        .select("source", "source_size", "rank", "weight", "target")
    )


def mixed_counts(docs: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 7, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a document: the kept columns (none named like a result), source, size, source_size, target, copies (times taken) and first (its first finish time)."""
    key = shuffle_key(seed)
    if clash := set(keep) & {"source", "size", "source_size", "target", "copies", "first"}:
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    rows = checkpointed(docs.select(*keep, F.col("source"), size.alias("size"), key.alias("__key")).withColumn("__bin", F.conv(F.substring("__key", 1, BIN_DIGITS), 16, 10).cast("int")))
    bins = rows.groupBy("source", "__bin").agg(F.sum("size").alias("__sum"))
    sources = shares(bins.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, repeats)
    before = W.partitionBy("source").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)  # a row a bin: 16**BIN_DIGITS at most
    offsets = _with_shares(bins.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum"), sources)
    within = W.partitionBy("source", "__bin").orderBy("__key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = _by_source_and_bin(rows.withColumn("__upto", F.sum("size").over(within)), offsets)
    queued = checkpointed(queued.withColumn("__upto", F.col("__upto") + F.col("__before")).drop("__before", "__key", "__bin"))

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("__upto")) / F.col("weight")

    # Range-sort all copies by finish time; a partition's total, then the sums inside it, find the cut.
    copies = queued.filter("size > 0").select("size", "rank", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__epoch"), "source_size", "__upto", "weight")
    copies = copies.select("size", "rank", finish(F.col("__epoch")).alias("time"))
    spark = docs.sparkSession
    ranged = checkpointed(copies.repartitionByRange(width(spark), "time", "rank").withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(F.sum("size").alias("__sum")).withColumn("__ahead", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    in_order = W.partitionBy("__part").orderBy("time", "rank").rowsBetween(W.unboundedPreceding, 0)
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cut = (
        ranged.withColumn("__run", F.sum("size").over(in_order))
        .join(F.broadcast(parts.select("__part", "__ahead")), "__part")  # a row a partition
        .filter(F.col("__run") + F.col("__ahead") <= budget)
        .agg(F.max(F.struct("time", "rank")).alias("cut"))
        .first()["cut"]
    )
    time, rank = (cut["time"], cut["rank"]) if cut else (-1.0, -1)
    in_time = lambda e: (finish(e) < time) | ((finish(e) == time) & (F.col("rank") <= rank))
    copies = sum((F.when((F.col("size") > 0) & in_time(F.lit(e)), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    return queued.withColumns({"copies": copies, "first": finish(F.lit(0)), "target": F.coalesce("target", F.lit(0.0))}).drop("__upto", "weight", "rank")


def _with_shares(bins: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.withColumnRenamed("source", "__s")
    return bins.join(s, bins["source"].eqNullSafe(s["__s"])).drop("__s")


def _by_source_and_bin(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    o = offsets.withColumnsRenamed({"source": "__s", "__bin": "__b"})
    return rows.join(o, rows["source"].eqNullSafe(o["__s"]) & (rows["__bin"] == o["__b"])).drop("__s", "__b")


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with all of its columns.

    Counts are made on narrow rows and joined to the documents once, by a hash of id and text. Equal rows
    are interchangeable, and told apart by a number.
    """
    size = word_count(F.col("text"))
    keys = ("__k_row", "__k_source")
    same = W.partitionBy(*keys)
    counts = mixed_counts(docs.withColumn("__k_row", shuffle_key(seed)), size, weights, repeats, seed, keep=("doc_id", "__k_row")).select("__k_row", F.col("source").alias("__k_source"), "copies")
    counts = counts.withColumn("__nth", F.row_number().over(same.orderBy("copies"))).filter("copies > 0")
    rows = docs.withColumns(dict(zip(keys, (shuffle_key(seed), F.col("source")), strict=True)))
    rows = rows.withColumn("__nth", F.row_number().over(same.orderBy("doc_id"))).alias("d")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "__nth")]
    joined = rows.join(counts.alias("c"), on)
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("__copy")).drop("__copy")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixed_counts(docs, word_count(F.col("text")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, concat_ws(':', '7', CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS unhashed, md5(unhashed) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t
  FROM s1
), s3 AS (
  SELECT *, least(3.0::DOUBLE * source_size, weight * (SELECT max(t) FROM s2 WHERE t <= 3 * source_size / weight)) AS target FROM s2
), q AS (
  SELECT d.*, s3.source_size, s3.target, s3.rank, s3.weight,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source
), c AS (
  SELECT q.*, CAST(epoch * source_size + upto AS DOUBLE) / weight AS time FROM q, (VALUES (0), (1), (2)) e(epoch)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY time, rank ROWS UNBOUNDED PRECEDING) AS run FROM c WHERE size > 0
), k AS (
  SELECT doc_id, key, count(*) AS copies FROM r WHERE run <= (SELECT sum(source_size) FROM s0) GROUP BY doc_id, key
)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (doc_id)
"""
