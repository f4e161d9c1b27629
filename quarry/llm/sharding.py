"""Minimum-cost-flow resharding.

From the bytes of the old shards and the capacities of the new ones, a minimum-cost flow says how many
bytes go from where to where so that the fewest move. Each old shard is cut into blocks by a hash; whole
blocks are transferred, and only a block that a cut falls into is divided, between two rows. The driver
sees one total per block: `blocks` times the number of old shards, whatever the input.

Null ids and null texts are ordinary rows (a null text has size 1); repeated rows and ties are ordered
by id, checksum and size, and equal ones are interchangeable. An empty table gives an empty result.
Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, table, width, written

INF = float("inf")


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that ships all supply within demand at least cost, by successive shortest paths."""
    n, m = len(supply), len(demand)
    flow, left, room = [[0] * m for _ in supply], list(supply), list(demand)
    while any(left):
        # Nodes 0..n-1 are old shards, n..n+m-1 new ones; a used edge can be walked back at its negative cost.
        dist = [0 if left[i] else INF for i in range(n)] + [INF] * m
        back: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v], default=None)
        if end is None or dist[end] == INF:
            raise ValueError("the new capacities are too small")
        path, v = [], end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def resharded(df: DataFrame, old: Column, size: Column, order: list[Column], shards: int, blocks: int | None = None, cost: list[list[int]] | None = None) -> DataFrame:
    """df with size, old_shard, shard and slot (gapless from 0 in each shard).

    The new shards' sizes differ by at most about one row. cost[i][j] is the price of a byte moved from
    old shard i to new shard j; by default 0 where i equals j, else 1.
    """
    spark = df.sparkSession
    blocks = blocks or max(256, width(spark))  # so that a block stays one task's work
    df = df.withColumn("__row", F.xxhash64(*order))
    counts = df.groupBy("__row").agg(F.count("*").alias("n"))
    least = max(2, -(-(counts.agg(F.sum("n")).first()[0] or 0) // HOT))
    often = counts.filter(F.col("n") >= least).select("__row", F.lit(True).alias("__often"))  # at most HOT rows
    # Rows that are equal and many are interchangeable: they are dealt over the blocks by where they lie.
    spread = F.xxhash64("__row", F.when(F.col("__often"), F.monotonically_increasing_id()))
    block = W.partitionBy("old_shard", "__block").orderBy(*order)
    # One narrow row for each input row, kept in the shared folder: texts are read once.
    rows = written(
        df.join(F.broadcast(often), "__row", "left").withColumns({"size": size.cast("long"), "old_shard": old.cast("int"), "__block": F.pmod(F.shiftright(spread, 7), F.lit(blocks)).cast("int")})
        .withColumns({"__end": F.sum("size").over(block.rowsBetween(W.unboundedPreceding, W.currentRow)), "__n": F.row_number().over(block)}).drop("__row", "__often"),
        "reshard",
    )
    totals = {(r[0], r[1]): r[2] for r in rows.groupBy("old_shard", "__block").agg(F.sum("size")).collect()}
    n_old = max((i for i, _ in totals), default=-1) + 1
    supply = [sum(v for (i, _), v in totals.items() if i == k) for k in range(n_old)]
    cost = cost or [[int(i != j) for j in range(shards)] for i in range(n_old)]
    flow = min_cost_flow(supply, even_capacities(sum(supply), shards), cost)

    plan = []  # block, and its pieces: a row whose end in the block is at most `upto` goes to `shard`
    for i in range(n_old):
        stay_first = sorted(range(shards), key=lambda j: (i != j, j))
        targets = [(end, j) for end, j in zip(accumulate(flow[i][j] for j in stay_first), stay_first, strict=True) if flow[i][j]]
        at = 0
        for b in sorted(b for k, b in totals if k == i):
            # A row belongs where its middle byte falls, so that a cut moves by half a row at most.
            pieces = [(min(end, at + totals[i, b]) - at, j) for end, j in targets if end > at]
            first_whole = next((k for k, (upto, _) in enumerate(pieces) if upto >= totals[i, b]), len(pieces) - 1)
            plan.append((i, b, [(float(upto), j) for upto, j in pieces[: first_whole + 1]]))
            at += totals[i, b]
    plan_df = spark.createDataFrame(plan, "old_shard int, __block int, __pieces array<struct<upto:double,shard:int>>")
    middle = F.col("__end") - F.col("size") / 2
    placed = rows.join(F.broadcast(plan_df), ["old_shard", "__block"]).withColumn(
        "shard", F.coalesce(F.get(F.filter("__pieces", lambda p: p["upto"] >= middle), F.lit(0)), F.element_at("__pieces", -1))["shard"]
    )
    counts = placed.groupBy("shard", "old_shard", "__block").agg(F.min("__n").alias("first"), F.count("*").alias("n")).collect()
    base, taken = [], dict.fromkeys(range(shards), 0)
    for r in sorted(counts, key=lambda r: (r["shard"], r["old_shard"], r["__block"])):
        base.append((r["shard"], r["old_shard"], r["__block"], taken[r["shard"]] - r["first"]))
        taken[r["shard"]] += r["n"]
    base_df = spark.createDataFrame(base, "shard int, old_shard int, __block int, __base long")
    return (
        placed.join(F.broadcast(base_df), ["shard", "old_shard", "__block"])
        .withColumn("slot", F.col("__base") + F.col("__n"))
        .drop("__block", "__end", "__n", "__pieces", "__base")
    )


def laid_out(rows: DataFrame, path: str) -> None:
    """Write rows with shard and slot as folders `shard=K` under path, each shard's files in the order of slots."""
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def rewrite(spark: SparkSession, folders: dict[int, str], path: str, shards: int, size: Column, **options) -> dict[int, str]:
    """Reshard a layout (shard to its folder, as `laid_out` writes them) to so many shards; the folder of each new shard.

    Only shards that gain or lose rows are written, under path, which must be new; the folders of the others
    are listed as they are, and no folder is ever overwritten or deleted. Rows are told apart by their old
    shard and slot, so null and repeated ids and equal rows come through one by one. Options go to `resharded`.
    """

    def read(which: Iterable[int]) -> DataFrame:
        parts = [spark.read.parquet(folders[k]).withColumn("__old", F.lit(k)) for k in sorted(which)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    narrow = read(folders).select("__old", F.col("slot").alias("__slot"), size.alias("__size"))
    plan = resharded(narrow, F.col("__old"), F.col("__size"), [F.col("__old"), F.col("__slot")], shards, **options)
    moved = plan.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("k")).distinct()
    affected = {r["k"] for r in moved.collect()}  # shards at most
    out = {k: folders[k] for k in range(shards) if k in folders and k not in affected}
    if sources := affected & set(folders):
        now = plan.filter(F.col("shard").isin(sorted(affected))).select("__old", "__slot", "shard", F.col("slot").alias("__new"))
        full = read(sources).withColumnRenamed("slot", "__slot").join(now, ["__old", "__slot"])
        laid_out(full.withColumn("slot", F.col("__new")).drop("__old", "__slot", "__new"), path)
    return out | {k: f"{path}/shard={k}" for k in sorted(affected) if k < shards and plan.filter(F.col("shard") == k).limit(1).count()}


#: The layout that the query starts from, and the one it makes.
OLD_SHARDS, NEW_SHARDS = 6, 8


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: 6 shards by a hash of the row become 8 of near equal size."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("__bytes")]
    out = resharded(docs, F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(OLD_SHARDS)), F.col("__bytes") + 1, order, NEW_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
