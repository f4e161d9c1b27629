"""Rows by a bounded list of ids, read through the files' statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of one pushed list; Parquet readers compare longer ones by their least and greatest value only.
TOGETHER = 10
#: Lists of a filter; more ids make the lists longer, not more.
LISTS = 64


def by_ids(rows: DataFrame, column: str, ids: Sequence[int]) -> DataFrame:
    """The rows with one of the ids: a filter that the scan gets, so that row groups without them are passed over.

    Ids are winners of a search, a few hundred of each of its texts. In files sorted by the column (`by_id_order`)
    a list of neighbouring ids meets few row groups. The lists are joined as a balanced tree, as planners recurse
    into it.
    """
    known = sorted(set(ids))
    if not known:
        return rows.limit(0)
    size = max(TOGETHER, -(-len(known) // LISTS))
    lists = [F.col(column).isin(known[k : k + size]) for k in range(0, len(known), size)]
    return rows.filter(any_of(lists))


def any_of(conditions: Sequence[Column]) -> Column:
    """Their disjunction, of logarithmic depth."""
    half = len(conditions) // 2
    return any_of(conditions[:half]) | any_of(conditions[half:]) if half else conditions[0]


def by_id_order(rows: DataFrame, *columns: str) -> DataFrame:
    """rows as they are best written for `by_ids`: ranges of the columns a file, sorted inside."""
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)


def winners(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (chunk_id and more, at most a limit a query) with the columns of their chunks, of which only those are read.

    The hits go through the driver: their ids are a filter of the scan, their rows a broadcast.
    """
    rows = hits.collect()
    few = chunks.sparkSession.createDataFrame(rows, hits.schema)
    return by_ids(chunks, "id", [r["chunk_id"] for r in rows]).withColumnRenamed("id", "chunk_id").join(F.broadcast(few), "chunk_id")
