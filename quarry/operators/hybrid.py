"""Hybrid search: semantic and lexical lists, filtered, cut and fused by reciprocal rank.

Every step takes several query texts at once and carries their number in `query`, so that a search for
variants of a text reads the index once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import RESULT_COLUMNS
from . import filters as FL
from . import lexical, vectors
from .lookup import winners

SEMANTIC_WEIGHT, LEXICAL_WEIGHT, RANK_OFFSET = 1.0, 1.25, 60
SNIPPET_CHARS = 240
SECRET_FALLBACKS = ("api key", "token", "secret", "password", "credential")


@dataclass
class Corpus:
    """The tables of a search, and the function that embeds a query text on the driver."""

    chunks: DataFrame
    postings: DataFrame
    totals: lexical.Totals
    vectors: DataFrame
    embed: Callable[[str], Sequence[float]]


def best(results: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first of each query, with their rank from 1; each task drops what can't be among them."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return results.withColumn("rank", rank).filter(F.col("rank") <= limit)


def semantic(corpus: Corpus, *texts: str, limit: int) -> DataFrame:
    """The best active chunks by inner product, from max(8 * limit, 50) candidates a text."""
    hits = vectors.nearest_of_each(corpus.vectors, [corpus.embed(t) for t in texts], max(8 * limit, 50))
    found = winners(corpus.chunks.filter("active"), hits)
    rows = found.select("query", "chunk_id", "source_path", "source_kind", "title", F.substring("text", 1, SNIPPET_CHARS).alias("snippet"), "score", F.lit("vector").alias("rank_source"), "metadata")
    return best(rows, limit, F.desc("score"), "chunk_id")


def fused(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two ranked lists as one: weight / (rank + 60) summed; fields from the first list; ties to it."""
    both = first.withColumns({"list": F.lit(0), "part": F.lit(SEMANTIC_WEIGHT) / (F.col("rank") + RANK_OFFSET)}).unionByName(
        second.withColumns({"list": F.lit(1), "part": F.lit(LEXICAL_WEIGHT) / (F.col("rank") + RANK_OFFSET)})
    )
    row = F.struct(*[c for c in RESULT_COLUMNS if c not in ("chunk_id", "score")])
    out = both.groupBy("query", "chunk_id").agg(
        F.min_by(row, "list").alias("row"), F.sum("part").alias("score"), F.count("*").alias("lists"), F.min("list").alias("list"), F.min_by("rank", "list").alias("place")
    )
    source = F.when(F.col("lists") > 1, "hybrid").otherwise(F.col("row.rank_source")).alias("rank_source")
    return best(out, limit, F.desc("score"), "list", "place", "chunk_id").select("query", "rank", "chunk_id", "row.source_path", "row.source_kind", "row.title", "row.snippet", "score", source, "row.metadata")


def search_each(corpus: Corpus, texts: Sequence[str], limit: int = 10, filters: Mapping[str, object] | None = None, prefilter: bool = False) -> DataFrame:
    """query, rank and the result columns, for each text. See `search`."""
    texts = [t.strip() for t in texts]
    if not all(texts) or not texts or limit <= 0:
        nothing = {"snippet": "", "score": 0.0, "rank_source": ""}
        return corpus.chunks.limit(0).select(F.lit(0).alias("query"), F.lit(0).alias("rank"), F.col("id").alias("chunk_id"), *[F.lit(nothing[c]).alias(c) if c in nothing else F.col(c) for c in RESULT_COLUMNS[1:]])
    if prefilter and filters:
        kept = corpus.chunks.filter(FL.predicate(filters))
        corpus = replace(corpus, chunks=kept, vectors=vectors.contained(corpus.vectors, kept.select(F.col("id").alias("chunk_id"))), postings=vectors.contained(corpus.postings, kept.select(F.col("id").alias("chunk_id"))))
    n = FL.candidates(limit, filters)
    passes = FL.predicate(filters)
    words = lexical.lexical_search(corpus.chunks, corpus.postings, corpus.totals, *texts, limit=n)
    words = best(words.filter(passes), limit, "score", "chunk_id")
    try:
        near = semantic(corpus, *texts, limit=n)
    except (OSError, RuntimeError):  # the embedder can't be reached
        near = words.limit(0)
    near = best(near.filter(passes), limit, F.desc("score"), "chunk_id")
    return fused(near, words, limit)


def search(corpus: Corpus, text: str, limit: int = 10, filters: Mapping[str, object] | None = None, prefilter: bool = False) -> DataFrame:
    """Best results first. Filters apply to each list after its top-k, or below it with prefilter; without an embedding the search is lexical."""
    return search_each(corpus, [text], limit, filters, prefilter).orderBy("rank").select(RESULT_COLUMNS)


def search_all(corpus: Corpus, text: str, filters: Mapping[str, object] | None = None, limit: object = 10) -> DataFrame:
    """`search` with a limit from user input."""
    return search(corpus, text, FL.clamped(limit), filters)


def search_files(corpus: Corpus, text: str, filters: Mapping[str, object] | None = None, limit: object = 10, prefilter: bool = False) -> DataFrame:
    """Files and project sources among the best max(limit, 30) results; with prefilter, the best among all of them."""
    return _of_kind(corpus, text, filters, limit, F.col("source_kind").isin("normal_file", "project_source"), prefilter)


def search_sessions(corpus: Corpus, text: str, source: str | None = None, filters: Mapping[str, object] | None = None, limit: object = 10, prefilter: bool = False) -> DataFrame:
    """Sessions, of one source if it is given, among the best max(limit, 30) results; with prefilter, the best among all of them."""
    kind = F.col("source_kind") == "ai_session"
    return _of_kind(corpus, text, filters, limit, kind & (F.element_at("metadata", "source") == source) if source else kind, prefilter)


def _of_kind(corpus: Corpus, text: str, filters: Mapping[str, object] | None, limit: object, kind: Column, prefilter: bool) -> DataFrame:
    n = FL.clamped(limit)
    if prefilter:
        kept = corpus.chunks.filter(kind)
        ids = kept.select(F.col("id").alias("chunk_id"))
        corpus = replace(corpus, chunks=kept, vectors=vectors.contained(corpus.vectors, ids), postings=vectors.contained(corpus.postings, ids))
    return search_each(corpus, [text], max(n, 30), filters).filter(kind).orderBy("rank").limit(n).select(RESULT_COLUMNS)


def secret_variants(text: str) -> list[str]:
    """The text, its words, and fixed words that secrets go by, each once."""
    whole = " ".join(text.split())
    return list(dict.fromkeys([*([whole] if whole else []), *whole.split(), *SECRET_FALLBACKS]))


def find_secrets(corpus: Corpus, text: str, limit: object = 10) -> DataFrame:
    """Config files that match the text's variants: in the variants' order, each chunk where it comes first. One pass for all variants."""
    n = FL.clamped(limit)
    return first_seen(search_each(corpus, secret_variants(text), max(n, 30), {"file_type": "config"}), n).select(RESULT_COLUMNS)


def first_seen(results: DataFrame, limit: int) -> DataFrame:
    """Of each chunk the result of the first query that has it, in the order of queries and ranks."""
    nth = F.row_number().over(W.partitionBy("chunk_id").orderBy("query", "rank"))
    return results.withColumn("__nth", nth).filter("__nth = 1").drop("__nth").orderBy("query", "rank").limit(limit)


def compact(results: DataFrame) -> DataFrame:
    """Results under the short names id and path."""
    return results.select(F.col("chunk_id").alias("id"), "title", F.col("source_path").alias("path"), "source_kind", "snippet", "rank_source", "score", "metadata")


SORT_KEYS = ("name", "source", "type", "score")


def resorted(results: DataFrame, key: str, descending: bool | None = None) -> DataFrame:
    """Results by name, source, type or score; scores fall and the others rise unless said otherwise. Case doesn't count; ties by id."""
    if key not in SORT_KEYS:
        raise ValueError(f"one of {SORT_KEYS}")
    descending = key == "score" if descending is None else descending
    by = {
        "name": F.lower("title"), "source": F.lower(S.source_label(F.col("source_kind"))), "type": F.lower(S.type_label(F.col("metadata"), F.col("source_kind"), F.col("source_path"))), "score": F.col("score"),
    }[key]
    return results.orderBy(by.desc() if descending else by.asc(), "chunk_id")
