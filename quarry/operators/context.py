"""Point lookups, neighbouring chunks, roll-ups and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def by_ids(chunks: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Active chunks of an id set, given as a short list or as a DataFrame of `id`."""
    live = chunks.filter("active")
    if isinstance(ids, DataFrame):
        return live.join(ids.select("id").distinct(), "id", "left_semi")
    return live.filter(F.col("id").isin(list(dict.fromkeys(ids))))


def get_chunk(chunks: DataFrame, chunk_id: int) -> DataFrame:
    out = by_ids(chunks, [chunk_id])
    if out.isEmpty():
        raise KeyError(chunk_id)
    return out


def opened(results: DataFrame) -> DataFrame:
    """physical_path, start_line and end_line of results, the lines null where they aren't positive integers."""
    return results.withColumns({"physical_path": S.physical_path(F.col("source_path")), **{k: S.positive_int(F.element_at("metadata", k)) for k in ("start_line", "end_line")}})


def numbered(chunks: DataFrame) -> DataFrame:
    """Active chunks with physical_path and position among those of their physical source."""
    live = chunks.filter("active").withColumn("physical_path", S.physical_path(F.col("source_path")))
    return live.withColumn("position", F.row_number().over(W.partitionBy("physical_path").orderBy("ordinal", "source_path", "id")))


def surrounding(chunks: DataFrame, targets: DataFrame, radius: int = 1) -> DataFrame:
    """target and the chunks up to radius (0 to 10) places from it in its source, without itself."""
    radius = max(0, min(10, radius))
    own = targets.select(F.col("id").alias("target")).distinct()
    # Only the sources of the targets are numbered.
    place = chunks.filter("active").join(own, F.col("id") == F.col("target")).select(S.physical_path(F.col("source_path")).alias("physical_path")).distinct()
    live = chunks.filter("active").withColumn("physical_path", S.physical_path(F.col("source_path"))).join(place, "physical_path", "left_semi")
    rows = live.withColumn("position", F.row_number().over(W.partitionBy("physical_path").orderBy("ordinal", "source_path", "id")))
    mid = rows.join(own, F.col("id") == F.col("target")).select("target", "physical_path", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position"))
    return mid.join(rows, ["physical_path", "position"]).filter("id <> target").select("target", "id", "source_path", "ordinal", "title", "text", "position")


def context_text(chunks: DataFrame, targets: DataFrame, radius: int = 1) -> DataFrame:
    """target, context: each target and its neighbours by (ordinal, id), with blank lines between."""
    near = surrounding(chunks, targets, radius).select("target", "ordinal", "id", "text")
    own = by_ids(chunks, targets).select(F.col("id").alias("target"), "ordinal", "id", "text")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "id", "text")))
    return near.unionByName(own).groupBy("target").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))


def kinds(chunks: DataFrame) -> DataFrame:
    return chunks.filter("active").groupBy("source_kind").agg(F.count("*").alias("chunks"))


def file_states(files: DataFrame) -> DataFrame:
    return files.groupBy("source_kind", "status").agg(F.count("*").alias("files"))


def summary(chunks: DataFrame, highlights: int = 3) -> DataFrame:
    """A row a project: chunks, files, chunks by kind, the first highlights as 240-character snippets, and a text of it all.

    chunks needs a column project; any key works, so that one query sums all projects up.
    """
    live = chunks.filter("active").withColumn("physical_path", S.physical_path(F.col("source_path")))
    by_kind = live.groupBy("project", "source_kind").agg(F.count("*").alias("n"))
    by_kind = by_kind.groupBy("project").agg(F.sum("n").alias("chunks"), F.array_sort(F.collect_list(F.struct("source_kind", "n"))).alias("kinds"))
    files = live.groupBy("project").agg(F.countDistinct("physical_path").alias("files"))
    first = live.withColumn("nth", F.row_number().over(W.partitionBy("project").orderBy("source_path", "ordinal", "id"))).filter(F.col("nth") <= highlights)
    first = first.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.substring("text", 1, 240).alias("s")))), lambda x: x["s"]).alias("highlights"))
    out = by_kind.join(files, "project").join(first, "project")
    kinds_text = F.array_join(F.transform("kinds", lambda k: F.concat_ws(": ", k["source_kind"], k["n"].cast("string"))), ", ")
    return out.withColumn("summary", F.concat_ws("\n", F.concat(F.col("chunks").cast("string"), F.lit(" chunks in "), F.col("files").cast("string"), F.lit(" files ("), kinds_text, F.lit(")")), F.array_join("highlights", "\n")))


def outcomes(files: DataFrame) -> DataFrame:
    """The counters of a crawl."""
    return files.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "error")])


def usage(files: DataFrame) -> DataFrame:
    """Bytes by part of the data folder and the state of its budget."""
    name, size = F.lower("path"), F.col("size_bytes")
    part = {"tables": name.contains("/chunks/") | name.contains("/source_files/"), "vectors": name.contains("/vectors/"), "logs": name.endswith(".log")}
    out = files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.when(p, size)), F.lit(0)).alias(k) for k, p in part.items()])
    rest = F.greatest(F.lit(0), F.col("total") - sum((F.col(k) for k in part), F.lit(0)))
    return out.withColumns({"other": rest, "state": S.storage_state(F.col("total"))})


def by_id(rows: DataFrame, row_id: int) -> DataFrame:
    """A job or a saved search."""
    return rows.filter(F.col("id") == row_id)


def saved_searches(searches: DataFrame) -> DataFrame:
    """The last changed first."""
    return searches.orderBy(F.desc("updated_at"), F.desc("id"))


def shown(chunks: DataFrame, name: str = "chunk_id", path: str = "source_path") -> DataFrame:
    """Chunks as callers see them; `name` and `path` say what their id and source are called."""
    return chunks.select(F.col("id").alias(name), F.col("source_path").alias(path), "source_kind", "title", "text", "metadata", "ordinal", "content_hash")


def in_context(chunks: DataFrame) -> DataFrame:
    return shown(chunks, "id", "path")


def shown_job(jobs: DataFrame) -> DataFrame:
    """Jobs with counters under their long names and times as text."""
    counters = [F.col(c).alias(f"{c}_count") for c in ("discovered", "indexed", "skipped", "error")]
    return jobs.select("id", "root_path", "status", *counters, "message", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "updated_at", "finished_at")])


def diagnostics(jobs: DataFrame, files: DataFrame, chunks: DataFrame, sample: int = 0, redact: bool = False) -> DataFrame:
    """One row of JSON: the latest job, files by kind and state, active chunks by kind, and samples if asked for."""

    def listed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
        return df.agg(rows.alias(name)).withColumn("__one", F.lit(1))

    parts = [listed(file_states(files), "source_status_counts", ["source_kind", "status"]), listed(kinds(chunks), "active_chunk_counts", ["source_kind"])]
    if sample:
        parts.append(listed(samples(chunks, sample, redact).select("id", "source_path", "source_kind", "title", "text", "metadata", "ordinal").withColumn("metadata", F.to_json("metadata")), "chunk_samples", ["id"]))
    last = shown_job(latest(jobs))
    out = last.agg(F.first(F.struct(*last.columns)).alias("latest_job")).withColumn("__one", F.lit(1))
    for p in parts:
        out = out.join(p, "__one")
    return out.select(F.to_json(F.struct(*[c for c in out.columns if c != "__one"])).alias("diagnostics"))


def latest(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(n)


def recent_sources(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """physical_path, position: of the limit (1 to 500) chunks changed last, their sources in the order of first appearance."""
    last = chunks.filter("active").orderBy(F.desc("updated_at"), F.desc("id")).limit(max(1, min(500, limit)))
    last = last.withColumn("position", F.row_number().over(W.orderBy(F.desc("updated_at"), F.desc("id"))))  # at most 500 rows
    return last.groupBy(S.physical_path(F.col("source_path")).alias("physical_path")).agg(F.min("position").alias("position")).orderBy("position")


def samples(chunks: DataFrame, n: int, redact: bool = True) -> DataFrame:
    """The first n active chunks by id, secrets redacted: what a diagnostics export shows."""
    out = chunks.filter("active").orderBy("id").limit(n)
    return out.withColumns({"title": S.redacted(F.col("title")), "text": S.redacted(F.col("text")), "metadata": S.redacted_map(F.col("metadata"))}) if redact else out


def complete_sources(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """physical_path, complete: whether all active chunks of a source have vectors."""
    live = chunks.filter("active").select("id", S.physical_path(F.col("source_path")).alias("physical_path"))
    has = live.join(vectors.select(F.col("chunk_id").alias("id"), F.lit(True).alias("has")), "id", "left")
    return has.groupBy("physical_path").agg(F.every(F.coalesce("has", F.lit(False))).alias("complete"))
