"""Incremental ingest: what changed is chunked, embedded and activated in one run of the store; what vanished is retired.

What changed is told from the states of the files, a row each; of chunks and vectors a run reads those of its
own files and writes them anew, so its cost follows what was touched, not the corpus. Periodic scans are a Structured Streaming trigger (`stream(every=...)`) or the caller's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import shared
from ..functions import scalars as S
from ..operators import chunking, context, filters, hybrid, store, vectors
from ..schema import JOBS, SOURCE_FILES
from ..sources import extract, listing

Embed = Callable[[DataFrame], DataFrame]


class BudgetExceeded(RuntimeError):
    """The store holds more bytes than allowed."""


@dataclass(frozen=True)
class Budget:
    """Bytes of a store: from `warn` of target on a scan goes on and says so, from stop on it ends as an error."""

    target: int = 10 << 30
    stop: int = 12 << 30
    warn: float = 0.8

    def checked(self, used: int) -> str:
        if used >= self.stop:
            raise BudgetExceeded(f"{used} bytes are in use, {self.stop} are allowed")
        return "warning" if used >= int(self.target * self.warn) else "ok"


def changed(listed: DataFrame, files: DataFrame, chunks: DataFrame, vecs: DataFrame) -> DataFrame:
    """Listed files with a new fingerprint, an unfinished state, or active chunks that lack vectors, counted from whole tables."""
    broken = context.complete_sources(chunks, vecs).filter("not complete").select(F.col("physical_path").alias("path"), F.lit(1).alias("lacking"))
    return unfinished(listed, files.join(broken, "path", "left"))


def unfinished(listed: DataFrame, states: DataFrame) -> DataFrame:
    """As changed, from the states of the files (path, fingerprint, status, lacking), which each run of a store keeps up."""
    known = states.select("path", F.col("fingerprint").alias("__was"), F.col("status").alias("__status"), F.coalesce("lacking", F.lit(0)).alias("__lacking"))
    same = (F.col("__was") == F.col("fingerprint")) & F.col("__status").isin("indexed", "skipped") & (F.col("__lacking") == 0)
    return listed.join(known, "path", "left").filter(~F.coalesce(same, F.lit(False))).select(listed.columns)


def vanished(files: DataFrame, seen: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Paths of stored files under the roots that were not seen and are not there any more: what an unreadable folder hides stays."""
    under = F.lit(False)
    for r in roots:
        under |= filters.under_root(r)
    return listing.gone(files.filter(under & (F.col("status") != "deleted")).join(seen.select("path"), "path", "left_anti"))


def retired(chunks: DataFrame, paths: DataFrame, kept: DataFrame, at: Column) -> DataFrame:
    """chunks of the paths made inactive, but for the kept ids."""
    dead = paths.select("path", F.lit(True).alias("__dead")).distinct()
    left = chunks.withColumn("path", S.physical_path(F.col("source_path"))).join(dead, "path", "left").join(kept.select("id", F.lit(True).alias("__kept")).distinct(), "id", "left")
    off = F.col("__dead").isNotNull() & F.col("__kept").isNull() & F.col("active")
    left = left.withColumn("__off", off)
    return left.withColumns({
        "active": F.col("active") & ~F.col("__off"), "vector_status": F.when(F.col("__off"), "inactive").otherwise(F.col("vector_status")), "updated_at": F.when(F.col("__off"), at).otherwise(F.col("updated_at")),
    }).select(store.CHUNKS.names)


def apply(s: store.Store, touched: DataFrame, records: DataFrame, gone: DataFrame, embed: Embed, now: datetime) -> None:
    """One run: records of the touched files staged, embedded and activated, older chunks of those files and all of the gone ones retired.

    touched: path, kind, fingerprint, size_bytes, mtime_ns, reason (of a skip, or null). Nothing is visible
    before the end, so a failure leaves the last state in place and the next run repeats the work. If the
    embedder can't be reached, the new chunks are kept inactive and their files are vector_pending, to be
    retried; any other failure ends the run. A file that can't be read or parsed keeps its chunks and is an
    error, to be retried.
    """
    at, run, last = F.lit(now), s.claimed(), s.snapshot()
    # What follows reads these several times; with their lineage cut its plans stay small.
    paths = shared.checkpointed(touched.select("path").union(gone.select("path")).distinct().withColumn("place", store.place_of("path")))
    files = shared.checkpointed(last.files(paths))
    old = shared.checkpointed(last.rows_of("chunks", files))
    vecs = last.rows_of("vectors", files).select("chunk_id", "embedding")
    bad = shared.checkpointed(records.filter("failed is not null").groupBy(S.physical_path(F.col("source_path")).alias("path")).agg(F.first("failed").alias("failed")))
    whole = records.filter("failed is null").join(bad.select("path"), F.col("path") == S.physical_path(F.col("source_path")), "left_anti")
    new = chunking.chunked(whole.select("source_path", "source_kind", "title", "text", "metadata"))
    new = shared.checkpointed(new.withColumn("place", store.place_of(S.physical_path(F.col("source_path")))))
    staged = shared.checkpointed(store.upserted(old.select(store.CHUNKS.names), new, False, at, run * store.RUN_IDS, ["place", *store.KEY]))
    ids = staged.join(new.select(store.KEY), store.KEY, "left_semi").select(F.col("id").alias("chunk_id"), S.physical_path(F.col("source_path")).alias("physical_path"))

    def written(chunks: DataFrame) -> DataFrame:
        return s.write("chunks", chunks.withColumn("place", store.place_of(S.physical_path(F.col("source_path")))), run)

    live = retired(store.activated(staged, ids, at)[0], paths.join(bad, "path", "left_anti"), ids.withColumnRenamed("chunk_id", "id"), at)
    chunks, failure = written(live), None
    place = chunks.filter("active").select(F.col("id").alias("chunk_id"), "place")
    try:
        fresh = embed(vectors.missing(chunks, vecs)).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
        held = s.write("vectors", vecs.unionByName(fresh).join(place, "chunk_id"), run)
    except (OSError, vectors.ClientError, PythonException) as e:
        if isinstance(e, PythonException) and not vectors.unreachable(e):
            raise
        failure = str(e)[:1000]
        chunks = written(pending(live, ids, at))
        held = s.write("vectors", vecs.join(chunks.filter("active").select(F.col("id").alias("chunk_id"), "place"), "chunk_id"), run)
    count = ids.groupBy(F.col("physical_path").alias("path")).agg(F.count("*").alias("n"))
    ok = F.lit("indexed" if failure is None else "vector_pending")
    state = touched.join(count, "path", "left").join(bad, "path", "left").select(
        "path", F.col("kind").alias("source_kind"), "fingerprint", "size_bytes", "mtime_ns",
        F.when(F.col("failed").isNotNull(), "error").when(F.col("reason").isNotNull() | F.col("n").isNull(), "skipped").otherwise(ok).alias("status"), F.coalesce("failed", "reason", F.when(F.col("n").isNotNull(), F.lit(failure))).alias("error"),
    )
    lost = files.join(gone, "path", "left_semi").select("path", "source_kind", "fingerprint", "size_bytes", "mtime_ns", F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("error"))
    s.publish(run, chunks, held, store.merged_files(files.select(SOURCE_FILES.names), state.unionByName(lost), at))


def pending(chunks: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """chunks with those of ids inactive and waiting for vectors."""
    mine = ids.select(F.col("chunk_id").alias("id"), F.lit(True).alias("__mine")).distinct()
    return store.deactivated(chunks.join(mine, "id", "left"), F.coalesce("__mine", F.lit(False)), at, "vector_pending")


def seen_files(listed: DataFrame, rules: Sequence[filters.PathRule], archives: bool) -> DataFrame:
    """path, kind, reason (of a skip, or null), fingerprint, size_bytes, mtime_ns of a listing."""
    rule = filters.classified_under(F.col("path"), F.col("root"), rules)
    return listed.filter("error is null").dropDuplicates(["path"]).withColumn("rule", rule).withColumns({
        "kind": F.col("rule.kind"), "reason": filters.skip_reason(F.col("path"), F.col("size_bytes"), F.col("rule"), archives), "fingerprint": S.file_fingerprint(F.col("path"), F.col("size_bytes"), F.col("mtime_ns")),
    }).select("path", "kind", "reason", "fingerprint", "size_bytes", "mtime_ns")


def ingested(s: store.Store, seen: DataFrame, gone: DataFrame, now: datetime, embed: Embed, flush: int, budget: Budget | None, pause: Callable[[], bool] | None = None) -> dict[str, int]:
    """What is new or changed among the seen files, in runs of about `flush` files each; the counters.

    pause is asked before each run; where it says so, the files of later runs are left for the next crawl and counted as `left`.
    """
    seen, gone = shared.checkpointed(seen), shared.checkpointed(gone)
    touched = shared.checkpointed(unfinished(seen, s.read("source_files", whole=True)))
    total, n = seen.count(), touched.count()
    rounds, done = -(-n // flush) or int(not gone.isEmpty()), 0
    touched = touched.withColumn("__round", F.pmod(F.xxhash64("path", F.lit("flush")), F.lit(max(rounds, 1))))
    for k in range(rounds):
        if pause and pause():
            break
        if budget:
            budget.checked(s.size_bytes())
        some = touched.filter(F.col("__round") == k).drop("__round")
        records = shared.checkpointed(extract.records(some.filter("reason is null"), read=listing.contents))
        apply(s, some, records, gone if k == 0 else gone.limit(0), embed, now)
        done += 1
    mine = touched.filter(F.col("__round") < done).select("path")
    out = context.outcomes(s.read("source_files").join(mine, "path", "left_semi")).first().asDict()
    return {**out, "discovered": total, "unchanged": total - n, "left": n - mine.count(), "paused": int(done < rounds)}


def crawl(
    spark: SparkSession, s: store.Store, roots: Sequence[str], now: datetime, embed: Embed = vectors.embedded, rules: Sequence[filters.PathRule] = filters.RULES, archives: bool = False,
    flush: int = 10_000, budget: Budget | None = None, pause: Callable[[], bool] | None = None, folders: Sequence[str] = (), scopes: Sequence[str] = (),
) -> dict[str, int]:
    """Scan the roots once, as a job; the counters of what was discovered and what became of it, and `unreadable` folders.

    A store over its budget ends the job as an error and raises. Where pause says so, what was begun is
    finished and the job ends as paused; the next crawl of these roots goes on with what is left. folders and scopes: see `filters.Pruning`; what was
    indexed before and is no longer walked stays as it is while its file is there.
    """
    at, job = F.lit(now), s.claimed()
    s.put("index_jobs", store.created_job(spark.createDataFrame([], JOBS), "; ".join(roots), at, job_id=job))

    def ended(status: str, message: str, **counters: int) -> None:
        s.put("index_jobs", store.updated_job(context.by_id(s.read("index_jobs"), job), job, status, message, at, **counters))

    try:
        listed = shared.checkpointed(listing.listed(spark, roots, filters.SKIPPED_FOLDERS, folders, scopes))
        seen = seen_files(listed, rules, archives)
        out = ingested(s, seen, vanished(s.read("source_files"), seen, roots), now, embed, flush, budget, pause)
        out["unreadable"] = listed.filter("error is not null").select("path").distinct().count()
    except BudgetExceeded as e:
        ended("error", str(e))
        raise
    counters = {k: out[k] for k in ("discovered", "indexed", "skipped", "error")}
    ended("paused" if out["paused"] else "completed", f"{out['left']} files left" if out["paused"] else "", **counters)
    return out


def retry(s: store.Store, now: datetime, embed: Embed = vectors.embedded, rules: Sequence[filters.PathRule] = filters.RULES, flush: int = 10_000, archives: bool = False) -> dict[str, int]:
    """Failed and pending sources once more, each as a root of its own; those that are gone are retired and counted as missing."""
    todo = shared.checkpointed(store.to_retry(s.read("source_files")).select("path"))
    gone = shared.checkpointed(listing.gone(todo))
    out = ingested(s, seen_files(listing.stated(todo), rules, archives), gone, now, embed, flush, None)
    return out | {"retried": todo.count(), "missing": gone.count()}


def rebuild_vectors(s: store.Store, embed: Embed = vectors.embedded) -> int:
    """Vectors for all active chunks that lack one, as one run; how many they are."""
    last = s.snapshot()
    lacking = shared.checkpointed(vectors.missing(last.read("chunks", whole=True), last.read("vectors")))
    n = lacking.count()
    if n:
        run, files = s.claimed(), shared.checkpointed(last.files(lacking))
        chunks = s.write("chunks", last.rows_of("chunks", files), run)
        fresh = embed(lacking).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
        kept = last.rows_of("vectors", files).select("chunk_id", "embedding")
        held = s.write("vectors", kept.unionByName(fresh).join(chunks.select(F.col("id").alias("chunk_id"), "place"), "chunk_id"), run)
        s.publish(run, chunks, held, files)
    return n


def recent_without_vectors(chunks: DataFrame, vecs: DataFrame, recent: int = 25, limit: int = 5) -> DataFrame:
    """Sources of the chunks changed last that lack vectors: what a start looks at after a run was cut short."""
    last = context.recent_sources(chunks, recent)
    mine = chunks.join(F.broadcast(last), S.physical_path(F.col("source_path")) == F.col("physical_path"), "left_semi")  # at most `recent` sources
    lacking = context.complete_sources(mine, vecs).filter("not complete")
    return last.join(lacking.select("physical_path"), "physical_path").orderBy("position").limit(limit)


def corpus(s: store.Store, embed_query: Callable[[str], Sequence[float]]) -> hybrid.Corpus:
    """What was ingested, as the tables of a search."""
    now = s.snapshot()
    return hybrid.Corpus(now.read("chunks"), now.read("postings"), now.totals(), now.read("vectors"), embed_query)


def stream(spark: SparkSession, s: store.Store, source: str, schema: str, checkpoint: str, embed: Embed = vectors.embedded, files_per_batch: int = 32, every: str | None = None, budget: Budget | None = None) -> StreamingQuery:
    """Records that arrive as Parquet files, each micro-batch one run; pause by stop(), resume from the checkpoint.

    every: a processing-time interval such as `1 hour`; without one, what is there now and no more.
    """

    def batch(df: DataFrame, number: int) -> None:
        if budget:
            budget.checked(s.size_bytes())
        df = df.withColumn("failed", F.lit(None).cast("string")).persist()
        path = S.physical_path(F.col("source_path"))
        touched = df.groupBy(path.alias("path")).agg(
            F.min("source_kind").alias("kind"), F.sha2(F.array_join(F.array_sort(F.collect_set(S.content_hash(F.col("text")))), ""), 256).alias("fingerprint"),
            F.sum(F.octet_length("text")).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(None).cast("string").alias("reason"),
        )
        touched = unfinished(touched, s.files(touched.select(store.place_of("path").alias("place")))).persist()
        fresh = df.join(touched.select("path"), path == F.col("path"), "left_semi")
        apply(s, touched, fresh, touched.limit(0).select("path"), embed, datetime.now())
        df.unpersist()
        touched.unpersist()

    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = read.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
