"""Table changes as transforms, each of a table to its next state, and the tables of a corpus on disk."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import scalars as S
from ..schema import CHUNKS, FILE_STATES, JOBS, SAVED_SEARCHES, SOURCE_FILES, VECTORS
from ..schema import POSTINGS as POSTINGS_TABLE
from . import lexical
from .lookup import by_ids

KEY = ["source_path", "ordinal", "content_hash"]
FINAL = ("completed", "paused", "error")


def upserted(chunks: DataFrame, new: DataFrame, activate: bool, now: Column, next_id: int, order: Sequence[str] = KEY) -> DataFrame:
    """chunks with new merged on (source_path, ordinal, content_hash).

    Ids are kept; new rows get ids from next_id on, in the order of their key or of other columns that tell them apart. An active row stays active
    when staged again; activation makes a row active and indexed, staging leaves it inactive and pending.
    """
    last = new.withColumn("__n", F.row_number().over(W.partitionBy(*KEY).orderBy("title"))).filter("__n = 1").drop("__n")
    old = chunks.select(*KEY, F.col("id").alias("__id"), F.col("active").alias("__active"), F.col("vector_status").alias("__status"), F.col("created_at").alias("__created"))
    both = last.drop("id", "active", "vector_status", "created_at", "updated_at").join(old, KEY, "left")
    fresh = both.filter("__id is null")
    # Ids in key order over all new rows: ranks in ranges of the key, then offsets of the ranges.
    known = both.filter("__id is not null")
    fresh = gapless(fresh.drop("__id"), list(order), "__id", next_id)
    live = F.lit(True) if activate else F.coalesce("__active", F.lit(False))
    status = F.lit("indexed") if activate else F.when(F.coalesce("__active", F.lit(False)), F.col("__status")).otherwise("vector_pending")
    merged = known.unionByName(fresh).withColumns({"id": F.col("__id"), "active": live, "vector_status": status, "created_at": F.coalesce("__created", now), "updated_at": now})
    return chunks.join(last.select(KEY), KEY, "left_anti").select(CHUNKS.names).unionByName(merged.select(CHUNKS.names))


def gapless(rows: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """rows, distinct by order, with numbers from start on in that order: ranges of the order, a row a range to sum, and a number inside each."""
    keys = rows.select(*order).repartitionByRange(shared.width(rows.sparkSession), *order)
    keys = shared.checkpointed(keys.withColumn("__part", F.spark_partition_id()))
    counts = keys.groupBy("__part").agg(F.count("*").alias("__c"))
    ahead = F.sum("__c").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    counts = counts.select("__part", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    nth = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    numbered = keys.withColumn("__nth", nth).join(F.broadcast(counts), "__part")
    return rows.join(numbered.select(*order, (F.col("__ahead") + F.col("__nth") + (start - 1)).alias(name)), order)


def activated(chunks: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table with ids (chunk_id, physical_path) active and other chunks of those sources retired, and the retired ids."""
    keep = ids.select(F.col("chunk_id").alias("id"), F.lit(True).alias("__new")).distinct()
    source = ids.select("physical_path").distinct().withColumn("__touched", F.lit(True))
    marked = chunks.withColumn("physical_path", S.physical_path(F.col("source_path"))).join(keep, "id", "left").join(source, "physical_path", "left")
    on, off = F.coalesce("__new", F.lit(False)), F.coalesce("__touched", F.lit(False)) & F.col("active") & F.col("__new").isNull()
    retired = marked.filter(off).select(F.col("id").alias("chunk_id"))
    return _set(marked, on, off, now), retired


def _set(marked: DataFrame, on: Column, off: Column, now: Column) -> DataFrame:
    out = marked.withColumns({
        "__a": F.when(on, True).when(off, False).otherwise(F.col("active")), "vector_status": F.when(on, "indexed").when(off, "inactive").otherwise(F.col("vector_status")),
        "updated_at": F.when(on | off, now).otherwise(F.col("updated_at")),
    })
    return out.withColumn("active", F.col("__a")).select(CHUNKS.names)


def deactivated(chunks: DataFrame, where: Column, now: Column, status: str = "inactive") -> DataFrame:
    """Rows where the predicate holds made inactive: a deleted source, or with vector_pending a failed flush."""
    return chunks.withColumns({
        "active": F.col("active") & ~where, "vector_status": F.when(where, status).otherwise(F.col("vector_status")), "updated_at": F.when(where, now).otherwise(F.col("updated_at")),
    }).select(CHUNKS.names)


def purged(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """chunks without the inactive ones of ids."""
    doomed = chunks.filter("not active").join(ids.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").select("id")
    return chunks.join(doomed, "id", "left_anti").select(CHUNKS.names)


def merged_files(files: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Source files by path: new rows win, last_indexed_at moves only with status indexed, the rest stay."""
    n, o = new.alias("n"), files.alias("o")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    take = F.col("n.path").isNotNull()
    pick = {c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("source_kind", "fingerprint", "size_bytes", "mtime_ns", "status", "error")}
    return both.select(
        F.coalesce("n.path", "o.path").alias("path"), *[v.alias(k) for k, v in pick.items()],
        F.when(take & (F.col("n.status") == "indexed"), now).otherwise(F.col("o.last_indexed_at")).alias("last_indexed_at"), F.when(take, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def with_status(files: DataFrame, where: Column, status: str, error: str | None, now: Column) -> DataFrame:
    return files.withColumns({"status": F.when(where, status).otherwise(F.col("status")), "error": F.when(where, F.lit(error)).otherwise(F.col("error")), "updated_at": F.when(where, now).otherwise(F.col("updated_at"))})


def to_retry(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status").isin("error", "vector_pending")).orderBy("path")


def retry_totals(files: DataFrame, there: DataFrame) -> DataFrame:
    """How many sources are to be retried, and how many of them are gone (there: the paths that still exist)."""
    found = there.select("path", F.lit(True).alias("__there")).distinct()
    todo = files.filter(F.col("status").isin("error", "vector_pending")).join(found, "path", "left")
    return todo.agg(F.count("*").alias("retried"), F.count_if(F.col("__there").isNull()).alias("missing"))


def created_job(jobs: DataFrame, root_path: str, now: Column, status: str = "running", message: str = "", job_id: int | None = None, **counters: int) -> DataFrame:
    """jobs with a new one under job_id, or else the next id; one that is created with a final status is finished."""
    if job_id is None:
        job_id = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"] + 1
    row = (job_id, root_path, status, *[counters.get(k, 0) for k in ("discovered", "indexed", "skipped", "error")], message)
    new = jobs.sparkSession.createDataFrame([row], T.StructType(JOBS.fields[:8]))
    return jobs.unionByName(new.withColumns({"started_at": now, "updated_at": now, "finished_at": now if status in FINAL else F.lit(None).cast("timestamp")}))


def background_error(jobs: DataFrame, message: str, now: Column) -> DataFrame:
    """A background scan that failed, as a job."""
    return created_job(jobs, "background", now, "error", message, error=1)


def updated_job(jobs: DataFrame, job_id: int, status: str, message: str, now: Column, **counters: int) -> DataFrame:
    """A job's state; finished_at is set by a final status only."""
    here = F.col("id") == job_id
    change = {"status": F.lit(status), "message": F.lit(message), "updated_at": now, **{k: F.lit(v).cast("long") for k, v in counters.items()}}
    if status in FINAL:
        change["finished_at"] = now
    return jobs.withColumns({k: F.when(here, v).otherwise(F.col(k)) for k, v in change.items()})


def saved_search(searches: DataFrame, name: str, query: str, filters: dict[str, str], now: Column) -> DataFrame:
    """Saved searches by name: the id and creation time of a known name stay."""
    spark = searches.sparkSession
    row = searches.agg(F.max(F.when(F.col("name") == name, F.col("id"))).alias("own"), F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.max(F.when(F.col("name") == name, F.col("created_at"))).alias("made")).first()
    new = spark.createDataFrame([(row["own"] or row["last"] + 1, name, query, filters, row["made"], None)], SAVED_SEARCHES)
    new = new.withColumns({"created_at": F.coalesce("created_at", now), "updated_at": now})
    return searches.filter(F.col("name") != name).unionByName(new)


TABLES = {"chunks": CHUNKS, "vectors": VECTORS, "source_files": FILE_STATES, "index_jobs": JOBS, "saved_searches": SAVED_SEARCHES, "postings": POSTINGS_TABLE}
#: What tells the rows of a table apart where a later run replaces them one by one.
OWN_KEY = {"source_files": ["path", "place"], "index_jobs": ["id"], "saved_searches": ["name"]}
#: Ids that a run may give to its new chunks; run n has those from n * RUN_IDS on.
RUN_IDS = 1 << 32
#: Up to so many files are looked up by a pushed list of their places; more are joined.
FEW = 1000
_CLAIMING = threading.Lock()


def place_of(physical_path: Column | str) -> Column:
    """A file's number, by which its rows are found in all tables; files that share one are always written together."""
    return F.xxhash64(physical_path)


class Store:
    """The tables of a corpus as plain Parquet, a folder `run=n` a table and run, in whatever store Spark writes.

    A run writes the rows of the files that it touches, all of them, and then their states; Spark's own mark of
    a finished write under the states makes the run visible. Of each file the rows of its last visible run
    count, so a run rewrites nothing, repeats without harm, and two that go on at once both count: of a file
    that both touch, the one with the higher number. What a run that failed has written is never read.
    Numbers are claimed by a file that only one writer can create (on local disks, only one of this process).
    """

    def __init__(self, spark: SparkSession, path: str, runs: Sequence[int] | None = None):
        self.spark, self.path, self._pinned = spark, path.rstrip("/"), runs

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def claimed(self) -> int:
        """A number for a run, above all others."""
        fs, folder = self._fs(f"{self.path}/runs")
        with _CLAIMING:
            n = max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0
            while True:
                n += 1
                try:
                    if fs.createNewFile(self._fs(f"{self.path}/runs/{n:012d}")[1]):
                        return n
                except Py4JJavaError as e:  # another process was faster
                    if "AlreadyExists" not in str(e.java_exception):
                        raise

    def runs(self, name: str = "source_files") -> list[int]:
        """The visible runs of a table."""
        if self._pinned is not None and name not in ("index_jobs", "saved_searches"):
            return list(self._pinned)
        fs, marks = self._fs(f"{self.path}/{name}/run=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().removeprefix("run=")) for f in fs.globStatus(marks) or [])

    def snapshot(self) -> Store:
        """The store as it is now; later runs don't show."""
        return Store(self.spark, self.path, self.runs())

    def _of_runs(self, name: str, runs: Sequence[int]) -> DataFrame:
        extra = [("run", T.LongType())]
        extra += [("place", T.LongType())] if name in ("chunks", "vectors", "postings") else []
        extra += [("bucket", T.IntegerType())] if name == "postings" else []
        schema = T.StructType(TABLES[name].fields + [T.StructField(*e) for e in extra])
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/run={n}" for n in runs])

    def read(self, name: str, whole: bool = False) -> DataFrame:
        """The live rows of a table; with whole, their run and place too."""
        if name in OWN_KEY:
            rows, key = self._of_runs(name, self.runs(name)), OWN_KEY[name]
            rest = [c for c in rows.columns if c not in (*key, "run")]
            rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, "run"), "run").alias("__row")).select(*key, "__row.*")
            shown = SOURCE_FILES.names if name == "source_files" else TABLES[name].names
        else:
            runs = self.runs()
            rows, shown = self._of_runs(name, runs), [*TABLES[name].names, *(["bucket"] if name == "postings" else [])]
            if len(runs) > 1:  # only files of later runs can replace others
                later = self._of_runs("source_files", runs[1:]).groupBy(F.col("place").alias("__place")).agg(F.max("run").alias("__last"))
                rows = rows.join(later, (F.col("place") == F.col("__place")) & (F.col("run") < F.col("__last")), "left_anti")
        return rows if whole else rows.select(*shown)

    def files(self, places: DataFrame) -> DataFrame:
        """The states of the files at the places (a column place)."""
        states, few = self.read("source_files", whole=True), self._few(places)
        return (states if few is None else by_ids(states, "place", few)).join(places.select("place").distinct(), "place", "left_semi")

    def rows_of(self, name: str, states: DataFrame) -> DataFrame:
        """The rows of the files with these states: of their runs only, and where they are few by a list that prunes row groups."""
        at = states.select("place", "run").distinct()
        rows, few = self._of_runs(name, sorted(r["run"] for r in at.select("run").distinct().collect())), self._few(at)
        return (rows if few is None else by_ids(rows, "place", few)).join(at, ["place", "run"], "left_semi")

    def _few(self, places: DataFrame) -> list[int] | None:
        some = [r["place"] for r in places.select("place").distinct().limit(FEW + 1).collect()]
        return some if len(some) <= FEW else None

    def write(self, name: str, df: DataFrame, run: int) -> DataFrame:
        """A table's rows of a run, in the order of their places, written and read back; a second write takes the place of the first."""
        if name == "postings":
            writer = lexical.dealt(df).write.partitionBy("bucket")
        elif name in ("chunks", "vectors"):  # a file with many chunks is several partitions
            block = F.shiftright(F.col("id" if name == "chunks" else "chunk_id"), 12)
            writer = df.select(*TABLES[name].names, "place").repartition("place", block).sortWithinPartitions("place").write
        else:
            df = df.select(*TABLES[name].names)
            writer = (df.repartition("place").sortWithinPartitions("place") if name == "source_files" else df.coalesce(1)).write
        writer.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")
        return self._of_runs(name, [run])

    def publish(self, run: int, chunks: DataFrame, vectors: DataFrame, states: DataFrame) -> None:
        """Postings and states of a run whose chunks and vectors are written; it is visible when this returns.

        states: rows of SOURCE_FILES; what is counted of their chunks is added.
        """
        index = self.write("postings", lexical.postings(chunks, "place"), run)
        tokens = index.groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("tokens")).withColumnRenamed("chunk_id", "id")
        has = vectors.select(F.col("chunk_id").alias("id"), F.lit(True).alias("has"))
        each = chunks.select("id", "active", S.physical_path(F.col("source_path")).alias("path")).join(tokens, "id", "left").join(has, "id", "left")
        counts = each.groupBy("path").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("active") & F.col("has").isNull()).alias("lacking"))
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("chunks", "tokens", "lacking")}
        self.write("source_files", states.select(SOURCE_FILES.names).join(counts, "path", "left").withColumns(zero).withColumn("place", place_of("path")), run)

    def put(self, name: str, rows: DataFrame) -> None:
        """Jobs or saved searches, new ones or in place of those with the same key."""
        self.write(name, rows, self.claimed())

    def totals(self) -> lexical.Totals:
        """Chunks and tokens, summed over the states."""
        row = self.read("source_files", whole=True).agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        return lexical.Totals(*row)

    def copied(self, path: str) -> Store:
        """The live rows as one run of a new store. The old one stays for its readers; whoever knows that there are none any more deletes it."""
        now, new = self.snapshot(), Store(self.spark, path)
        for name in ("index_jobs", "saved_searches"):
            new.write(name, now.read(name), max(now.runs(name), default=0))
        last = max([*now.runs(), 0])
        for name in ("chunks", "vectors", "postings", "source_files"):
            new.write(name, now.read(name, whole=True).drop("run", "bucket"), last)
        fs, mark = self._fs(f"{path.rstrip('/')}/runs/{self.claimed():012d}")  # numbers, and so ids, go on from here
        fs.createNewFile(mark)
        return new

    def size_bytes(self, folder: str = "") -> int:
        """The bytes under the store's path, or under one of its folders."""
        fs, p = self._fs(f"{self.path}/{folder}".rstrip("/"))
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def usage(self) -> dict[str, int]:
        """Bytes by part of the store."""
        total, vectors, log = self.size_bytes(), self.size_bytes("vectors"), self.size_bytes("runs")
        tables = sum(self.size_bytes(n) for n in TABLES if n != "vectors")
        return {"total": total, "tables": tables, "vectors": vectors, "logs": log, "other": max(0, total - tables - vectors - log)}
