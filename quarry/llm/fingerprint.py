"""Document fingerprints by SimHash, their likeness, and permuted block tables to search them.

Terms are pairs of neighbouring words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), or the only word of a
text. A term that occurs n times weighs 1 + floor(log2 n); each bit of its hash votes for or against
with that weight, and a bit of the fingerprint is 1 where the votes for it are more than half. The
likeness of two fingerprints is the cosine that their share of differing bits estimates, 0 at least.

A null text is an empty one, whose fingerprint is zero. Rows are ordered by doc_id, null first, and
repeated ids by their text's hash; equal rows stay in one task. A single row is its own next document.
An empty table gives an empty result. Columns but doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, combinations
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, width
from .vectext import bit_votes, chunks, mixed, packed, run_hashes, runs

BITS = 256
#: Fingerprints of a block in `within_radius` that one cell of it has, about, on either side.
CELL = 1024
_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, np.uint8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1


def terms(text: str) -> np.ndarray:
    """Hashes of the text's terms, repeats included."""
    words = []
    for part in chunks(text.encode("utf-8", "surrogatepass").lower()):
        b = np.frombuffer(part, np.uint8)
        words.append(run_hashes(b, *runs(1 - _SPACE[b])))
    h = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return h if len(h) < 2 else mixed(h[:-1] * np.uint64(3) + h[1:])


def fingerprint(text: str, bits: int = BITS) -> int:
    h, n = np.unique(terms(text), return_counts=True)
    if not len(h):
        return 0
    level, total, votes = np.log2(n).astype(np.int64) + 1, 0, np.zeros(bits, np.int64)
    for least in range(1, int(level.max()) + 1):
        part = h[level >= least]
        total += len(part)
        votes += bit_votes(mixed(part[None, :] ^ _SALTS[: bits // 64, None])).reshape(-1)
    return packed(votes * 2 > total)


def likeness(a: int, b: int, bits: int = BITS) -> float:
    return max(0.0, float(np.cos(pi * (a ^ b).bit_count() / bits)))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(rows: DataFrame, parts: int) -> tuple[Column, int]:
    """The range of a row by (doc_id, hash of the text), null ids first, and how many ranges there are.

    Cuts are percentiles of doc_id. An id that several of them fall on holds that many shares of the rows:
    its rows are ranged by the hash, and so are those without an id, which have ranges of their own.
    """
    if parts == 1:
        return F.lit(0), 1
    shares = ",".join(str(k / parts) for k in range(1, parts))
    seen = rows.selectExpr("count(*) AS n", "count(doc_id) AS with_id", f"percentile_approx(doc_id, array({shares}), 10000) AS cuts").first()
    missing = -((seen["with_id"] - seen["n"]) * parts // seen["n"]) if seen["n"] else 0  # rounded up
    held = Counter(seen["cuts"] or [])
    cuts = sorted(held)
    lasts = list(accumulate((held[c] for c in cuts), initial=missing))  # of the ids below the first cut, then from each cut on
    share = F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5)

    def dealt_by_hash(n: Column) -> Column:
        return F.least(F.floor(share * n), n - 1).cast("int")

    if not cuts:  # no row has an id
        return (dealt_by_hash(F.lit(missing)), missing) if missing else (F.lit(0), 1)
    known = F.array(*map(F.lit, cuts)).cast("array<long>")
    nth = F.size(F.filter(known, lambda x: x <= F.col("doc_id")))
    last = F.get(F.array(*map(F.lit, lasts)), nth)
    at_cut = F.get(known, nth - 1) == F.col("doc_id")
    shared = F.get(F.array(*(F.lit(held[c]) for c in cuts)), nth - 1)
    part = F.when(at_cut, last - shared + 1 + dealt_by_hash(shared)).otherwise(last)
    return F.when(F.col("doc_id").isNull(), dealt_by_hash(F.lit(missing))).otherwise(part), lasts[-1] + 1


def neighbours(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """doc_id, text, part, guard, and the number of ranges: the first row of each range is also the guard of the one before.

    Sorted by (part, guard, doc_id, hash of the text), each row that isn't a guard is followed by its next
    document; the first of all guards the last range. Only a few ids a range reach the driver.
    """
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part, count = ranges(rows, parts)
    rows = rows.withColumn("part", part.cast("int"))
    firsts = {r["part"]: r["first"] for r in rows.groupBy("part").agg(F.min(F.struct("doc_id", tie.alias("tie"))).alias("first")).collect()}
    used = sorted(firsts)
    guards = [(firsts[p]["doc_id"], firsts[p]["tie"], used[k - 1]) for k, p in enumerate(used)]
    g = docs.sparkSession.createDataFrame(guards, "g_id long, g_tie long, g_part int")  # a row a range
    few = F.col("doc_id").isNull() | F.col("doc_id").isin([x[0] for x in guards if x[0] is not None])
    copies = (
        rows.filter(few).join(F.broadcast(g), F.col("doc_id").eqNullSafe(F.col("g_id")) & (tie == F.col("g_tie")))
        .dropDuplicates(["g_part"]).select("doc_id", "text", F.col("g_part").alias("part"), F.lit(True).alias("guard"))
    )
    return rows.withColumn("guard", F.lit(False)).unionByName(copies), count


def fingerprinted(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = parts or width(docs.sparkSession)
    digits = BITS // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                own = fingerprint(text)
                if last is not None:
                    out.append(record(*last, text, own))
                last = (doc_id, text, own)
                if len(out) >= 512:
                    yield packed_rows(out)
                    out = []
        yield packed_rows(out)  # the last row is a guard

    def record(doc_id: int, text: str, own: int, following: str, following_own: int) -> tuple:
        other = edited(text, following)
        changed = own if other == text else fingerprint(other)
        return (doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), f"{own:0{digits}x}", f"{changed:0{digits}x}", likeness(own, changed), likeness(own, following_own))

    def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows, count = neighbours(docs, parts)
    ordered = rows.repartitionById(count, "part").sortWithinPartitions(F.col("guard"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """left and right, of (name, key), with row and column: a key is a grid of cells of about CELL x CELL rows, each pair of a key in one cell."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))

    def put(df: DataFrame, own: str, cuts: str, other: str, copies: str) -> DataFrame:
        at = F.pmod(F.xxhash64(df.columns[0], F.lit("cell")), F.col(cuts)).cast("int")
        return df.join(grid, "key").withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("rows", "columns")

    grid = cells(left, "rows").join(cells(right, "columns"), "key")
    return put(left, "row", "rows", "column", "columns"), put(right, "column", "columns", "row", "rows")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int, blocks: int, bits: int = BITS) -> DataFrame:
    """All (query_fingerprint, fingerprint, distance) within radius, from permuted block tables.

    prints and queries hold hex fingerprints. Of `blocks` blocks at most `radius` differ, so one choice
    of blocks - radius of them agrees: each choice is a table, joined on those blocks and then verified.
    Fingerprints are made distinct first, so copies add nothing. Blocks are joined by cells (`dealt`).
    """
    if not 0 < radius < blocks <= bits // 4:
        raise ValueError("radius < blocks <= bits / 4")
    edges = [round(k * (bits // 4) / blocks) for k in range(blocks + 1)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).distinct()
        block = [F.substring(name, edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
        keys = [F.concat(F.lit(f"{t}:"), *[block[k] for k in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        return one.select(name, F.explode(F.array(*keys)).alias("key"))

    def words(name: str) -> list:
        return [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long") for k in range(bits // 32)]

    left, right = dealt(keyed(queries, "query_fingerprint"), keyed(prints, "fingerprint"))
    pairs = left.join(right, ["key", "row", "column"])
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(words("query_fingerprint"), words("fingerprint"), strict=True)), F.lit(0))
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= radius).select("query_fingerprint", "fingerprint", "distance").distinct()


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
