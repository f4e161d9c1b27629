"""SimHash near-duplicates: fingerprints, pigeonhole blocks, links verified by Hamming distance, components.

A fingerprint is split so that close pairs share a block; rows are joined on blocks and every pair of a
block is verified. A block that many rows share is a grid of cells of about CELL rows, dealt out by pairs
of cells, so that no task holds it whole and no pair of it is lost. A task returns at most one link a row
(to the first row of its cluster), never all pairs. Components come from contractions: each round every
node moves to the neighbour that comes first in a random order, and links within one place vanish; the
moves are then composed. A hub is a key on one side of plain joins only, which adaptive execution splits.

`linked` takes word shingles of any size and a radius within which the blocks find every link.
`deduplicated` finds texts whose five-word shingles are 0.8 alike or more: distances of that size differ
in every block of a shingle fingerprint that is wide enough to tell unlike texts apart. Its blocks are
therefore of least hashes of the shingle set: two sets share one with their likeness as probability,
whether words are changed here and there or a whole passage is added, cut off or replaced, and whatever
the length. A fingerprint of shingles sorts out most pairs of a block that are not alike; what it lets pass
makes loose groups, and inside those every link is verified on the sets of shingles themselves, whatever
their size. Only the texts of loose groups are read again, each into one cell; groups of more than a cell
are contracted first, so that only what is still apart meets as a grid of cells.

Null texts count as empty. Texts of any length are read whole. Equal texts have equal fingerprints and
are one node. Rows with a null id belong to their group, whose id is its smallest non-null one (null if
there is none). An empty table gives an empty result. Extra columns pass through `deduplicated` and are
left out by `linked`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audit import possible
from .common import checkpointed, spread, table, width, written
from .vectext import bit_votes, chunks, mixed, run_hashes, runs

CELL = 1024
SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
#: By so much the distance that the similarity stands for is widened for loose links: four standard deviations of the estimate from FINE words.
SLACK = 1.3
#: Words of 64 bits in the shingle fingerprint of `deduplicated`.
FINE = 16
#: Blocks of `deduplicated` and least hashes in each: sets that are 0.8 alike share a block with a chance of 1 - (1 - 0.8**6)**30 = 0.9999.
BLOCKS, ROWS = 30, 6
#: The estimate is not asked about sets of so many shingles or fewer: all that share a block with one are verified.
SMALL = 64
#: Bytes of text in a cell in which sets are compared, on average.
CELL_BYTES = 1 << 24
_SPACE = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
_SALTS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ORDERS = mixed(np.arange(101, 101 + BLOCKS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_print(text: str, shingle: int) -> int:
    """64 bits; bit i is 1 if it is set in over half of the shingles' XXH64 values, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts, stops = np.concatenate(([0], ends[: n - 1])).tolist(), (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    return int.from_bytes(np.packbits((bit_votes(h) * 2 > n).astype(np.uint8), bitorder="little").tobytes(), "little")


def set_print(h: np.ndarray, words: int) -> bytes:
    """A fingerprint of so many 64-bit words from distinct hashes."""
    votes = bit_votes(mixed(h[None, :] ^ _SALTS[:words, None])) if len(h) else np.zeros((words, 64), np.int64)
    return np.packbits((votes * 2 > len(h)).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def shingles(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles."""
    tokens = []
    for part in chunks(text.encode("utf-8", "surrogatepass").lower()):
        b = np.frombuffer(part, np.uint8)
        tokens.append(run_hashes(b, *runs((~_SPACE[b]).astype(np.uint8))))
    t = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    n = max(1, len(t) - shingle + 1) if len(t) else 0
    s = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(t))):
        s = mixed(s * np.uint64(3) + t[k : k + n])
    return np.unique(s)


def block_keys(h: np.ndarray) -> np.ndarray:
    """A key for each block of ROWS least hashes of a set, each in an order of its own."""
    least = np.full(BLOCKS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), CELL):
        np.minimum(least, (h[None, at : at + CELL] * _ORDERS[:, None]).min(axis=1), out=least)
    key = np.arange(BLOCKS, dtype=np.uint64)
    for row in least.reshape(ROWS, BLOCKS):
        key = mixed(key * np.uint64(3) + row)
    return key.astype(np.int64)


def alike(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted, have so large a likeness; two empty ones have it."""
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common >= similarity * (len(left) + len(right) - common) - 1e-9


def joined(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """The clusters of rows a and b become one; first: the first row of each row's cluster."""
    while (first[a] != first[b]).any():
        low = np.minimum(first[a], first[b])
        np.minimum.at(first, first[a], low)
        np.minimum.at(first, first[b], low)
        while (first[first] != first).any():
            first[:] = first[first]


def pairs_apart(group: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step the pairs of rows of one group that are not of one cluster yet; the caller joins clusters in between."""
    at, step = np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        ask = at[first[at] != first[at + step]]
        yield ask, ask + step
        step += 1


def to_first(node: pa.ChunkedArray, first: np.ndarray) -> pa.RecordBatch:
    """A link from each row to the first one of its cluster."""
    i, node = np.flatnonzero(first != np.arange(len(first))), node.combine_chunks()
    return pa.RecordBatch.from_arrays([node.take(pa.array(first[i])), node.take(pa.array(i))], names=["a", "b"])


def by_cell(cell: list[str], cells: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives whole cells of rows, sorted by the cell's columns, with a number for each row's cell."""

    def group_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, np.int64)
        for c in cell:
            k = t[c].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            kept = pa.concat_tables([x for x in (kept, pa.Table.from_batches([batch])) if x is not None]).combine_chunks()
            group = group_of(kept)
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last cell may go on
            if whole:
                yield from cells(kept.slice(0, whole), group[:whole])
                kept = kept.slice(whole)
        if kept is not None and kept.num_rows:
            yield from cells(kept, group_of(kept))

    return run


def grid(rows: DataFrame, key: str, cells: DataFrame) -> DataFrame:
    """rows dealt out and sorted by key, low, high: the pairs of a key's cells. cells: key, cells."""
    mine = F.pmod(F.xxhash64("node", key), F.col("cells")).cast("int")
    rows = rows.join(cells, key).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cell = [F.col(key), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")]
    more = [c for c in rows.columns if c not in (key, "cells", "mine", "other")]
    return in_cells(rows.select(*cell, *more), key, "low", "high")


def in_cells(rows: DataFrame, *cell: str) -> DataFrame:
    return rows.repartition(width(rows.sparkSession), *cell).sortWithinPartitions(*cell)


def links(prints: DataFrame, most: int, similarity: float | None = None) -> DataFrame:
    """a, b: nodes that share a key and are near, as one link a row and task.

    prints: node, print (bytes), keys (array of long), nodes distinct. Near are those within `most` bits.
    With a similarity, links are loose: prints has `size` (of the set), pairs whose sizes rule the similarity
    out are not near, and those with a SMALL set are near without a look at the bits.
    """
    more = ["size"] if similarity is not None else []
    rows = prints.select("node", "print", *more, F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"), F.count("*").alias("n")).filter("n > 1").drop("n")

    def clustered(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(b"".join(t["print"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        first = np.arange(len(group))
        size = t["size"].to_numpy() if more else first
        for a, b in pairs_apart(group, first):
            near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most
            if more:
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                near = (near | (low <= SMALL)) & (low >= similarity * high - 1e-9)
            joined(first, a[near], b[near])
        yield to_first(t["node"], first)

    kind = prints.schema["node"].dataType.simpleString()
    return grid(rows, "key", shared).mapInArrow(by_cell(["key", "low", "high"], clustered), f"a {kind}, b {kind}")


def alike_links(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: links that make one component of the nodes of a group that are joined by texts so alike.

    texts: node, root (its group), text; nodes distinct. Each row is in one cell at first. Groups of several
    cells go on: one node of each cluster meets those of the other cells, and only groups that are still
    apart then are compared whole, as a grid of cells.
    """

    def sizes(rows: DataFrame) -> DataFrame:
        n = F.greatest(F.count("*") / CELL, F.sum(F.octet_length("text")) / CELL_BYTES)
        return rows.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(n)).cast("int").alias("cells"))

    def clustered(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1)).tolist()
        for start, stop in zip(edges, edges[1:]):  # one cell's sets at a time
            part = t.slice(start, stop - start)
            label = part["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.unique(label, return_index=True)[1][label]
            known = first.copy()
            if not known.any():
                continue
            sets = [shingles(x or "", shingle) for x in part["text"].to_pylist()]
            size = np.array([len(x) for x in sets])
            for a, b in pairs_apart(np.zeros(len(sets), np.int64), first):
                can = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[can], b[can]
                near = np.array([alike(sets[i], sets[j], similarity) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
                joined(first, a[near], b[near])
            yield to_first(part["node"], first)

    def compared(dealt: DataFrame, name: str) -> DataFrame:
        return written(dealt.mapInArrow(by_cell(["root", "low", "high"], clustered), "a string, b string"), name)

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        label = components(found).withColumnRenamed("root", "label")
        return rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    cells = written(sizes(texts), "cells")
    low = F.pmod(F.xxhash64("node", "root"), F.col("cells")).cast("int")
    single = texts.join(cells, "root").select("root", low.alias("low"), low.alias("high"), "node", F.col("node").alias("label"), "text")
    found = compared(in_cells(single, "root", "low", "high"), "near")
    many = cells.filter("cells > 1").select("root")
    if many.isEmpty():
        return found
    large = texts.join(many, "root", "left_semi")
    heads = labelled(large, found).filter(F.col("label") == F.col("node"))
    found = found.union(compared(grid(heads, "root", sizes(heads)), "near-heads"))
    rows = labelled(large, found)
    apart = rows.groupBy("root").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("root")
    rows = rows.join(apart, "root", "left_semi")
    return found.union(compared(grid(rows, "root", sizes(rows)), "near-rest"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b) one node of its component, the same for all of them.

    In expectation a round leaves at most three quarters of the nodes, whatever the graph. Rounds are written
    to the shared folder; the driver only asks whether a link is left.
    """

    def links_of(a: str, b: str, df: DataFrame) -> DataFrame:
        return df.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    moves: list[DataFrame] = []
    edges = written(links_of("a", "b", edges), "links")
    while not edges.isEmpty():
        turn = len(moves)
        first = F.struct(F.xxhash64("v", F.lit(turn)).alias("order"), "v")
        both = edges.select("a", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        own = F.struct(F.xxhash64("u", F.lit(turn)).alias("order"), F.col("u").alias("v"))
        to = both.groupBy("u").agg(F.min(first).alias("least")).select(F.col("u").alias("node"), F.least("least", own)["v"].alias("to"))
        moves.append(to := written(to, "moves"))
        for end in ("a", "b"):
            edges = edges.join(to.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        edges = written(links_of("a_to", "b_to", edges), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop().withColumnRenamed("to", "root")
    while moves:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = written(moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots


def linked(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: fingerprints link at up to radius differing bits.

    At most `radius` of the blocks differ, so each choice of blocks - radius of them is a key.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    chosen = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in c) for c in chosen]

    @F.pandas_udf("long")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([shingle_print(t or "", shingle) for t in texts], np.uint64).astype(np.int64))

    @F.pandas_udf("binary")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series([int(v).to_bytes(8, "little", signed=True) for v in x])

    rows = checkpointed(spread(docs.select("doc_id", "text")).select("doc_id", prints("text").alias("node")))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("node").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("node", raw("node").alias("print"), keys.alias("keys")), radius))
    roots = checkpointed(nodes.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(ids, "root").select("node", "component_id")
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return rows.join(named, "node").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of equal or near texts: the one with the smallest id."""
    most = int(64 * FINE * (acos(2 * similarity / (1 + similarity)) / pi) * SLACK)

    @F.pandas_udf("keys array<long>, print binary, size int")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for text in texts:
                h = shingles(text or "", shingle)
                out.append((block_keys(h), set_print(h, FINE), len(h)))
            yield pd.DataFrame(out, columns=["keys", "print", "size"])

    text = F.coalesce("text", F.lit(""))
    rows = written(spread(docs.select("doc_id", "text")).select("doc_id", F.md5(text).alias("node"), prints(text).alias("p")).select("doc_id", "node", "p.*"), "prints")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("keys", "print", "size")).alias("p")).select("node", "first", "p.*")
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    loose = written(components(links(nodes, most, similarity)).join(firsts, "node"), "loose")
    # Texts of loose groups only, each once; on text and id, so that copies of a text with other ids are dealt over all tasks.
    meant = docs.select(F.col("doc_id").alias("__id"), text.alias("text")).withColumn("node", F.md5("text")).withColumn("__key", F.xxhash64("node", "__id"))
    once = possible(meant, loose.select(F.xxhash64("node", "first").alias("__key")), "__key").join(loose, ["node"]).filter(F.col("__id").eqNullSafe(F.col("first")))
    texts = written(once.groupBy("node", "root").agg(F.first("text").alias("text")), "texts")
    found = components(alike_links(texts, shingle, similarity))
    best = firsts.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("first", "node").alias("best")).groupBy("root").agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.node").alias("__best"), F.col("best.first").alias("__first"))
    mine = docs.withColumn("__node", F.md5(text))
    # On text and id: copies of a text with other ids are dealt over all tasks.
    kept = mine.join(keep, (F.col("__node") == F.col("__best")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    same = W.partitionBy("__node", "doc_id").orderBy("__first")
    return kept.withColumn("__nth", F.row_number().over(same)).filter("__nth = 1").drop("__node", "__best", "__first", "__nth")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
