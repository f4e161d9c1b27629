"""Phrase collocation mining: phrases of two and three words whose words meet more often than by chance.

Phrases are words, pairs and triples. Every task deals those of its texts over shards by their hash: a block's
different phrases, one a line, with their numbers, so that each text is cut and sent once, whatever the number of
shards. A shard has all lines of its phrases. It sifts them by hash, lists what may be frequent, compiles
the list into pyahocorasick automata (one a language) whose patterns begin and end with a delimiter, the newline,
and scans its lines with them; matches overlap in the delimiter, and the sums of what they stand for are exact.
Shards grow in number with the bytes of text, so that a shard and its automata are bounded.

Before that, tasks add the hashes of words and pairs to a sketch of two rows of counters, which are summed block by
block on the cluster; a count can only be too high, so a counter under the least count rules a phrase out. A second
sketch takes the triples whose pairs passed. What fails in them isn't dealt, which changes no result. On texts
that would fill such a sketch, so that it rules out nothing, all phrases are dealt without it.

Within a block of text, words and phrases are told apart by 64-bit hashes when they are dealt.

A null text is an empty one, a null lang is `und`. Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]`
into pieces and these at spaces and tabs; a phrase lies within a piece. Repeated rows count as often as they
occur; equal scores and counts are ranked by the phrase's bytes. An empty table gives no phrases. Words of
any length are whole. Columns but text and lang are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, discarded, mark, spread, table, width, written
from .vectext import CHUNK, mixed, run_hashes, runs

LEAST, WORDS, TOP, COVER = 10, 3, 2000, 50
#: Counters of a row of the sketch as a power of two: 2 x 2^25 counters of 8 bits are 64 MB in a worker.
LOG = 25
#: Counters that are sent as one row.
BLOCK = 1 << 16
#: Phrases that are compiled at once, at most; about 350 bytes each in a worker.
SHARD = 700_000
#: Characters of text that are joined to one block of work, if they are of the same language, and that wait for it in all.
JOINED, WAITING = 1 << 18, 8 << 20
#: Characters of text whose phrases are dealt together, and bytes of lines that a task holds before it passes them on.
DEALT, HELD = 1 << 20, 16 << 20
#: Bits of the hash that a line is sent with; the first of them choose its shard.
KEY, FIRST = 40, 24
#: Bytes that are hashed at once; longer words are hashed one by one.
SPAN = CHUNK // 8
#: Parts of a language whose phrases are ranked side by side first.
PARTS = 32
#: Tasks a core that make a sketch. Each sends its own, however much it reads.
TASKS = 2
_WORD = np.ones(256, np.uint8)
_WORD[list(b" \t.,;:!?\n\x0b\x0c\r")] = 0
_CUT = np.zeros(256, np.uint8)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = 1
_SALT = np.uint64(0xD6E8FEB86659FD93)


#: The automata that this worker holds, by language. Held here, so that whatever begins next can let go of them, also after a task that failed.
_HELD: dict[str, object] = {}


class Block:
    """Texts of one language: where their words are, hashes of words (h[0]), pairs and triples, and where these lie in a piece."""

    def __init__(self, lang: str, texts: list[str]):
        self.lang = lang
        self.data = ".".join([*texts, ""]).encode().lower()  # the last byte is a cut
        self.bytes = np.frombuffer(self.data, np.uint8)
        found = [self._words(lo, hi) for lo, hi in self._spans()]
        self.starts, self.ends, h = (np.concatenate([f[k] for f in found]) for k in range(3))
        h = mixed(h + np.uint64(xxhash.xxh64_intdigest(lang)))
        self.piece = np.cumsum(_CUT[self.bytes], dtype=np.int32)[self.starts]
        self.h, self.inside = [h], [np.ones(len(h), bool)]
        for k in range(1, WORDS):
            n = max(0, len(h) - k)
            self.h.append(mixed(self.h[-1][:n] * np.uint64(2 * k + 1) + h[k:]))
            self.inside.append(self.piece[:n] == self.piece[k:])
        self.part = (self.h[1] & np.uint64(0x7FFFFFFF)).astype(np.int32)

    def _spans(self) -> Iterator[tuple[int, int]]:
        """The data in spans of at most SPAN bytes that end after a blank or cut, or up to the end of a longer word."""
        at, n = 0, len(self.data)
        while n - at > SPAN:
            gaps = np.flatnonzero(_WORD[self.bytes[at : at + SPAN]] == 0)
            end = at + int(gaps[-1]) + 1 if len(gaps) else at + SPAN
            while _WORD[self.bytes[end - 1]]:
                more = np.flatnonzero(_WORD[self.bytes[end : end + SPAN]] == 0)
                end += int(more[0]) + 1 if len(more) else SPAN
            yield at, end
            at = end
        yield at, n

    def _words(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = self.bytes[lo:hi]
        starts, ends = runs(_WORD[part])
        if len(starts) and (ends - starts).max() >= SPAN:  # alone in its span, or nearly
            h = np.array([xxhash.xxh64_intdigest(part[s:e].tobytes()) if e - s >= SPAN else int(run_hashes(part[s:e], np.array([0]), np.array([e - s]))[0]) for s, e in zip(starts, ends, strict=True)], np.uint64)
        else:
            h = run_hashes(part, starts, ends)
        return starts + lo, ends + lo, h

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space behind each, and where they begin there."""
        out, edge = self.bytes.copy(), np.zeros(len(self.bytes) + 1, np.int8)
        out[self.ends] = 0x20
        edge[self.starts] += 1
        edge[self.ends + 1] -= 1
        return out[np.cumsum(edge[:-1], dtype=np.int8) > 0], np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))

    def lines(self, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that begin at these places, joined by one space and each ended by a newline, and where they end."""
        flat, begin = self.flat
        size = begin[at + words] - begin[at]
        ends = np.cumsum(size)
        out = flat[np.repeat(begin[at] - ends + size, size) + np.arange(size.sum())]
        out[ends - 1] = 0x0A
        return out, ends

    def phrases(self, at: np.ndarray, words: int) -> list[str]:
        """The words that begin at these places, joined by one space."""
        return self.lines(at, np.full(len(at), words))[0].tobytes().decode().split("\n")[:-1]


def blocks(batches: Iterator[pa.RecordBatch], joined: int = JOINED) -> Iterator[Block]:
    waiting: dict[str, list[str]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang, text = lang.as_py(), text.as_py()
            waiting[lang].append(text)
            size[lang] += len(text) + 1
            if size[lang] >= joined:
                yield Block(lang, waiting.pop(lang))
                del size[lang]
        if sum(size.values()) >= WAITING:
            yield from (Block(lang, texts) for lang, texts in waiting.items())
            waiting.clear()
            size.clear()
    yield from (Block(lang, texts) for lang, texts in waiting.items())


def places(h: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of hashes in the two rows of 2^log."""
    shift = np.uint64(64 - log)
    return (h >> shift).astype(np.int64), (mixed(h ^ _SALT) >> shift).astype(np.int64) + (1 << log)


def added(counters: np.ndarray, at: np.ndarray, top: int) -> None:
    """Counts at these places, repeats included, in counters that stop at top (255 at most)."""
    at = np.sort(at.astype(np.int32))
    first = np.flatnonzero(np.diff(at, prepend=np.int32(-1)))
    n = np.minimum(np.diff(first, append=len(at)), top).astype(np.uint16)
    own = at[first]
    counters[own] = np.minimum(counters[own] + n, top)


class Met:
    """Hashes that were met, as far as they have room: two places for each; one that had to give way counts as new again."""

    def __init__(self, log: int):
        self.shift, self.held = np.uint64(64 - log), np.zeros(1 << log, np.uint64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Which of these different hashes were not met; from now on they are. Zero, which marks a free place, is always new."""
        one, two = h >> self.shift, mixed(h ^ _SALT) >> self.shift
        out = (self.held[one] != h) & (self.held[two] != h) | (h == 0)
        h, one, two = h[out], one[out], two[out]
        self.held[np.where(self.held[one] == 0, one, two)] = h
        return out


class Passed:
    """Bits of the counters that reached the least count."""

    def __init__(self, found: list[tuple[int, bytes]], log: int):
        self.log, self.bits = log, np.zeros(2 << (log - 3), np.uint8)
        for block, bits in found:
            self.bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in places(h, self.log):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def passing(block: Block, pairs: Passed, triples: Passed | None = None) -> list[np.ndarray]:
    """For words, pairs and triples whether they may be frequent; without the sketch of triples, whether its own parts may."""
    one = pairs(block.h[0])
    two = block.inside[1] & one[:-1] & one[1:]
    two[two] = pairs(block.h[1][two])
    three = block.inside[2] & two[:-1] & two[1:]
    if triples is not None:
        three[three] = triples(block.h[2][three])
    return [one, two, three]


def sketch(texts: DataFrame, hashes: Callable[[Block], list[np.ndarray]], least: int, log: int) -> Passed:
    """Counters of all hashes, summed over the tasks, as the bits of those that reach least."""
    top = min(least, 255)  # what is above makes no difference

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped()  # of an earlier table
        counters = np.zeros(2 << log, np.uint8)
        for block in blocks(batches):
            for h in hashes(block):
                for at in places(h, log):
                    added(counters, at, top)
        for k in range(0, len(counters), BLOCK):
            part = counters[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                own = sums.setdefault(block, np.zeros(BLOCK, np.uint16))
                np.minimum(own + np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint8), top, out=own)
        for block, own in sums.items():
            bits = np.packbits(own >= top, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

    parts = texts.mapInArrow(count, "block int, counts binary").repartition(width(texts.sparkSession), "block")
    return Passed([tuple(r) for r in parts.mapInArrow(add, "block int, bits binary").collect()], log)  # 8 MB of bits, whatever the input


def dropped() -> None:
    """This worker's automata are let go. A function of the module, as one that is sent to a worker by value brings its own copy of `_HELD`."""
    _HELD.clear()


def planed(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed: all first bytes, then all second ones, and so on."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unplaned(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def dealt(texts: DataFrame, shards: int, pairs: Broadcast | None, triples: Broadcast | None) -> DataFrame:
    """Rows of a shard: lines of phrases that may be frequent, their keys and how often they were met, and of which languages how many (sizes) they are.

    words: all words of the one language of a row without lines.
    """
    kinds = {"shard": pa.int32(), "langs": pa.list_(pa.string()), "sizes": pa.list_(pa.int64()), "words": pa.int64(), "bytes": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "lines": pa.binary()}
    mask = np.uint64((1 << KEY) - 1)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def row(shard: int, parts: list[tuple]) -> tuple:
        langs, keys, counts, lines = zip(*parts, strict=True)
        own, data = np.concatenate(keys), b"".join(lines)
        return shard, langs, [len(k) for k in keys], None, len(data), planed(np.diff(own, prepend=np.uint64(0)) & mask), planed(np.concatenate(counts)), pa.compress(data, codec="zstd", asbytes=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        size, words = 0, Counter()
        for block in blocks(batches, DEALT):
            words[block.lang] += len(block.h[0])
            may = passing(block, pairs.value, triples.value) if pairs else block.inside
            at = [np.flatnonzero(m) for m in may]
            h = np.concatenate([x[a] for x, a in zip(block.h, at, strict=True)])
            if not len(h):
                continue
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n, keys, chosen = np.diff(first, append=len(h)), h[first] >> np.uint64(64 - KEY), order[first]
            places, lengths = np.concatenate(at)[chosen], np.repeat(np.arange(1, WORDS + 1), [len(a) for a in at])[chosen]
            borders = np.searchsorted((keys >> np.uint64(KEY - FIRST)) * np.uint64(shards) >> np.uint64(FIRST), np.arange(shards + 1, dtype=np.uint64))
            lines, ends = zip(*(block.lines(places[k : k + BLOCK], lengths[k : k + BLOCK]) for k in range(0, len(places), BLOCK)), strict=True)
            before = np.cumsum([0, *(len(x) for x in lines)])
            ends = np.concatenate([[0], *(e + b for e, b in zip(ends, before[:-1], strict=True))])
            data = np.concatenate(lines)
            there = np.flatnonzero(borders[1:] > borders[:-1])
            for shard, lo, hi, b, e in zip(there.tolist(), borders[there].tolist(), borders[there + 1].tolist(), ends[borders[there]].tolist(), ends[borders[there + 1]].tolist(), strict=True):
                held[shard].append((block.lang, keys[lo:hi], n[lo:hi], data[b:e]))
            size += len(data)
            if size >= HELD:
                yield packed([row(*x) for x in held.items()])
                held.clear()
                size = 0
        if rows := [row(*x) for x in held.items()] + [(zlib.crc32(lang.encode()) % shards, [lang], [0], n, 0, b"", b"", b"") for lang, n in words.items()]:
            yield packed(rows)

    return texts.mapInArrow(run, "shard int, langs array<string>, sizes array<long>, words long, bytes long, keys binary, counts binary, lines binary")


def compiled(listed: dict[str, list[str]]) -> dict[str, object]:
    """An automaton for the phrases of each language; those that the worker held go first."""
    import ahocorasick

    dropped()
    for lang, phrases in listed.items():
        automaton = _HELD[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(phrases):
            automaton.add_word(f"\n{phrase}\n", k)
        automaton.make_automaton()
    return _HELD


def scanned(lines: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, n: the phrases that occur `least` times, and of each language all words (phrase null). All lines of a phrase are in one partition."""

    def kept(rows: list[dict]) -> Iterator[tuple[str, str, np.ndarray]]:
        """Language, lines and numbers of the phrases whose hashes were met often enough."""
        sizes = [sum(r["sizes"]) for r in rows]
        keys = np.concatenate([np.cumsum(unplaned(r["keys"], n)) & np.uint64((1 << KEY) - 1) for r, n in zip(rows, sizes, strict=True)])
        counts = np.concatenate([unplaned(r["counts"], n) for r, n in zip(rows, sizes, strict=True)]).astype(np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keep = np.empty(len(keys), bool)
        keep[order] = np.repeat(np.add.reduceat(counts[order], first) >= least, np.diff(first, append=len(keys)))
        at = 0
        for r in rows:
            data = np.frombuffer(pa.decompress(r["lines"], r["bytes"], codec="zstd"), np.uint8)
            ends, begin = np.flatnonzero(data == 0x0A) + 1, 0
            for lang, n in zip(r["langs"], r["sizes"], strict=True):
                own = ends[:n] - begin
                if (may := keep[at : at + n]).any():
                    yield lang, data[begin : ends[n - 1]][np.repeat(may, np.diff(own, prepend=0))].tobytes().decode(), counts[at : at + n][may]
                at, begin, ends = at + n, ends[n - 1], ends[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = Counter(), []
        for batch in batches:
            for r in batch.to_pylist():
                if r["words"] is None:
                    rows.append(r)
                else:
                    words[r["langs"][0]] += r["words"]
        yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.nulls(len(words), pa.string()), pa.array([0] * len(words), pa.int32()), pa.array(words.values(), pa.int64())], names=["lang", "phrase", "words", "n"])
        if not rows:
            return
        texts, listed = list(kept(rows)), defaultdict(set)
        del rows
        for lang, text, _ in texts:
            listed[lang].update(text[:-1].split("\n"))
        listed = {lang: list(phrases) for lang, phrases in listed.items()}
        automata, sums = compiled(listed), {lang: np.zeros(len(phrases), np.int64) for lang, phrases in listed.items()}
        for lang, text, n in texts:
            np.add.at(sums[lang], np.fromiter(map(itemgetter(1), automata[lang].iter(f"\n{text}")), np.int64, len(n)), n)
        dropped()
        for lang, phrases in listed.items():
            found = np.flatnonzero(sums[lang] >= least)
            for at in np.array_split(found, -(-len(found) // BLOCK) or 1):
                out = pa.array([phrases[k] for k in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), out, pc.add(pc.count_substring(out, " "), pa.scalar(1, pa.int32())), pa.array(sums[lang][at])], names=["lang", "phrase", "words", "n"])

    return lines.mapInArrow(run, "lang string, phrase string, words int, n long")


def counted(docs: DataFrame, least: int = LEAST, shard: int = SHARD, log: int = LOG) -> DataFrame:
    """lang, phrase, words, n: exact counts of all words and phrases that occur `least` times, and of all words (words 0, phrase null)."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    texts = spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    pairs = triples = None
    if size * 2 // 6 < least << log:  # words and pairs, at six bytes a word: the counters' mean is under least
        few, send = texts.coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism), docs.sparkSession.sparkContext.broadcast
        pairs = send(sketch(few, lambda b: [b.h[0], b.h[1][b.inside[1]]], least, log))
        triples = send(sketch(few, lambda b: [b.h[2][passing(b, pairs.value)[2]]], least, log))
    # a word and what ends it have two bytes, and each begins three phrases at most: no more than `shard` phrases a shard are frequent, as hashes deal them
    shards = -(-size * WORDS // (2 * min(least, LEAST) * shard)) or 1
    return scanned(dealt(texts, shards, pairs, triples).repartitionById(shards, "shard"), least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, shard: int = SHARD, log: int = LOG) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts = written(counted(docs, least, shard, log), "phrase-counts")
    frequent = counts.filter("words > 0")
    words = F.split("phrase", " ")
    candidates = frequent.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    half = by_key(written(cuts, "cuts"), frequent.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    both = by_key(written(half, "half"), frequent.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    a, l, r = (f"cast({c} as decimal(19, 0))" for c in "alr")  # products have 38 digits
    scores = both.withColumn("score", F.expr(f"cast(1000000 as decimal(7, 0)) * {a} * {a} div ({l} * {r})"))
    # a score is at most 1000000, as neither part is rarer than the phrase: least score, then least cut, as one number
    own = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, WORDS) for c in "lr"]
    worst = scores.groupBy("lang", "phrase").agg(F.min(F.col("score").cast("long") * WORDS + F.col("k")).alias("least"), F.max("a").alias("a"), *own)
    worst = worst.select("lang", "phrase", "a", *(F.coalesce(*(F.when(F.col("least") % WORDS == k, F.col(f"{c}{k}")) for k in range(1, WORDS))).alias(c) for c in "lr"), F.expr(f"least div {WORDS}").alias("score"))
    longer = candidates.filter(F.size("w") > 2).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    covers = longer.groupBy("lang", F.array_join(F.slice("w", F.col("k"), 2), " ").alias("phrase")).agg(F.max("a").alias("most"))
    left = worst.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    near = left.withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS)))  # the first of a language are among the first of its parts
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(counts.filter("words = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = mark()
    out = written(collocations(table(spark, sf_dir, "documents")), "collocations")
    discarded(spark, start, keep=out)
    return out.withColumn("rank", F.col("rank").cast("long"))


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
g AS (SELECT lang, unnest([array_to_string(words[i:i + k - 1], ' ') FOR i IN range(1, len(words) - k + 2)]) AS phrase, k FROM w, (SELECT unnest([1, 2, 3])::INT AS k)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
s AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[:j], ' ') AS x, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2])::INT AS j) WHERE j < k),
e AS (SELECT s.lang, s.phrase, s.a, j, x.a AS l, y.a AS r, 1000000::HUGEINT * s.a * s.a // (x.a::HUGEINT * y.a) AS score FROM s JOIN f x ON x.lang = s.lang AND x.phrase = s.x JOIN f y ON y.lang = s.lang AND y.phrase = s.y),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, max(a) AS most, p AS phrase FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') FOR i IN [1, 2]]) AS p FROM c WHERE k = 3) GROUP BY lang, p),
v AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE NOT coalesce(100 * most >= 50 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v) JOIN n USING (lang) WHERE rank <= 2000
"""  # fmt: skip
