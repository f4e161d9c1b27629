"""Lexical search: postings, BM25 and match expressions.

Postings are one row a term and chunk: the term's positions, the chunk's length, and whether it is active.
They are made inside the chunk's row and written once, in folders by a hash of the term's first characters,
sorted by term, so that a query reads only its terms' folders and row groups; all terms of a prefix of LEAD
characters or more are in one folder. A query gathers the postings of a chunk by one
exchange and judges phrases, proximity and the whole expression inside the row. Totals (chunks and tokens,
active or not) come with the index; inactive chunks are dropped after scoring. Chunks without an index are
searched in one pass, which makes postings of the asked terms alone (`asked`).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lookup import winners
from .match import Expression, MatchError, Pair, Phrase, expression, words_of

K1, B = 1.2, 0.75
#: Positions in the text column start here, so that no phrase spans title and text.
TEXT_AT = 1 << 24
SNIPPET_WORDS = 8
#: Folders of written postings, and how many chunk ids in a row share a file of each: a frequent term is in many files.
BUCKETS, IDS_A_FILE = 32, 1 << 22
#: Characters of a term that its folder depends on; shorter prefixes are looked for in all folders.
LEAD = 3
POSTINGS = "term string, chunk_id long, positions array<int>, len int, active boolean"
_ROWS = 256


@dataclass(frozen=True)
class Totals:
    """How many chunks there are, active or not, and how many tokens in them."""

    chunks: int = 0
    tokens: int = 0

    def __add__(self, other: Totals) -> Totals:
        return Totals(self.chunks + other.chunks, self.tokens + other.tokens)

    def __sub__(self, other: Totals) -> Totals:
        return Totals(self.chunks - other.chunks, self.tokens - other.tokens)


def postings(chunks: DataFrame, *carried: str) -> DataFrame:
    """term, chunk_id, positions, len, active, and columns of the chunk that are carried along. Grouped inside each row, without an exchange."""
    return _postings(chunks, carried, enumerate)


def asked(chunks: DataFrame, *texts: str | Expression) -> DataFrame:
    """Postings of the terms of these texts alone, for a search in chunks that have no index: `matched` finds the same in them.

    One pass over the chunks, which are all read, without an exchange; every chunk also has a row of the empty
    term, without positions, so that its length is known (`totals_of_asked`).
    """
    slots = slots_of(phrases_of(read_all(texts)))
    exact, prefixes = frozenset(w for w, prefix in slots if not prefix), tuple(w for w, prefix in slots if prefix)

    def wanted(words: list[str], start: int = 0) -> list[tuple[int, str]]:
        if not prefixes and exact.isdisjoint(words):  # most chunks
            return []
        return [(k, w) for k, w in enumerate(words, start) if w in exact or w.startswith(prefixes)]

    return _postings(chunks, (), wanted, lengths=True)


def _postings(chunks: DataFrame, carried: Sequence[str], wanted: Callable[..., Iterable[tuple[int, str]]], lengths: bool = False) -> DataFrame:
    """wanted: of a list of words, those that get postings, with their place, from the first one's place on."""
    types = {f.name: f.dataType.simpleString() for f in chunks.select(*carried).schema} if carried else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                terms, counts, flat, ends = [], [], [], [0]
                for title, text in zip(part.column("title").to_pylist(), part.column("text").to_pylist(), strict=True):
                    places = defaultdict(list)
                    a, b = words_of(title or ""), words_of(text or "")
                    if lengths:
                        places[""] = []
                    for k, t in wanted(a):
                        places[t].append(k)
                    for k, t in wanted(b, TEXT_AT):
                        places[t].append(k)
                    terms += places
                    counts.append((len(places), len(a) + len(b)))
                    for p in places.values():
                        flat += p
                        ends.append(len(flat))
                row = pa.array([k for k, (n, _) in enumerate(counts) for _ in range(n)], pa.int32())
                lens = pa.array([n for _, n in counts], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), part.column("id").take(row), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), lens.take(row), part.column("active").take(row)]
                    + [part.column(c).take(row) for c in carried],
                    names=["term", "chunk_id", "positions", "len", "active", *carried],
                )

    return chunks.select("id", "title", "text", "active", *carried).mapInArrow(run, ", ".join([POSTINGS, *(f"{c} {t}" for c, t in types.items())]))


def totals(chunks: DataFrame, index: DataFrame) -> Totals:
    """Counted from whole tables; a store keeps them instead. Every token is one position."""
    return Totals(chunks.count(), index.agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0])


def totals_of_asked(index: DataFrame) -> Totals:
    return Totals(*index.filter("term = ''").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first())


def bucket(term: str) -> int:
    return zlib.crc32(term[:LEAD].encode()) % BUCKETS


def dealt(index: DataFrame) -> DataFrame:
    """postings with their bucket, dealt out and sorted as they are written: `.write.partitionBy("bucket")`."""
    file = F.floor(F.col("chunk_id") / IDS_A_FILE)
    return index.withColumn("bucket", (F.crc32(F.substring("term", 1, LEAD).cast("binary")) % BUCKETS).cast("int")).repartition("bucket", file).sortWithinPartitions("bucket", "term", "chunk_id")


def term_statistics(index: DataFrame) -> DataFrame:
    """term, df, tf."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"))


def counted(chunks: DataFrame) -> DataFrame:
    """term_statistics of chunks that have no postings yet: summed up batch by batch, so that no posting is made or moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df, tf = Counter(), Counter()
            for title, text in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(title or "") + words_of(text or "")
                tf.update(words)
                df.update(set(words))
            yield pa.RecordBatch.from_arrays([pa.array(list(tf), pa.string()), pa.array([df[t] for t in tf], pa.int64()), pa.array(list(tf.values()), pa.int64())], names=["term", "df", "tf"])

    found = chunks.select("title", "text").mapInArrow(run, "term string, df long, tf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def dictionary(index: DataFrame) -> DataFrame:
    """term_statistics as they are written beside the postings."""
    return as_dictionary(term_statistics(index))


def as_dictionary(statistics: DataFrame) -> DataFrame:
    """Statistics in ranges of terms, sorted, so that a term or a prefix is in a few row groups."""
    return statistics.repartitionByRange("term").sortWithinPartitions("term")


def terms_of(terms: DataFrame, prefix: str) -> DataFrame:
    """The dictionary's entries that begin with prefix: a pushed filter on sorted files."""
    return terms.filter(F.col("term").startswith(prefix))


def bm25(f: Column, n: Column, total: Column, length: Column, mean: Column) -> Column:
    """The weight of one phrase in one chunk; lower is better."""
    idf = F.log((total - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def read_all(texts: Sequence[str | Expression]) -> list[Expression | None]:
    """Expressions of texts; None where a text is none."""
    out: list[Expression | None] = []
    for t in texts:
        try:
            out.append(expression(t) if isinstance(t, str) else t)
        except MatchError:
            out.append(None)
    return out


def phrases_of(queries: Sequence[Expression | None]) -> list[Phrase]:
    return list(dict.fromkeys(p for q in queries if q for leaf in q.leaves() for p in leaf.phrases))


def slots_of(phrases: Sequence[Phrase]) -> list[tuple[str, bool]]:
    """The words of phrases, and whether they are prefixes."""
    return list(dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)))


def matched(index: DataFrame, total: Totals, *texts: str | Expression) -> DataFrame:
    """query (the text's number), chunk_id, active, score of all chunks that match; a text that is no expression matches nothing."""
    queries = read_all(texts)
    leaves = [leaf for q in queries if q for leaf in q.leaves()]
    phrases = phrases_of(queries)
    slots = slots_of(phrases)
    if not slots:
        return index.limit(0).select(F.lit(0).alias("query"), "chunk_id", "active", F.lit(0.0).alias("score"))
    is_slot = [F.col("term").startswith(w) if prefix else F.col("term") == w for w, prefix in slots]
    wanted = F.col("term").isin(list({w for w, prefix in slots if not prefix}))
    for w in {w for w, prefix in slots if prefix}:
        wanted |= F.col("term").startswith(w)
    index = index.filter(wanted)
    if "bucket" in index.columns and all(len(w) >= LEAD for w, prefix in slots if prefix):
        index = index.filter(F.col("bucket").isin(sorted({bucket(w) for w, _ in slots})))
    mine = [F.flatten(F.collect_list(F.when(here, F.col("positions")))).alias(f"s{k}") for k, here in enumerate(is_slot)]
    rows = index.groupBy("chunk_id").agg(F.first("active").alias("active"), F.first("len").alias("len"), *mine)
    rows = rows.withColumns({f"p{k}": starts(p, [F.col(f"s{slots.index((w, p.prefix and i == len(p.words) - 1))}") for i, w in enumerate(p.words)]) for k, p in enumerate(phrases)})
    found = rows.agg(*[F.count_if(F.size(f"p{k}") > 0).alias(f"n{k}") for k in range(len(phrases))]).first()  # one row
    mean = F.lit(total.tokens / total.chunks if total.tokens else 1.0)

    def of_leaf(leaf: Expression) -> list[tuple[int, Column]]:
        """Its phrases, and how often each counts here."""
        at = [phrases.index(p) for p in leaf.phrases]
        places = [F.col(f"p{k}") for k in at]
        return list(zip(at, [F.size(x) for x in (close(places, leaf) if len(at) > 1 else places)], strict=True))

    named = {leaf: of_leaf(leaf) for leaf in dict.fromkeys(leaves)}
    rows = rows.withColumns({f"f{i}_{j}": f for i, parts in enumerate(named.values()) for j, (_, f) in enumerate(parts)})
    number = {leaf: i for i, leaf in enumerate(named)}

    def holds(e: Expression) -> Column:
        if not isinstance(e, Pair):
            return F.col(f"f{number[e]}_0") > 0
        left, right = holds(e.left), holds(e.right)
        return left | right if e.op == "or" else left & right if e.op == "and" else left & ~right

    def score(e: Expression) -> Column:
        """A leaf counts where all that it is a part of holds, and what NOT leaves out doesn't."""
        if isinstance(e, Pair):
            both = score(e.left) if e.op == "not" else score(e.left) + score(e.right)
            return both if e.op == "or" else F.when(holds(e), both).otherwise(0.0)
        out = F.lit(0.0)
        for j, (k, _) in enumerate(named[e]):
            f = F.col(f"f{number[e]}_{j}")
            out += F.when(f > 0, bm25(f, F.lit(found[f"n{k}"]), F.lit(total.chunks), F.col("len"), mean)).otherwise(0.0)
        return out

    hits = [F.when(holds(q), F.struct(F.lit(i).alias("query"), score(q).alias("score"))) for i, q in enumerate(queries) if q]
    out = rows.select("chunk_id", "active", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return out.select("hit.query", "chunk_id", "active", "hit.score")


def moved_back(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def before(places: Column, last: Column, room: int) -> Column:
    """The places at most so far before the last one, itself included."""
    return F.filter(places, lambda x: (x <= last) & (x >= last - room))


def in_clump(places: Column, ends: Column, room: int) -> Column:
    return F.filter(places, lambda x: F.exists(ends, lambda last: (x <= last) & (x >= last - room)))


def starts(phrase, places: list[Column]) -> Column:
    """Where the phrase starts, from the places of its words."""
    out = places[0] if places else F.array().cast("array<int>")
    for k, p in enumerate(places[1:], 1):
        out = F.array_intersect(out, moved_back(p, k))
    if phrase.column:
        out = F.filter(out, lambda x: x >= TEXT_AT if phrase.column == "text" else x < TEXT_AT)
    if phrase.first:
        out = F.filter(out, lambda x: x.isin(0, TEXT_AT))
    return out


def close(places: list[Column], near) -> list[Column]:
    """Of each phrase the places in a clump: all phrases start at most distance words, and their own length, before its last start."""
    room = [near.distance + len(p.words) for p in near.phrases]

    def around(last: Column) -> Column:
        out = F.lit(True)
        for p, r in zip(places, room, strict=True):
            out &= F.size(before(p, last, r)) > 0
        return out

    ends = F.filter(F.array_distinct(F.concat(*places)), around)
    return [in_clump(p, ends, r) for p, r in zip(places, room, strict=True)]


def snippet(text: Column, words: Column) -> Column:
    """The SNIPPET_WORDS-word window that holds most of the words, the first among equals, with an ellipsis where it cuts."""
    n = F.lit(SNIPPET_WORDS)

    def of(all_words: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(all_words) - n)
        marks = F.filter(F.transform(all_words, lambda w, i: F.when(F.exists(S.tokens(w), lambda t: F.array_contains(words, t)), i)), lambda i: i.isNotNull())

        def best(at: Column) -> Column:
            # A best window starts at a hit, or as far right as the text allows.
            windows = F.transform(at, lambda i: F.struct(F.size(F.filter(at, lambda j: (j >= F.least(i, last)) & (j < F.least(i, last) + n))).alias("n"), (-F.least(i, last)).alias("at")))
            return F.when(F.size(at) > 0, -F.array_max(windows)["at"]).otherwise(0)

        def cut(at: Column) -> Column:
            body = F.array_join(F.slice(all_words, at + 1, n), " ")
            return F.concat(F.when(at > 0, "...").otherwise(""), body, F.when(at < last, "...").otherwise(""))

        return S.let(S.let(marks, best), cut)

    return S.let(F.regexp_extract_all(S.plain_spaces(text), F.lit(S.WORD), F.lit(0)), of)


def marked_words(texts: Sequence[str | Expression]) -> Column:
    """For each text the words that its snippets show: an array of arrays."""
    named = [sorted({w for leaf in q.leaves() for p in leaf.phrases for w in p.words}) if q else [] for q in read_all(texts)]
    return F.array(*[F.array(*map(F.lit, ws)).cast("array<string>") for ws in named])


def lexical_search(chunks: DataFrame, index: DataFrame, total: Totals, *texts: str | Expression, limit: int = 20) -> DataFrame:
    """The best active chunks for each match expression, with their rank from 1.

    Only the winners, at most limit a text, meet the chunk table.
    """
    order = W.partitionBy("query").orderBy("score", "chunk_id")
    best = matched(index, total, *texts).filter("active").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("active")
    rows = winners(chunks, best)
    words = F.get(marked_words(texts), F.col("query"))
    return rows.select("query", "rank", "chunk_id", "source_path", "source_kind", "title", snippet(F.col("text"), words).alias("snippet"), "score", F.lit("fts").alias("rank_source"), "metadata")
