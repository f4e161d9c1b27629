"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Five filters fail a whole text: A, few words; B, few distinct words; C, many capitals; D, a forbidden
character; E, a smaller doc_id has the same text. Duplicates are found by partition refinement: classes of
equal code-point length are split by the hash of the first block of the text, then of the next, longer one,
and documents that are alone in their class are dropped on the way, so that only ids and hashes move. The
full texts of the classes that survive are compared, and all ids but the least are marked. From then on a
document is a mask of five bits: counts of masks for each part give all 120 orders.

A null text is an empty one. A null doc_id is neither smaller than another id nor has it a smaller one, so
E never fails it; rows that repeat the least id don't fail either. A null lang is the part ''. Repeated
labels of an id hold if one of them does. Texts are judged whole. An empty table has no parts and gives no
rows. Other columns are left out.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, discarded, mark, spread, table, written

FILTERS = "ABCDE"
#: First code points of the blocks; the last block goes on to the end of the text.
BLOCKS = (0, 64, 4096)
#: Bits of the fixed-size filter that keeps texts of unique documents from being moved (8 MB in all).
BITS = 1 << 26


def failures(text: Column) -> Column:
    """Filters A to D as bits 0 to 3."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # Counted together, so that the words are made once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(c: Column) -> Column:
        few = F.when(c["words"] < 200, 1).otherwise(0)
        alike = F.when(100 * c["distinct"] < 50 * c["words"], 2).otherwise(0)
        loud = F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0)
        odd = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
        return few + alike + loud + odd

    return F.transform(F.array(counts), bits)[0]


def block_hash(text: Column, k: int) -> Column:
    first = BLOCKS[k] + 1
    return F.xxhash64(F.substring(text, first, BLOCKS[k + 1] - BLOCKS[k]) if k + 1 < len(BLOCKS) else F.substr(text, F.lit(first)))


def classes(text: Column) -> list[Column]:
    """Class of a text by its length, then by each further block."""
    out = [F.length(text).cast("long")]
    for k in range(len(BLOCKS)):
        out.append(F.xxhash64(out[-1], block_hash(text, k)))
    return out


def _names() -> list[str]:
    return [f"class{k}" for k in range(len(BLOCKS) + 1)]


def refined(rows: DataFrame) -> DataFrame:
    """The rows whose class has company at every step: by length, then by each block."""
    for name in _names():
        counts = written(rows.groupBy(name).agg(F.count("*").alias("company")), "counts")
        rows = written(by_key(rows, counts.filter("company > 1").select(name), [name], counts), name)
    return rows


def possible(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key may be among keys, judged where they are; a few others pass, more as the bits fill up.

    Keys are bits modulo BITS in 4 KB maps, at most BITS / 32768 + 1 of them.
    """
    place = F.pmod(F.col(name), F.lit(BITS))
    held = keys.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__at"))
    maps = held.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    near = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__at", F.bitmap_bit_position(place)).join(F.broadcast(maps), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return near.filter(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1).drop("__bucket", "__at", "__bits")


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, lang, mask of those of rows (with the classes of their texts) whose text a smaller id in docs has."""
    last, text = _names()[-1], F.coalesce("text", F.lit(""))
    survivors = refined(rows)
    counts = written(survivors.groupBy(last).agg(F.count("*").alias("company")), "counts")
    near = docs.select("doc_id", "lang", text.alias("text"), classes(text)[-1].alias(last))
    same = by_key(possible(near, counts, last), counts.select(last), [last], counts)
    # A row a text, made in each task first: copies don't add up.
    texts = written(same.groupBy(last, "text").agg(F.min("doc_id").alias("first")), "texts")
    kinds = written(texts.groupBy(last).agg(F.count("*").alias("kinds"), F.min("first").alias("first")), "kinds")
    marked = by_key(survivors, kinds.filter("kinds = 1").select(last, "first"), [last], counts).filter("doc_id > first").select("doc_id", "lang", "mask")
    mixed = kinds.filter("kinds > 1").select(last)
    if mixed.isEmpty():
        return marked
    # Different texts in one class, which takes equal hashes of every block: told apart by the texts themselves.
    told = by_key(near, mixed, [last], counts).join(texts.join(mixed, last), [last, "text"]).filter("doc_id > first")
    return marked.unionByName(told.select("doc_id", "lang", failures(F.col("text")).alias("mask")))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mask, n: how many rows of this id and lang fail just the filters of the mask (bit 0 is A)."""
    text = F.coalesce("text", F.lit(""))
    whole = spread(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text"))
    rows = written(whole.select("doc_id", "lang", failures(text).alias("mask"), *[c.alias(n) for c, n in zip(classes(text), _names(), strict=True)]), "classes")
    twice = written(duplicates(docs.withColumn("lang", F.coalesce("lang", F.lit(""))), rows), "duplicates")
    # A duplicate leaves the count of its first mask and enters that of the mask with E.
    all_of = rows.select("doc_id", "lang", "mask", F.lit(1).alias("n")).unionByName(twice.withColumn("n", F.lit(-1))).unionByName(twice.withColumn("mask", F.col("mask") + 16).withColumn("n", F.lit(1)))
    return all_of.groupBy("doc_id", "lang", "mask").agg(F.sum("n").alias("n")).filter("n > 0")


def steps() -> list[dict]:
    """Every step of every order, with the masks that count in it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for k, own in enumerate(order):
            earlier, now = sum(1 << f for f in order[:k]), 1 << own
            fails = [m for m in range(1 << len(FILTERS)) if m & now]
            out.append({
                "filter_order": "".join(FILTERS[f] for f in order), "step": k + 1, "own": now, "removed": [m for m in fails if not m & earlier],
                "redundant": [m for m in fails if m & earlier], "kept": [m for m in range(1 << len(FILTERS)) if not m & (earlier | now)],
            })
    return out


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row a part, order and step."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = masks(docs).join(known, "doc_id", "left").withColumnRenamed("lang", "part")
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    names = ("n", "good", "toxic")
    # At most 32 masks a part.
    parts = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in names])
    parts = parts.select("part", *[F.expr(f"transform(sequence(0, 31), m -> coalesce(element_at({c}, m), 0L))").alias(c) for c in names])
    kind = "array<struct<filter_order:string,step:int,own:int,removed:array<int>,redundant:array<int>,kept:array<int>>>"
    each = parts.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps())), kind)))

    def total(of: str, which: str) -> Column:
        return F.expr(f"aggregate(s.{which}, 0L, (a, m) -> a + {of}[m])")

    # A mask of b failing filters is removed by each of them in 120 / b of the orders.
    shapley = F.expr("aggregate(sequence(1, 31), 0L, (a, m) -> a + if((m & s.own) = 0, 0L, n[m] * (120 div bit_count(m))))")
    return each.select(
        "part", "s.filter_order", "s.step", total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"),
        F.col("n")[F.col("s.own")].alias("unique_fails"), total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"), shapley.alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = mark()
    out = written(audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "audit")
    discarded(spark, start, keep=out)
    return out


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, [ascii(x) - 64 FOR x IN string_split(filter_order[1:step - 1], '') IF x <> ''] AS earlier
  FROM o, (SELECT unnest(range(1, 6))::INT AS step) WHERE length(filter_order) = 5),
j AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[ascii(letter) - 64] AS now, len([e FOR e IN earlier IF fails[e]]) > 0 AS before, len([x FOR x IN fails IF x]) AS failing FROM c, s),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT now AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN now AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN now AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN now AND failing = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN now AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN now AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""  # fmt: skip
