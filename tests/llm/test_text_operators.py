"""Piece encoding, the filter audit and collocations against brute force, and the cases that their docstrings state."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quarry.llm import audit, collocations, common, pieces

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class0 string, words string, n string"
TEXTS = [None, "", " \n ", "one two three. one two three, one two", "ONE two\tthree  one two\nthree", "É été là" * 30, "x" * 60_000, "a b " * 30_000, "same text here", "same text here", "$ & money", "▁ ▁x  y", "日本 語\0!"]


def rows(texts=TEXTS, langs=("en", None, "", "und", "de")):
    return [(None if k == 5 else k // 2 * 2, t, langs[k % len(langs)], None, None, "x", "y", "z") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 1), (2, None, None), (8, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


# 11: SentencePiece


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.model_path())


def test_agendas_equal_the_library(own):
    rng = random.Random(11)
    parts = [*"abcdehimnorst", " ", "  ", "\n", "\t", "▁", "é", "日", "中", "\U0001f4a5", "\0", "ﬁ", "　", "0", ".", "the", "ing", " <s>", "</s>", "<0x41>", "ا", "aaaa", "▁▁"]
    texts = ["", " ", "▁", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000))]
    ids = own.encode(texts)
    assert ids == own.library.encode(texts, add_eos=True)
    assert [own.decode(x) for x in ids] == [own.library.decode(x) for x in ids]
    segments = ["▁" + t.replace(" ", "▁") for t in texts[3:500]]
    assert own.merged_together(segments) == [own.merged(s) for s in segments]  # side by side or in a heap
    wild = [rng.randrange(32_000) for _ in range(300)]
    assert own.decode(wild).startswith(own.library.decode(wild)[:1])


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    texts = [f"word{k} and other{k % 7} words" for k in range(200)]
    for k in range(0, 200, 10):
        assert own.encode(texts[k : k + 10]) == own.library.encode(texts[k : k + 10], add_eos=True)


def test_a_difference_ends_the_job(own, monkeypatch):
    monkeypatch.setattr(own, "known", {})
    monkeypatch.setattr(own, "older", {})
    monkeypatch.setattr(own, "merged_together", lambda segments: [(5,) for _ in segments])
    with pytest.raises(AssertionError, match="differ"):
        own.encode(["some text"])


@pytest.mark.parametrize("which", ["odd", "table", "empty"])
def test_pieces_of_whole_texts(spark, odd, own, which):
    docs = {"odd": odd, "table": spark.read.parquet(f"{SF}/documents.parquet"), "empty": odd.limit(0)}[which]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = own.library.encode(r.text or "", add_eos=True)
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(own.library.decode(ids))] += 1
    assert got == want
    if which == "odd":
        assert {tuple(r.ids) for r in pieces.coded(docs).filter("text = ''").collect()} == {(2,)}


# 12: filter audit


def brute_audit(docs, labels):
    first, out = {}, {}
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in docs.collect()]
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text] = min(first.get(text, doc_id), doc_id)
    good, toxic = ({r.doc_id for r in labels.collect() if r[k] == 1} - {None} for k in ("quality", "toxic"))
    for doc_id, text, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and first[text] < doc_id}
        bad = {f for f in bad if bad[f]}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                c = out.setdefault((part, order, k + 1), Counter())
                before = bad & set(order[:k])
                c["kept"] += not (bad & set(order[: k + 1]))
                removed = f in bad and not before
                c["removed"] += removed
                c["redundant"] += f in bad and bool(before)
                c["unique_fails"] += bad == {f}
                c["good_lost"] += removed and doc_id in good
                c["toxic_lost"] += removed and doc_id in toxic
    shapley = Counter()
    for (part, order, k), c in out.items():
        shapley[part, order[k - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {key: (*(c[n] for n in names), shapley[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def audited(docs, labels):
    got = audit.audited(docs, labels).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


def test_audit_brute_force(odd, labels):
    assert audited(odd, labels) == brute_audit(odd, labels)
    assert audit.audited(odd.limit(0), labels).count() == 0


def test_audit_equal_hashes_and_hot_texts(spark, labels, monkeypatch):
    """Texts that share all hashes are told apart by their characters; a third of the rows are copies."""
    texts = [random.Random(k % 40).choice("abc") * 5 + str(k % 9) for k in range(200)] + ["copy of one text"] * 100 + [None] * 3
    docs = spark.createDataFrame(rows(texts, ("en",)), DOCS)
    want = brute_audit(docs, labels)
    assert audited(docs, labels) == want
    from pyspark.sql import functions as F

    monkeypatch.setattr(audit, "block_hash", lambda text, k: F.length(text))
    assert audited(docs, labels) == want
    monkeypatch.setattr(common, "HOT", 3)
    assert audited(docs, labels) == want


def test_blocks_drop_singletons(spark):
    long = "p" * 5000
    texts = [long + "1", long + "2", "q" + long[1:] + "1", "short", "other", long + "1"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    from pyspark.sql import functions as F

    at = docs.select("doc_id", F.lit("en").alias("lang"), F.lit(0).alias("mask"), *[c.alias(f"class{k}") for k, c in enumerate(audit.classes(F.col("text")))])
    assert sorted(r.doc_id for r in audit.refined(at).collect()) == [0, 5]


# 13: collocations


def brute_collocations(docs, least=10, top=2000, cover=50):
    f, n = defaultdict(Counter), Counter()
    for r in docs.collect():
        lang, text = "und" if r.lang is None else r.lang, (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= cover * a and len(q) > len(p) and p in (q[:2], q[1:]) for q, b in cand.items()):
                continue
            score, _, left, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, r))
        out |= {(lang, rank, p.decode(), -a, left, r, n[lang], -score) for rank, (score, a, p, left, r) in enumerate(sorted(found)[:top], 1)}
    return out


def mined(docs, **options):
    got = collocations.collocations(docs, **options).collect()
    out = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(13)
    words = ["the", "of", "new", "york", "city", "é", "The", "a", "a", "İx", "x\x1cy", "z z"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", " ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + TEXTS
    return spark.createDataFrame(rows(texts), DOCS).cache()


@pytest.mark.parametrize("shard", [1_000_000, 60])
def test_collocations_brute_force(phrases, shard):
    assert mined(phrases, shard=shard, log=18) == brute_collocations(phrases)


def test_collocations_other_thresholds(phrases):
    """Nearly everything passes a sketch of so few counters; results stay exact."""
    assert mined(phrases, least=2, top=20, cover=90, log=15) == brute_collocations(phrases, 2, 20, 90)
    assert collocations.collocations(phrases.limit(0), log=15).count() == 0


@pytest.mark.parametrize("log", [18, 10])
def test_texts_are_read_for_no_shard(phrases, spark, tmp_path, log):
    """More shards of phrases don't mean more passes over the texts, with sketches or where those would be full."""
    phrases.write.parquet(f"{tmp_path}/docs")
    read, mined_by = spark.sparkContext.accumulator(0), {}

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    for shard in (1_000_000, 600):
        before = read.value
        docs = spark.read.parquet(f"{tmp_path}/docs").mapInArrow(counted, phrases.schema)
        mined_by[shard] = mined(docs, shard=shard, log=log), read.value - before
    assert mined_by[1_000_000] == mined_by[600]
    assert mined_by[600][0] == brute_collocations(phrases)


def test_full_sketches_are_left_out(phrases, monkeypatch):
    """Counters that most hashes share would rule out nothing."""
    monkeypatch.setattr(collocations, "sketch", lambda *a: pytest.fail("a full sketch"))
    assert mined(phrases, log=10) == brute_collocations(phrases)


def test_dealt_lines(spark, monkeypatch):
    """A task that passes on little at a time loses no line; every phrase is in one shard, with the number of its occurrences; numbers and planes are inverse."""
    monkeypatch.setattr(collocations, "DEALT", 40)
    monkeypatch.setattr(collocations, "HELD", 10)
    monkeypatch.setattr(collocations, "BLOCK", 3)
    x = np.array([0, 1, 255, 256, 1 << 40, (1 << 64) - 1], np.uint64)
    assert collocations.unplaned(collocations.planed(x), 6).tolist() == x.tolist()
    block = collocations.Block("en", ["a\t bb  É. c", "bb É"])
    lines, ends = block.lines(np.array([0, 1, 3]), np.array([3, 1, 1]))
    assert (lines.tobytes().decode(), ends.tolist()) == ("a bb É\nbb\nc\n", [8, 11, 13])

    class Texts:
        def mapInArrow(self, f, schema):
            self.run = f
            return self

    texts = ["a b c. a b c", "a b", "", "c. É b\tc"] * 5
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 10, "text": texts})
    rows = list(collocations.dealt(Texts(), 7, None, None).run(iter([batch])))
    assert len(rows) > 2 and all(0 <= k < 7 for b in rows for k in b.column("shard").to_pylist())
    found, shards = [], defaultdict(set)
    for k in range(7):
        own = (b.filter(pc.equal(b.column("shard"), k)) for b in rows)
        for r in (r for b in collocations.scanned(Texts(), 1).run(own) for r in b.to_pylist()):
            found.append((r["lang"], r["phrase"], r["words"], r["n"]))
            shards[r["lang"], r["phrase"]].add(k)
    want = Counter()
    for lang, text in zip(["en", "de"] * 10, texts, strict=True):
        for piece in text.split("."):
            words = piece.split()
            want.update((lang, " ".join(words[i : i + k]), k) for k in (1, 2, 3) for i in range(len(words) - k + 1))
            want[lang, None, 0] += len(words)
    assert sorted(found, key=str) == sorted(((*k, n) for k, n in want.items()), key=str)
    assert all(len(x) == 1 for x in shards.values())


def test_sketch_counters():
    """Counters of one byte stop at the top and count every repeat below it."""
    rng = np.random.default_rng(13)
    counters, own = np.zeros(64, np.uint8), np.zeros(64, np.int64)
    for n in (0, 1, 40, 7, 5000):
        at = rng.integers(0, 60, n)
        collocations.added(counters, at, 10)
        own += np.bincount(at, minlength=64)
        assert counters.tolist() == np.minimum(own, 10).tolist()


def test_met_is_never_wrong():
    """A hash that was not met is always new, whatever has no room; where there is room, one that was met is not new again."""
    rng = np.random.default_rng(13)
    small, large, known = collocations.Met(4), collocations.Met(16), set()
    for _ in range(20):
        h = np.unique(np.concatenate(([0], rng.integers(0, 1 << 63, 30, np.uint64) * np.uint64(2) + np.uint64(1))).astype(np.uint64))
        unmet = np.array([x not in known or x == 0 for x in h.tolist()])
        assert (small.new(h) | ~unmet).all() and (large.new(h) | ~unmet).all()
        again = large.new(h)
        assert again[0] and again.sum() <= 3
        known.update(h.tolist())


def test_tasks_of_collocations(spark, monkeypatch):
    """Sketches and lists are sent by a bounded number of tasks, so that their shuffles don't grow with the number of a table's files."""
    seen = []
    whole = collocations.sketch
    monkeypatch.setattr(collocations, "sketch", lambda texts, *a: seen.append(texts.rdd.getNumPartitions()) or whole(texts, *a))
    tasks = collocations.TASKS * spark.sparkContext.defaultParallelism
    docs = spark.createDataFrame(rows(["new york city"] * 40, ("en",)), DOCS).repartition(3 * tasks)
    assert {r.phrase: r.a for r in collocations.collocations(docs, log=15).collect()} == {"new york city": 40}
    assert seen == [tasks, tasks]


def test_sketch_drops_automata():
    """A worker that begins a sketch lets go of an earlier table's automata, also when the task was sent by value."""
    from pyspark import cloudpickle

    class Sent(Exception):
        pass

    class Texts:
        def mapInArrow(self, f, schema):
            raise Sent(f)

    with pytest.raises(Sent) as sent:
        collocations.sketch(Texts(), lambda b: [], 10, 15)
    collocations._HELD["shard"] = ({}, None)
    list(cloudpickle.loads(cloudpickle.dumps(sent.value.args[0]))(iter([])))
    assert not collocations._HELD


def test_long_words_and_texts(monkeypatch):
    monkeypatch.setattr(collocations, "SPAN", 64)
    data = ["a " * 100 + "w" * 200 + " b. c " + "w" * 200, "v" * 64 + " " + "w" * 200, "é" * 90]
    block = collocations.Block("en", data)
    words = [w for t in data for p in t.split(".") for w in p.split()]
    assert block.phrases(np.arange(len(words)), 1) == words
    same = defaultdict(set)
    for w, h in zip(words, block.h[0].tolist(), strict=True):
        same[w].add(h)
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


def test_large_counts_are_exact(spark):
    db = duckdb.connect()
    for a, left, r in [(10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 3), (10, 10, 10), (4 * 10**15, 4 * 10**15 + 1, 9 * 10**15)]:
        got = spark.sql(f"select cast(1000000 as decimal(7, 0)) * cast({a}L as decimal(19, 0)) * cast({a}L as decimal(19, 0)) div (cast({left}L as decimal(19, 0)) * cast({r}L as decimal(19, 0))) as s").first()["s"]
        assert got == 10**6 * a * a // (left * r)
    db.close()
