"""Each operator against a brute-force twin, and the cases that its docstring states."""

import gzip
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import fingerprint, language_id, mixing, neighbours, packing, quality, registry, sharding, simhash, url_filter, vectext, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n ", "en", None, 4), (4, "x" * 300_000, "en", "a", 1), (5, "one two " * 40_000, "en", "b", 1),
    (6, "the same text of words", "en", "b", 1), (6, "the same text of words", "en", "b", 1), (7, "the same text of words", "de", "b", 1), (None, "no id here", "en", "c", 1),
    (8, "İstanbul é 日本 <|endoftext|> '%%%'", None, "\U0001f600", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    rel = db.sql(registry.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = Counter(tuple(norm(r[c]) for c in cols) for r in got.collect())
    assert mine == Counter(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())


def test_bit_votes_and_hashes():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    assert vectext.bit_votes(h).tolist() == [sum(int(x) >> i & 1 for x in h) for i in range(64)]
    assert (vectext.bit_votes(h.reshape(7, 100))[3] == vectext.bit_votes(h[300:400])).all()
    b = np.frombuffer(b"abc abc abd", np.uint8)
    x = vectext.run_hashes(b, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert x[0] == x[1] != x[2]
    assert b"".join(vectext.chunks(b"ab " * 800_000)) == b"ab " * 800_000


# 1: URL filter


def test_url_filter_brute_force(spark):
    rng = random.Random(1)
    hosts = ["net", "a.net", "xnet", "example.net", "m.example.net", "EXAMPLE.com", "b.example.com", "notexample.com", "org", "x.org", "net.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/de/2?x=/fr/", "/fr/#a", "/fr/x", "?q", "#f", "/a/net/"]
    urls = [rng.choice(["http://", "https://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "net/", "http://" + "a." * 3000 + "net/"]

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert url_filter.judged(df.limit(0)).count() == 0


def test_url_filter_wildcards():
    rules = (url_filter.Rule("a*.com/x/", "block"), url_filter.Rule("b.com/**/deep", "block"))
    got = url_filter.ShiftAnd(rules).match([b"abc.com/x/1", b"a/.com/x/", b"z.a.com/x/", b"b.com/1/2/deep", b"b.com/deep", b""])
    assert got.tolist() == [0, -1, 0, 1, -1, -1]
    many = tuple(url_filter.Rule(f"host{k}.example/p{k}/", "block") for k in range(40))  # over many words
    assert url_filter.ShiftAnd(many).match([f"www.host{k}.example/p{k}/".encode() for k in range(40)]).tolist() == list(range(40))


# 2: neighbours


def test_neighbours_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    m = np.array([r[0] for r in df.orderBy("vec_id").select("embedding").collect()], float)
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        assert abs(r["score"] - m[r["query_id"]] @ m[r["vec_id"]]) < 1e-9
        got[r["query_id"]].append(r["vec_id"])
    scores = m[::20] @ m.T
    scores[np.arange(len(scores)), np.arange(0, len(m), 20)] = -9
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(got[20 * k]) & set(b.tolist())) / 20 for k, b in enumerate(best)]) >= 0.9
    assert sorted(got) == list(range(0, len(m), 20))


def test_neighbours_odd_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 3)  # the common vector's bucket becomes a grid
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(30)] + [(30, None), (31, [0.0] * 3), (32, [float("nan"), 1.0, 1.0]), (33, [None, 1.0, 1.0]), (34, [float("inf"), 0.0, 0.0]), (35, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, dim=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, k) for k in range(1, 21)] + [(20, k) for k in range(20)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_without_ids(spark):
    """Rows without an id are no queries and no candidates; a table of nothing else gives nothing."""
    df = spark.createDataFrame([(None, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.9, 0.0]), (None, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert neighbours.nearest(df.filter("vec_id is null"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_several_hashes(spark):
    """Groups of 20 near vectors: two hashes a table find them and score few others."""
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(100, 48)), 20, axis=0)
    m += 0.25 * rng.normal(size=m.shape)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10, tables=10, probes=24, hashes=2, last=16).collect()
    scores = m[::20] @ m.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    best = {(20 * q, int(v)) for q, row in enumerate(np.argsort(-scores, axis=1)[:, :10]) for v in row}
    assert len(best & {(r.query_id, r.vec_id) for r in got}) / len(best) >= 0.9
    hashing = neighbours.CrossPolytope(48, 10, 2, 16)
    assert hashing.buckets == 128 * 32
    own, probed = hashing.nearest(m, 1)[:, :, 0], hashing.nearest(m[::20], 24)
    scored = np.mean([(own[t][None, :, None] == probed[t][:, None, :]).any(axis=2).mean() for t in range(10)])
    assert scored < 0.1
    with pytest.raises(ValueError):
        neighbours.CrossPolytope(1024, 10, 2)


def test_buckets_by_cost():
    """The probed buckets are those that cost least of all, by brute force."""
    x = np.random.default_rng(6).normal(size=(5, 4))
    hashing = neighbours.CrossPolytope(4, 1, 2)
    y = hashing.rotations(x)
    near = np.concatenate((y, -y), axis=2)
    own = (near.max(axis=2, keepdims=True) - near) ** 2
    for row, got in enumerate(hashing.nearest(x, 6)[0]):
        cost = (own[0, row][:, None] + own[1, row][None, :]).reshape(-1)
        assert set(got.tolist()) == set(np.argsort(cost)[:6].tolist())


def test_neighbours_small_table_and_length(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(15)]
    df = spark.createDataFrame([(99, [1.0, 2.0]), *rows], "vec_id long, embedding array<float>").coalesce(1)
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    want = {q: [int(i) for i in np.argsort(-(x @ x[q])) if i != q] for q in range(15)}
    print(sum(map(len, got.values())), "of", 15 * 14, "neighbours")
    assert got == want


# 3: SimHash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(prints, near):
    """prints: id to print; near tells whether two link."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(prints[a], prints[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("cell", [1024, 4])
def test_simhash_brute_force(spark, docs, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 12
    rng, extra = random.Random(3), []
    for k in range(60):
        words = base.split()
        words[rng.randrange(len(words))] = f"w{k}"
        extra.append((10_000 + k, " ".join(words)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*extra, (20_000, None), (20_001, "   ")], "doc_id long, text string"))
    prints = {r.doc_id: brute_print(r.text) for r in df.collect()}
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.linked(df).collect()}
    assert got == {k: (f"{prints[k]:016x}", roots[k]) for k in prints}
    assert len({roots[10_000 + k] for k in range(60)}) < 60


def test_simhash_odd(odd, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.linked(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)} <= got
    assert simhash.linked(odd).count() == len(ODD)
    assert simhash.linked(empty).count() == 0


def test_deduplicated_planted_copies(spark, docs):
    rng = random.Random(5)
    long = [r for r in docs.collect() if r.text and 150 < len(r.text.split()) < 600][:40]
    rows = []
    for k, r in enumerate(long):
        words = r.text.split()
        for c in range(3):
            w = list(words)
            for i in rng.sample(range(len(w)), max(1, len(w) // 60)):
                w[i] = f"changed{c}x{i}"
            rows.append((50_000 + 10 * k + c, " ".join(w) if c else r.text, r.lang, r.source, 1))
    df = docs.union(spark.createDataFrame(rows, DOCS))
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert not kept & {50_000 + 10 * k for k in range(len(long))}  # exact copies
    texts = {r.doc_id: r.text for r in docs.collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def alike(a, b):
        return len(a & b) / len(a | b)

    near = [i for i, t, *_ in rows if i % 10 and alike(shingles(t), shingles(long[(i - 50_000) // 10].text)) >= 0.8]
    assert len(near) > 60 and len(kept & set(near)) <= 0.03 * len(near)
    sets = {k: shingles(t) for k, t in texts.items()}
    gone = set(texts) - kept
    for g in gone:  # nothing goes without something alike
        assert max(alike(sets[g], sets[k]) for k in texts if k != g) > 0.7
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_deduplicated_odd(odd):
    got = simhash.deduplicated(odd).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 4, 5, 6, 8]
    assert len(got) == 6


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def passage_edits(words, new, share):
    """The text with a passage of so large a share of its words appended, cut off at either end, or replaced."""
    n = int(len(words) * share)
    return [words + new[:n], new[:n] + words, words[n:], words[: len(words) - n], words[: len(words) // 3] + new[:n] + words[len(words) // 3 + n :]]


def test_deduplicated_passages(spark):
    rng = random.Random(8)
    rows, near = [], []
    for k in range(60):
        size = rng.randrange(150, 500)
        for share in (0.08, 0.12, 0.16, 0.2, 0.24):
            for kind in range(5):  # a pair of its own for each edit
                words, new = ([f"{c}{k}x{rng.randrange(10**9)}" for _ in range(n)] for c, n in (("word", size), ("other", 200)))
                texts = [" ".join(words), " ".join(passage_edits(words, new, share)[kind])]
                a, b = map(five_words, texts)
                if len(a & b) >= 0.8 * len(a | b):
                    near.append((len(rows), len(rows) + 1))
                    rows += [(len(rows) + c, t) for c, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [p for p in near if set(p) <= kept]
    print(len(near), "pairs,", len(lost), "not found")
    assert len(near) > 500 and len(lost) <= 0.03 * len(near)


def test_deduplicated_short_texts(spark):
    rng = random.Random(12)
    rows, want = [], []
    for k in range(900):  # a pair each: 7 long words and short ones, and the same with long ones added
        size = rng.choice([8, 12, 20, 40, 54])
        words = [f"longer{k}x{i}" if i < 7 else f"{k:03x}{chr(48 + i)}" for i in range(size)]
        extra = [f"clause{k}x{i}" for i in range(rng.randrange(1, max(2, size // 3)))]
        texts = [" ".join(words), " ".join(words + extra)]
        a, b = map(five_words, texts)
        want.append(len(a & b) / len(a | b) >= 0.8)
        rows += [(2 * k + c, t) for c, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = [2 * k + 1 not in kept for k in range(len(want))]
    wrong = sum(g and not w for g, w in zip(got, want, strict=True))
    lost = sum(w and not g for g, w in zip(got, want, strict=True))
    print(sum(want), "pairs,", lost, "not found,", wrong, "of the others found")
    assert 200 < sum(want) < 700 and not wrong and lost <= 0.005 * sum(want)


def test_deduplicated_is_exact(spark):
    """A passage appended to texts of 5 to 5,000 words: under 0.8 all stay, from 0.8 on one goes."""
    rng = random.Random(21)
    rows, want = [], []
    for size in (5, 12, 30, 64, 100, 300, 1000, 5000):
        for likeness in (0.70, 0.74, 0.78, 0.79, 0.795, 0.8, 0.805, 0.82, 0.86):
            for _ in range(6 if size < 1000 else 2):
                words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
                more = round((size - 4) / likeness - (size - 4))
                texts = [" ".join(words), " ".join(words + [f"x{rng.randrange(10**9)}" for _ in range(more)])]
                a, b = map(five_words, texts)
                want.append(texts[0] == texts[1] or len(a & b) >= 0.8 * len(a | b))
                rows += [(len(rows) + c, t) for c, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(len(want)))
    gone = [2 * k + 1 not in kept for k in range(len(want))]
    assert not any(g and not w for g, w in zip(gone, want, strict=True))
    lost = sum(w and not g for g, w in zip(gone, want, strict=True))
    assert sum(want) > 100 and lost <= 1


def test_deduplicated_large_groups(spark, monkeypatch):
    """Groups far larger than a cell: copies of one text, and a chain whose ends are unlike, beside texts that are only loosely alike."""
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = random.Random(22)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:100], f"own{k}"])) for k in range(60)]
    walk = [f"c{k}" for k in range(400)]
    rows += [(100 + k, " ".join(walk[5 * k : 5 * k + 100])) for k in range(50)]  # neighbours are alike, far ones not
    rows += [(200 + k, " ".join([*base[:88], *(f"y{k}z{rng.randrange(10**9)}" for _ in range(14))])) for k in range(30)]  # 0.72 to the copies and among themselves
    rng.shuffle(rows)
    sets = {i: five_words(t) for i, t in rows}
    root = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(root.values())
    assert len(kept) == 32


def test_components_chain(spark):
    n = 300
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = simhash.components(chain).collect()
    assert sorted(r.node for r in got) == [*range(n + 1), 1000, 1001]
    places = defaultdict(set)
    for r in got:
        places[r.root].add(r.node)
    assert sorted(map(len, places.values())) == [2, n + 1] and all(root in nodes for root, nodes in places.items())
    assert simhash.components(chain.limit(0)).count() == 0


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 1000 + k) for k in range(300)]
    root = brute_components({k: k for e in edges for k in e}, lambda a, b: (a, b) in known or (b, a) in known) if (known := set(edges)) else {}
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {k for a, b in edges if a != b for k in (a, b)}
    first = {}
    for node, r in got.items():
        assert first.setdefault(r, root[node]) == root[node]
    assert len(set(first.values())) == len(first)


# 4: sharding


def test_flow_is_least():
    rng = random.Random(7)
    for _ in range(30):
        supply = [rng.randrange(100) for _ in range(4)]
        demand = sharding.even_capacities(sum(supply), 6)
        flow = sharding.min_cost_flow(supply, demand, [[int(i != j) for j in range(6)] for i in range(4)])
        assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(6)] == demand
        assert sum(flow[i][j] for i in range(4) for j in range(6) if i != j) == sum(max(0, s - d) for s, d in zip(supply, demand))
    # A dear way round is taken only where capacity forces it.
    assert sharding.min_cost_flow([5, 5], [5, 5], [[1, 2], [1, 9]]) == [[0, 5], [5, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], [[0]])


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_sharding_law(request, spark, which, tmp_path):
    df = request.getfixturevalue(which)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op4_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == df.count()
    text = defaultdict(list)
    for r in df.collect():
        text[r.doc_id].append(r.text)
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        assert any(r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode())) for t in text[r.doc_id])
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        assert max(size[k] for k in range(8)) - min(size[k] for k in range(8)) <= 2 * max(r["size"] for r in rows)


def least_cost(supply, demand, cost):
    """The least cost by trying all flows."""

    @lru_cache(None)
    def best(i, room):
        if i == len(supply):
            return 0
        out = None
        for parts in product(*(range(min(r, supply[i]) + 1) for r in room)):
            if sum(parts) == supply[i] and (rest := best(i + 1, tuple(r - p for r, p in zip(room, parts)))) is not None:
                price = rest + sum(p * c for p, c in zip(parts, cost[i]))
                out = price if out is None else min(out, price)
        return out

    return best(0, tuple(demand))


def test_sharding_many_equal_rows(spark):
    """A third of the rows is equal: they are dealt over all blocks, and the law holds."""
    docs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).otherwise("same").alias("text")).repartition(8)
    size, order = F.octet_length("text") + 1, [F.col("doc_id"), F.col("text")]
    out = sharding.resharded(docs, F.pmod(F.xxhash64(*order), F.lit(6)), size, order, 8, blocks=64).collect()
    assert len(out) == 6000
    totals = Counter()
    for r in out:
        totals[r["shard"]] += r["size"]
    assert max(totals.values()) - min(totals.values()) <= 20
    for k in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    assert {r["doc_id"] for r in out if r["doc_id"] is not None} == {k for k in range(6000) if k % 3}


def test_flow_with_uneven_prices():
    rng = random.Random(17)
    for _ in range(60):
        supply, demand = [rng.randrange(5) for _ in range(3)], [rng.randrange(2, 7) for _ in range(3)]
        cost = [[rng.randrange(10) for _ in range(3)] for _ in range(3)]
        want = least_cost(supply, demand, cost)
        if want is None:
            with pytest.raises(ValueError):
                sharding.min_cost_flow(supply, demand, cost)
        else:
            flow = sharding.min_cost_flow(supply, demand, cost)
            assert sum(f * c for row, prices in zip(flow, cost) for f, c in zip(row, prices)) == want


def test_rewrite_affected(spark, tmp_path):
    """One shard is full and stays as it is; rows without an id, repeated ids and equal rows all come through."""
    rows = [(0, k if k % 2 else None, "text") for k in range(20)] + [(1, 5, "same")] * 10 + [(2, k, f"t{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "shard int, doc_id long, text string")
    slot = F.row_number().over(W.partitionBy("shard").orderBy("doc_id")) - 1
    sharding.laid_out(df.withColumn("slot", slot.cast("long")), f"{tmp_path}/old")
    folders = {k: f"{tmp_path}/old/shard={k}" for k in range(3)}
    cost = [[0, 1, 9], [1, 0, 9], [9, 9, 0]]
    monkey = sharding.even_capacities
    try:
        sharding.even_capacities = lambda total, shards: [15, 15, 30]
        out = sharding.rewrite(spark, folders, f"{tmp_path}/new", 3, F.lit(1), cost=cost)
    finally:
        sharding.even_capacities = monkey
    assert out == {2: folders[2], 0: f"{tmp_path}/new/shard=0", 1: f"{tmp_path}/new/shard=1"}
    got, slots = Counter(), {}
    for k, folder in out.items():
        part = spark.read.parquet(folder).collect()
        got += Counter((r.doc_id, r.text) for r in part)
        slots[k] = sorted(r.slot for r in part)
    assert got == Counter((i, t) for _, i, t in rows) and {k: len(v) for k, v in slots.items()} == {0: 15, 1: 15, 2: 30}
    assert all(v == list(range(len(v))) for v in slots.values())
    for k in range(3):
        assert spark.read.parquet(folders[k]).count() == (20, 10, 30)[k]  # nothing old is touched


def test_rewrite_to_more_shards(spark, docs, tmp_path):
    laid = sharding.resharded(docs, F.pmod("doc_id", F.lit(2)), F.lit(1), [F.col("doc_id")], 2)
    sharding.laid_out(laid.select(*docs.columns, "shard", "slot"), f"{tmp_path}/old")
    out = sharding.rewrite(spark, {k: f"{tmp_path}/old/shard={k}" for k in range(2)}, f"{tmp_path}/new", 3, F.lit(1))
    assert sorted(out) == [0, 1, 2]
    rows = [r for folder in out.values() for r in spark.read.parquet(folder).collect()]
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())


# 5 and 10: classifiers


def test_language_held_out(spark):
    got = language_id.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02 and all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, docs, odd, empty):
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identified(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert got[5].lang_pred in model.languages
    assert language_id.identified(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identified(odd, language_id.train(empty)).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.96
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_odd(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(odd, model).collect()}
    assert got[1] == got[2] and len(got) == 9
    assert quality.scored(empty, quality.train(empty, labels.limit(0))).count() == 0
    assert {r.score for r in quality.scored(odd, quality.train(empty, labels.limit(0))).collect()} == {0.5}


def test_samples_are_bounded(spark):
    """Many rows that share an id, or have none, neither pass the bound nor drop out."""
    n = 4000
    rows = [(7, f"shared {k} words here", "en") for k in range(n)] + [(None, f"none {k} mots ici", "fr") for k in range(n)] + [(7, "equal rows", "en")] * n + [(k, "ein Text", f"l{k}") for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language_id.sample(df, F.lit(True), 640)
    assert Counter(langs) == {**{"en": 20, "fr": 20}, **{f"l{k}": 1 for k in range(100, 130)}}
    assert len({t for t, x in zip(texts, langs) if x == "fr"}) == 20
    model = language_id.train(df)
    assert len(model.languages) == 32 and model.head is not None and model.predict("mots ici none")[0] in model.languages
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.when(F.col("id") < 10_000, F.col("id")).otherwise(F.col("id") % 40)).alias("lang"))
    texts, langs = language_id.sample(many, F.lit(True), 640)
    assert len(texts) == 640 and set(langs) == {f"l{k}" for k in sorted(range(40), key=lambda k: f"l{k}")[:32]}
    long = df.limit(1).withColumn("text", F.repeat(F.lit("word "), F.lit(100_000)))
    assert len(language_id.sample(long, F.lit(True))[0][0]) == language_id.CHARS
    labels = spark.createDataFrame([(7, 1)] * n + [(None, 0)] * n + [(k, 0) for k in range(100, 130)], "doc_id long, quality int")
    model = quality.train(df, labels, rows=60)
    assert model.layers and 0 <= model.score("shared 5 words here") <= 1
    seen = []
    fit, quality.fit = quality.fit, lambda texts, labels, share, features=None: seen.append(Counter(labels)) or fit(texts, labels, share, features)
    try:
        quality.train(df, labels, rows=60)
    finally:
        quality.fit = fit
    assert max(seen[0].values()) <= 30 and set(seen[0]) == {0, 1}


def test_letters():
    model = language_id.Model(["a", "b"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2))
    assert [model.predict(t)[0] for t in ("\xbd \xb2", "12_!", "\u2160", None, "")] == ["und"] * 5 and model.predict("\xbd x")[0] == "a" == model.predict("\u65e5")[0]


def slow_subwords(text):
    """The grams of subwords(), byte by byte."""
    b = b" " + text.lower().encode().translate(language_id._CLEAN) + b" "
    out = []
    for n in (2, 3, 4):
        for k in range(len(b) - n + 1):
            g = b[k : k + n]
            if 32 not in g[1:-1] and not (g[0] == 32 and g[-1] == 32):
                h = g[0]
                for c in g[1:]:
                    h = (h * 0x01000193 + c * 0x9E3779B1) % 2**32
                out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32) >> 17)
    return sorted(out)


def test_language_brute_force(monkeypatch):
    """Subwords, training and scores against a slow twin in plain Python."""
    for text in ("Hello, wor1d", "é a  bc", "x", "日本 y"):
        assert sorted(language_id.subwords(text.lower().encode()).tolist()) == slow_subwords(text)
    monkeypatch.setattr(language_id, "DIM", 3)
    texts, labels = ["hello you there", "bonjour toi la", "hello again you", "bonjour encore toi", "guten tag", "hello old world"] * 2, ["en", "fr", "en", "fr", "de", "en"] * 2
    model = language_id.fit(texts, labels, epochs=2, batch=4)
    names, rng = sorted(set(labels)), np.random.default_rng(11)
    segments = []
    for k, (t, y) in enumerate(zip(texts, labels)):
        if k % 5:
            data = t.lower().encode()
            for _ in range(4):
                size = int(2 ** rng.uniform(4, 10))
                at = int(rng.integers(0, max(1, len(data) - size)))
                if ids := slow_subwords(data[at : at + size].decode()):
                    segments.append((ids, names.index(y)))
    e = rng.normal(0, 0.1, (language_id.BUCKETS, 3)).tolist()
    w = rng.normal(0, 0.3, (3, 3)).tolist()
    bias = [0.0] * 3
    for epoch in range(2):
        step, order = 2.0 * (1 - epoch / 2), rng.permutation(len(segments)).tolist()
        for at in range(0, len(order), 4):
            part = [segments[k] for k in order[at : at + 4]]
            de, dw, db = defaultdict(lambda: [0.0] * 3), [[0.0] * 3 for _ in range(3)], [0.0] * 3
            for ids, y in part:
                x = [sum(e[i][d] for i in ids) / len(ids) for d in range(3)]
                z = [sum(x[d] * w[d][c] for d in range(3)) + bias[c] for c in range(3)]
                p = np.exp(np.array(z) - max(z))
                g = [(float(v / p.sum()) - (c == y)) / len(part) for c, v in enumerate(p)]
                for c in range(3):
                    db[c] += g[c]
                    for d in range(3):
                        dw[d][c] += x[d] * g[c]
                for i in ids:
                    for d in range(3):
                        de[i][d] += sum(g[c] * w[d][c] for c in range(3)) / len(ids)
            for i, row in de.items():
                for d in range(3):
                    e[i][d] -= 20 * step * row[d]
            for d in range(3):
                bias[d] -= step * db[d]
                for c in range(3):
                    w[d][c] -= step * dw[d][c]
    table = np.array(e) @ np.array(w)
    assert np.allclose(model.table, table, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-6)
    z = table[slow_subwords("hello world")].mean(axis=0) + bias
    p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
    name, score, _ = model.predict("hello world")
    assert name == names[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_quality_brute_force(monkeypatch):
    """Context vectors, pooling and the score against slow twins in plain Python."""
    texts = ["Good words in a good order", "bad bad bad 12 !!", "Fine words again", "bad 9 bad !!", "Good order of words"] * 3
    labels = [1, 0, 1, 0, 1] * 3
    where, sign = quality.index_vectors(5)
    flat = defaultdict(lambda: np.zeros(quality.DIM))
    for t in texts:
        a, b = quality.word_ids(t.encode())
        for k in range(len(a)):
            for j in (k - 2, k - 1, k + 1, k + 2):
                if 0 <= j < len(a):
                    for mine in (a[k], b[k]):
                        for theirs in (a[j], b[j]):
                            for n in range(quality.NONZERO):
                                flat[int(mine)][where[theirs, n]] += sign[theirs, n]
    got = quality.word_vectors(texts, 5)
    for k, v in flat.items():
        if v.any():
            assert np.allclose(got[k], v / np.linalg.norm(v), atol=1e-6)
    t = texts[0]
    a, b = quality.word_ids(t.encode())
    v = [got[i].astype(float) + got[j] for i, j in zip(a, b)]
    product = sum(x * y for x, y in zip(v, v[1:]))
    same = [sum(x == y for x, y in zip(a, a[1:])), sum(x == y for x, y in zip(a, a[2:]))]
    pairs = len(v) - 1
    want = [*(sum(v) / len(v)), *(product / pairs), same[0] / pairs, same[1] / pairs, product.sum() / pairs, np.log1p(len(v)) / 10]
    assert np.allclose(quality.pooled(t, got), want, atol=1e-5)
    model = quality.fit(texts, labels, 0.6)
    w1, b1, w2, b2 = model.layers
    x = (quality.pooled(t, model.vectors) - model.centre) / model.scale
    hidden = [np.tanh(sum(x[i] * w1[i, h] for i in range(len(x))) + b1[h]) for h in range(quality.HIDDEN)]
    z = (sum(h * w for h, w in zip(hidden, w2)) + b2) / model.temperature + model.shift
    assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in zip(texts, labels)]) > 0.9


# 6: WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", '<html lang="en"><head><title>T &amp; x</title></head><body><p title="a>b">One<br>two &lt;3&gt; caf&eacute; &#8217; &copy;</p><script>x()</script></body></html>'), (2, None, None), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = warc.responses(warc.http_responses(df))
    out = warc.parsed(warc.serialized(warc.derivatives(source)).drop("block")).collect()
    assert len(out) == 6 and all(r.complete for r in out)
    known = {r.page_id: r for r in source.collect()}
    assert known[1].payload == rows[0][2] and known[1].date == warc.DATE
    for r in out:
        one = {k: v[0] for k, v in r.header.items()}
        assert one["warc-refers-to"] == known[r.page_id].record_id == r.refers_to and one["warc-type"] == r.record_type
        assert one["warc-block-digest"] == "sha1:" + hashlib.sha1(r.block).hexdigest()
        assert int(one["content-length"]) == len(r.block)
        assert ("warc-target-uri" in r.header) == (r.page_id == 1)
        assert one["warc-refers-to-payload-digest"] == r.payload_digest == "sha1:" + hashlib.sha1((rows[0][2] if r.page_id == 1 else "").encode()).hexdigest()
        u = uuid.UUID(r.record_id[1:-1])
        assert u.version == 3 and u.variant == uuid.RFC_4122
    assert {r.block.decode() for r in out if r.page_id == 1 and r.record_type == "conversion"} == {"One\ntwo <3> caf\xe9 \u2019 \xa9"}
    meta = next(r.block.decode() for r in out if r.page_id == 1 and r.record_type == "metadata")
    assert "title: T & x\r\n" in meta and "source-status: 200\r\n" in meta and "language: en\r\n" in meta
    assert warc.derivatives(warc.responses(warc.http_responses(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        warc.derivatives(source.withColumn("block", F.lit(1)), keep=("block",))


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files(spark, tmp_path, packed):
    """Made-up files, plain and of one gzip member a record: odd bytes, repeated and folded headers, and a torn last record."""

    def record(kind, block, *more):
        return b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x:%d>" % len(block), b"WARC-Date: 2020-02-03T04:05:06Z", *more, b"Content-Length: %d" % len(block), b"", block, b"", b""])

    http = b"HTTP/1.1 404 Not Found\r\nServer: odd\r\nX-Long: one\r\n two\r\nSet-Cookie: a\r\nset-cookie: b\r\n" + b"".join(b"H%d: v\r\n" % k for k in range(1200)) + b"\r\n"
    pages = [b"<p>one \xff</p>", b"\r\n\r\ntwo blank lines\r\n\r\n", b""]
    files = [record(b"warcinfo", b"software: x\r\n", b"WARC-Concurrent-To: <a>", b"WARC-Concurrent-To: <b>"), *[record(b"response", http + p, b"WARC-Target-URI: http://x/%d" % k) for k, p in enumerate(pages)]]
    torn = record(b"response", http + b"cut", b"WARC-Target-URI: http://x/9")[:-12]
    data = [*files, torn]
    name = tmp_path / ("a.warc.gz" if packed else "a.warc")
    name.write_bytes(b"".join(map(gzip.compress, data)) if packed else b"".join(data))
    rows = warc.parsed(warc.read(spark, str(name))).collect()
    assert len(rows) == 5 and sorted(r.complete for r in rows) == [False, True, True, True, True]
    info = next(r for r in rows if r.header["warc-type"] == ["warcinfo"])
    assert info.header["warc-concurrent-to"] == ["<a>", "<b>"] and bytes(info.block) == b"software: x\r\n"
    got = {r.target_uri: r for r in warc.responses(warc.read(spark, str(name)), keep=()).collect()}
    assert got["http://x/0"].payload == "<p>one \ufffd</p>" and got["http://x/1"].payload == pages[1].decode() and got["http://x/2"].payload == ""
    meta = {r.target_uri: r.block for r in warc.derivatives(warc.responses(warc.read(spark, str(name)), keep=()), keep=()).filter("record_type = 'metadata'").collect()}
    lines = meta["http://x/0"].split("\r\n")
    assert "source-status: 404" in lines and "source-header: X-Long: one two" in lines and "source-header: H1199: v" in lines
    assert [x for x in lines if "ookie" in x] == ["source-header: Set-Cookie: a", "source-header: set-cookie: b"]


def test_warc_bodies(spark, tmp_path):
    """Chunked, packed and other charsets; digests are of bytes, and those of the source stay; cells and lists break."""
    latin = "<p>caf\xe9</p>".encode("latin-1")
    cases = [
        (b"Content-Type: text/html; charset=ISO-8859-1", latin, "<p>caf\xe9</p>", latin),
        (b"Content-Type: text/html", b'<meta charset="windows-1252"><p>\x80</p>', '<meta charset="windows-1252"><p>\u20ac</p>', None),
        (b"Transfer-Encoding: chunked", b"5;x=1\r\n<p>he\r\n6\r\nllo</p\r\n1\r\n>\r\n0\r\n\r\n", "<p>hello</p>", b"<p>hello</p>"),
        (b"Transfer-Encoding: chunked", b"no length\r\n<p>", "no length\r\n<p>", None),
        (b"Content-Encoding: gzip", gzip.compress(b"<p>packed</p>"), "<p>packed</p>", None),
        (b"Content-Encoding: deflate", zlib.compress(b"<p>packed</p>")[2:-4], "<p>packed</p>", None),
        (b"Content-Encoding: gzip", b"<p>plain</p>", "<p>plain</p>", None),
        (b"Content-Type: text/html; charset=none-such", b"\xff", "\ufffd", None),
    ]
    rows = []
    for k, (head, payload, _, _) in enumerate(cases):
        http = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + payload
        own = b"WARC-Payload-Digest: sha1:OWN\r\n" if k == 4 else b""
        rows.append((k, b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\n" % k + own + b"Content-Length: %d\r\n\r\n" % len(http) + http))
    source = warc.responses(spark.createDataFrame([(k, bytearray(r)) for k, r in rows], "page_id long, record binary"))
    got = {r.page_id: r for r in source.collect()}
    for k, (_, payload, text, sent) in enumerate(cases):
        sent = payload if sent is None else sent
        assert got[k].payload == text and got[k].complete and got[k].payload_length == len(sent), k
        assert got[k].payload_digest == ("sha1:OWN" if k == 4 else "sha1:" + hashlib.sha1(sent).hexdigest()), k
    meta = {r.page_id: r for r in warc.derivatives(source).filter("record_type = 'metadata'").collect()}
    assert "source-payload-digest: sha1:OWN\r\n" in meta[4].block and f"source-payload-length: {len(latin)}\r\n" in meta[0].block
    html = "<table><tr><td>alpha</td><td>beta</td></tr></table><dl><dt>a<dd>b</dl><blockquote>c</blockquote>d<option>e<script>code()"
    assert spark.createDataFrame([(html,)], "html string").select(warc.visible_text(F.col("html"))).first()[0] == "alpha\nbeta\na\nb\nc\nd\ne"


@pytest.mark.parametrize("packed", [False, True])
def test_warc_records_by_length(spark, tmp_path, packed):
    """Payloads that quote records stay whole, wherever the file is split; a record that is too short loses no other."""

    def record(k, payload, length=None):
        http = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n" % (k, length or len(http)) + http + b"\r\n\r\n"

    quoted = b"see\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1 again" + b" fill" * 300
    payloads = [b"first", quoted, b"middle", quoted + b"\r\n\r\nWARC/1.", b"short", b"last " * 50]
    data = [record(k, p, 90_000 if k == 4 else None) for k, p in enumerate(payloads)]
    name = tmp_path / ("a.warc.gz" if packed else "a.warc")
    name.write_bytes(b"".join(map(gzip.compress, data)) if packed else b"".join(data))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.target_uri: r for r in warc.responses(warc.read(spark, str(name)), keep=()).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {u: (r.payload, r.complete) for u, r in got.items()} == {f"http://x/{k}": (p.decode(), k != 4) for k, p in enumerate(payloads)}


# 7: mixing


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_mixing_targets(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mixed_counts(df, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == df.count()
    size = Counter()
    for r in rows:
        size[r.source] += r["size"]
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, sum(size.values()), set(names)
    while free:  # reshare the excess until none is above
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left, free = left - sum(3 * size[s] for s in over), free - over
    taken, longest = Counter(), Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    total = sum(size.values())
    assert sum(taken.values()) <= total
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max(longest.values())
    assert mixing.mixture(df).count() == sum(r.copies for r in rows)


# 8: packing


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing_round_trip(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in df.collect())
    pieces = sorted(packing.packed(df).collect(), key=lambda p: (p.sequence_id, p.offset))
    at, got, part = 0, Counter(), []
    for p in pieces:  # the stream has no gaps and ends each document with its id
        assert (p.sequence_id * 2048 + p.offset, p.start) == (at, len(part)) and p.offset + p.length <= 2048
        ids = np.frombuffer(p.ids, "<u2").tolist()
        assert len(ids) == p.length and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        part += ids
        at += p.length
        if len(part) == p.doc_tokens:
            got[p.doc_id, tuple(part)] += 1
            part = []
    assert got == want and not part
    whole = {r.sequence_id: r.tokens for r in packing.sequences(packing.packed(df)).collect()}
    assert sum(whole.values()) == at and sorted(whole) == list(range(len(whole)))


def test_encoder_equals_tokenizer():
    e = packing.Encoder(packing.vocabulary_path())
    for x in ["", " ", " " * 400_000, "it's 12 3.4\n\n\tx ", "a" * 50_000, "<|endoftext|>x", "ſ İ ǅ 日本語 \U0001f600 \xa0\u3000", "!?" * 999]:
        assert e.encode(x) == e.whole(x)


# 9: fingerprints


@pytest.fixture(scope="module")
def hot(spark):
    """600 rows: half without an id, a quarter with the same one."""
    ids = [None if k % 2 else 77 if k % 4 else k for k in range(600)]
    return spark.createDataFrame([(i, f"text {k} of a row {k * k}", "en", "a", 1) for k, i in enumerate(ids)], DOCS).cache()


def by_id_and_hash(row):
    i, t = row
    h = xxhash.xxh64_intdigest(t, seed=42)
    return (i is not None, i or 0, h - (1 << 64) if h >> 63 else h)


@pytest.mark.parametrize("which", ["docs", "odd", "empty", "hot"])
@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_brute_force(request, which, parts):
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=by_id_and_hash)
    printed = lru_cache(None)(fingerprint.fingerprint)
    want, likely = Counter(), []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        other = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = map(printed, (t, other, following))
        edited, after = fingerprint.likeness(a, b), fingerprint.likeness(a, c)
        want[i, len(t), hashlib.sha256(other.encode()).hexdigest(), f"{a:064x}", f"{b:064x}", round(edited, 9), round(after, 9)] += 1
        likely += [edited > after] * (which == "docs" and len(t) > 200)
    got = fingerprint.fingerprinted(df, parts).collect()
    assert Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert not likely or np.mean(likely) > 0.95


def test_fingerprint_ranges_of_hot_ids(hot):
    part, count = fingerprint.ranges(hot.select("doc_id", "text"), 12)
    sizes = [r["count"] for r in hot.groupBy(part.alias("part")).count().collect()]
    assert len(sizes) <= count <= 24 and max(sizes) <= 600 / 12 * 2.5
    alike, n = fingerprint.ranges(hot.select(F.lit(None).cast("long").alias("doc_id"), "text"), 12)
    sizes = [r["count"] for r in hot.select(F.lit(None).cast("long").alias("doc_id"), "text").groupBy(alike.alias("part")).count().collect()]
    assert n == 12 and max(sizes) <= 600 / 12 * 2.5


def test_fingerprint_votes():
    assert fingerprint.fingerprint("") == 0
    assert fingerprint.fingerprint("A b  C") == fingerprint.fingerprint("a B c")
    words = "a b c d a b"
    h = fingerprint.terms(words)
    assert len(h) == 5 and h[0] == h[4]


def test_within_radius(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(256) for _ in range(50)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(6))) for p in prints]
    df = spark.createDataFrame([(f"{p:064x}",) for p in prints], "fingerprint string")
    got = {(r.query_fingerprint, r.fingerprint): r.distance for r in fingerprint.within_radius(df, df, 3, 6).collect()}
    want = {(f"{a:064x}", f"{b:064x}"): (a ^ b).bit_count() for a in prints for b in prints if (a ^ b).bit_count() <= 3}
    assert got == want


def test_radius_hot_block(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELL", 16, raising=False)
    rng = random.Random(10)
    hot = rng.getrandbits(128) << 128
    prints = [hot | rng.getrandbits(128) for _ in range(200)]  # three of six blocks in common
    prints += [p ^ sum(1 << b for b in rng.sample(range(256), 3)) for p in prints]
    df = spark.createDataFrame([(f"{p:064x}",) for p in prints], "fingerprint string")
    sides = []
    split = fingerprint.dealt
    monkeypatch.setattr(fingerprint, "dealt", lambda *x: sides.append(split(*x)) or sides[-1])
    got = {(r.query_fingerprint, r.fingerprint): r.distance for r in fingerprint.within_radius(df, df, 3, 6).collect()}
    assert got == {(f"{a:064x}", f"{b:064x}"): (a ^ b).bit_count() for a in prints for b in prints if (a ^ b).bit_count() <= 3}
    for side in sides[0]:
        name = next(c for c in side.columns if c.endswith("fingerprint"))
        assert side.select("key", name).distinct().groupBy("key").count().agg(F.max("count")).first()[0] > 100
        assert side.groupBy("key", "row", "column").count().agg(F.max("count")).first()[0] < 4 * 16


def test_pipeline_brute_force(spark, tmp_path):
    """Each stage on what the stage before it kept, against a plain twin on the driver."""
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rng, rows = random.Random(31), [tuple(r) for r in base]
    for k, r in enumerate([r for r in base if r.text and 60 < len(r.text.split()) < 400][:25]):
        w = r.text.split()
        for c, text in enumerate((r.text, " ".join(w + [f"extra{k}"]), " ".join(w[1:]))):  # equal, one word more, one less
            rows.append((9000 + 10 * k + c, text, r.lang, r.source, len(text)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS)
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    one = stages["language_id"](spark, docs, sf).cache()
    model = language_id.train(docs)
    assert key(one) == Counter((i, t) for i, t, *_ in rows if not model.predict(t)[2])

    two = stages["quality"](spark, one, sf).cache()
    model = quality.train(one, spark.read.parquet(f"{sf}/labels.parquet"))
    assert key(two) == Counter((r.doc_id, r.text) for r in one.collect() if model.score(r.text) >= 0.5)

    three = stages["near_duplicates"](spark, two, sf).cache()
    sets = {r.doc_id: five_words(r.text) for r in two.collect()}
    ids = sorted(sets)
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b]}
    sure = brute_components({k: k for k in ids}, lambda a, b: likeness.get((a, b), likeness.get((b, a), 0)) >= 0.8)
    may = brute_components({k: k for k in ids}, lambda a, b: likeness.get((a, b), likeness.get((b, a), 0)) >= 0.68)
    kept = {r.doc_id for r in three.collect()}
    assert {sure[k] for k in ids} >= kept and {may[k] for k in ids} <= kept  # the smallest id of each group, and none but for a link

    four = stages["mixing"](spark, three, sf).cache()
    docs3 = three.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs3}
    names = sorted({r.source for r in docs3 if r.source is not None}) + [None] * any(r.source is None for r in docs3)
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    queue = []
    for rank, s in enumerate(names):
        mine = sorted((hashlib.md5(f"7:{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest(), r.doc_id) for r in docs3 if r.source == s)
        total, upto = sum(size[i] for _, i in mine), 0
        for _, i in mine:
            upto += size[i]
            queue += [((e * total + upto) / weight[s], rank, i) for e in range(3) if size[i]]
    want, run, budget = Counter(), 0, sum(size.values())
    for _, _, i in sorted(queue):
        run += size[i]
        if run > budget:
            break
        want[i] += 1
    assert Counter(r.doc_id for r in four.collect()) == want

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    pieces = sorted(stages["packing"](spark, four, sf).collect(), key=lambda p: (p.sequence_id, p.offset))
    stream = [i for p in pieces for i in np.frombuffer(p.ids, "<u2").tolist()]
    assert all((p.sequence_id * 2048 + p.offset) == at for p, at in zip(pieces, [0, *np.cumsum([p.length for p in pieces])]))
    got, part = Counter(), []
    for i in stream:
        part.append(i)
        if i == 1:
            got[tuple(part)] += 1
            part = []
    assert not part and got == Counter((*t.encode(r.text, add_special_tokens=False).ids, 1) for r in four.collect())


def test_mixing_without_ids(spark):
    """Half of the rows have no id: their bins are as even as the others'."""
    df = spark.createDataFrame([(None if k % 2 else k, "s", f"text number {k}") for k in range(4000)], "doc_id long, source string, text string")
    bins = df.select(F.substring(mixing.shuffle_key(7), 1, mixing.BIN_DIGITS).alias("bin")).groupBy("bin").count().agg(F.max("count")).first()[0]
    assert bins < 12
    rows = mixing.mixed_counts(df, mixing.word_count(F.col("text"))).collect()
    assert sum(r["copies"] * r["size"] for r in rows) <= 12_000 and mixing.mixture(df).count() == sum(r["copies"] for r in rows)
    with pytest.raises(ValueError):
        mixing.mixed_counts(df.withColumn("size", F.lit(1)), F.lit(1), keep=("doc_id", "size"))


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0
    assert corpus_pipeline.run(spark, sf).count() >= counts[4] > 0
