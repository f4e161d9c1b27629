"""The engine's own operators: DuckDB twins, hand-made frames, FTS5 as a differential, and ingest invariants."""

import hashlib
import io
import json
import os
import re
import sqlite3
import time
import zipfile
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import shared, suite
from quarry.functions import scalars as S
from quarry.operators import chunking, context, filters, hybrid, lexical, lookup, match, quantized, store, vectors
from quarry.sources import extract, listing
from quarry.streaming import ingest, status

SF = "/root/testdata/sf0.001"
CHUNK = "id long, source_path string, source_kind string, title string, text string, metadata map<string,string>, ordinal int, content_hash string, active boolean, vector_status string, created_at timestamp, updated_at timestamp"
RECORD = "source_path string, source_kind string, title string, text string, metadata map<string,string>"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_twin(spark, db, name):
    got, rel = suite.QUERIES[name](spark, SF), db.sql(suite.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    mine = Counter(tuple(r[c] for c in cols) for r in got.collect())
    assert mine == Counter(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.SQL)))
def test_runs(spark, name):
    assert suite.QUERIES[name](spark, SF).columns


def chunks_of(spark, texts, inactive=()):
    rows = [(k, f"f{k}.txt", "normal_file", f"title {k}", t, {}, 0, str(k), k not in inactive, "indexed", T0, T0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


TEXTS = [
    "the quick brown fox", "quick quick slow", "Crème brûlée and fox", "a b c d e f g fox quick", "red-green n.1 it's", "foxes quickly foxtrot", "brown fox quick", "", "b a q q q q q q c a", "a b c", "a a b q c c b a", "İSTANBUL fox title",
    "the fox q q q quick brown q a b", "a q b q c q quick brown fox", "c b a c b a c b a",
]
EXPRESSIONS = [
    "quick", "fox quick", "fox OR slow", "quick NOT brown", '"brown fox"', "fox*", "creme", "^quick", "NEAR(quick fox, 2)", "NEAR(brown quick)", "title:title", "text:fox", "(fox OR slow) NOT brown", "quick + brown",
    "NEAR(a b c, 2)", "NEAR(a b c, 0)", "NEAR(c a b, 1)", "NEAR(a c, 3) OR fox", 'NEAR("quick brown" a fox, 3)', 'NEAR("quick brown" fox a, 1) NOT the', "NEAR(fo* qu*, 1)", "NEAR(title fox)", "text:NEAR(a b)", "^a", "^title", "title:^title",
    "text:^a b", "istanbul", "title:1*", "NEAR(a b, 2) NEAR(b c, 2)", "NEAR(fox)", "NEAR(a, b)", "NEAR(a OR b)", "((fox) AND (quick OR slow))", "(fox) (quick)", "(fox", "fox)", "text:fo*", "a NOT b c", "fox OR slow quick", '"quick brown" + fox', "^fox + quick",
    "fox AND brown OR slow", "what?", "n.1", "it's", "AND", "red-green", "x:y", '"open', "*", "fox NOT", "", "title:(fox OR title)", '"it s"', "zebra",
]


def indexed(c):
    index = lexical.postings(c)
    return index, lexical.totals(c, index)


def test_expressions_as_values(spark):
    """What a text says can be put together as values, and several texts are answered at once."""
    a, b, near = match.Phrase(("fox",)), match.Phrase(("quick",)), match.Near((match.Phrase(("quick",)), match.Phrase(("fox",))), 2)
    assert match.expression("(fox OR NEAR(quick fox, 2)) NOT quick") == (a | near) - b and match.expression("fox quick") == a & b
    c = chunks_of(spark, TEXTS)
    both = lexical.matched(*indexed(c), "fox NOT quick", a - b, "no)", "slow").collect()
    assert {r.chunk_id for r in both if r.query == 0} == {r.chunk_id for r in both if r.query == 1} and {r.query for r in both} == {0, 1, 3}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_match_language_like_fts5(spark, text):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, text)")
    con.executemany("INSERT INTO f(rowid, title, text) VALUES (?, ?, ?)", [(k, f"title {k}", t) for k, t in enumerate(TEXTS)])
    try:
        want = {k: round(s, 9) for k, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (text,))}
    except sqlite3.OperationalError:
        want = {}
    c = chunks_of(spark, TEXTS)
    got = {r.chunk_id: round(r.score, 9) for r in lexical.matched(*indexed(c), text).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("text, folders", [("quick*", {"qui"}), ("qui* OR fox", {"qui", "fox"}), ("émi* OR 東京都*", {"emi", "東京都"}), ("qu*", None), ("fox OR q*", None)])
def test_prefix_folders(spark, tmp_path, text, folders):
    """A prefix reads the folder of its first characters only, a shorter one all of them; the results are those of an index without folders."""
    c = chunks_of(spark, [*TEXTS, "émile quit quiz", "東京都庁 qu q"])
    index, total = indexed(c)
    lexical.dealt(index).write.partitionBy("bucket").parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    got = lexical.matched(stored, total, text)
    want = {r.chunk_id: round(r.score, 9) for r in lexical.matched(index, total, text).collect()}
    assert want and {r.chunk_id: round(r.score, 9) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    if folders is None:
        assert not any("bucket" in f for f in filters)
    else:
        assert filters and all(all(str(lexical.bucket(w)) in f for w in folders) for f in filters)
    terms = lexical.dictionary(stored)
    assert sorted(r.term for r in lexical.terms_of(terms, "qui").collect()) == sorted({r.term for r in index.collect() if r.term.startswith("qui")})
    assert terms.exceptAll(lexical.term_statistics(index)).isEmpty() and lexical.dictionary(stored.limit(0)).isEmpty()


def test_inactive_rows_count_in_statistics_only(spark):
    c = chunks_of(spark, TEXTS, inactive={1})
    got = lexical.lexical_search(c, *indexed(c), "quick").orderBy("rank").collect()
    assert 1 not in {r.chunk_id for r in got} and [r.score for r in got] == sorted(r.score for r in got)


def test_snippet(spark):
    text = " ".join(f"w{k}" for k in range(20)) + " fox x fox"
    df = spark.createDataFrame([(text,), ("short fox",), ("",)], "text string")
    got = [r[0] for r in df.select(lexical.snippet(F.col("text"), F.array(F.lit("fox")))).collect()]
    assert got[0].startswith("...") and got[0].endswith("fox x fox") and got[1:] == ["short fox", ""]


def test_windows_cover_all_words(spark):
    texts = {n: " ".join(f"w{k}" + ("\n" if k % 7 == 6 else "") for k in range(n)) for n in (0, 1, 10, 11, 12, 25)}
    df = spark.createDataFrame([(f"{n}.txt", "normal_file", "t", t, {"line": "5"}) for n, t in texts.items()], RECORD)
    got = {}
    for r in chunking.chunked(df, 10, 3).orderBy("source_path", "ordinal").collect():
        got.setdefault(r.source_path, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"1.txt": 1, "10.txt": 1, "11.txt": 2, "12.txt": 2, "25.txt": 4}
    for path, rows in got.items():
        words = texts[int(path[:-4])].split()
        for r in rows:
            assert r.text.split() == words[7 * r.ordinal : 7 * r.ordinal + 10]
            assert r.content_hash == hashlib.sha256(r.text.encode()).hexdigest()
            assert r.metadata["start_line"] == str(5 + 7 * r.ordinal // 7) and int(r.metadata["end_line"]) == 5 + (min(len(words), 7 * r.ordinal + 10) - 1) // 7
    with pytest.raises(ValueError):
        chunking.chunked(df, 10, 10)


CODE = {
    "a.py": ("import os\n\ndef f(x):\n    return x\n\n\nclass B:\n    pass\n", [("function", "f", 3, 4), ("class", "B", 7, 8)]),
    "a.js": ("export default async function go() {}\nconst add = (a) => a\nclass K {}\n", [("function", "go", 1, 1), ("function", "add", 2, 2), ("class", "K", 3, 3)]),
    "a.go": ("package x\nfunc (s *S) Run() {}\ntype T struct {\n}\n", [("function", "Run", 2, 2), ("class", "T", 3, 4)]),
    "a.rs": ("pub(crate) async fn go() {}\nimpl<T> Foo {\n}\nenum E {}\n", [("function", "go", 1, 1), ("class", "Foo", 2, 3), ("class", "E", 4, 4)]),
    "a.sql": ("create or replace view s.v as\nselect 1;\nCREATE FUNCTION f() x\n", [("class", "v", 1, 2), ("function", "f", 3, 3)]),
    "a.java": ("public final class A {\n  int f(int x) {\n  }\n}\n", [("class", "A", 1, 4)]),
    "b.py": ("x = 1\n", [(None, None, 1, 1)]),
}


def test_code_chunks(spark):
    df = spark.createDataFrame([(p, "normal_file", p, t, {}) for p, (t, _) in CODE.items()], RECORD)
    got = {}
    for r in chunking.chunked(df).orderBy("source_path", "ordinal").collect():
        m = r.metadata
        got.setdefault(r.source_path, []).append((m.get("code_symbol_kind"), m.get("code_symbol"), int(m["start_line"]), int(m["end_line"])))
        assert r.ordinal == len(got[r.source_path]) - 1
    for path, (_, want) in CODE.items():
        if path != "a.java":
            assert got[path] == want, path
    assert got["a.java"][0][:2] == ("class", "A")


def test_filters(spark):
    rows = [
        ("D:\\Work\\proj\\a.PY", "project_source", {"timestamp": "2024-03-01T10:00:00Z"}), ("home/.env", "normal_file", {}), ("x/b.srt#3", "normal_file", {"date": "bad", "mtime": "2024-05-05"}),
        ("s.jsonl#L1", "ai_session", {"repo": "Proj"}), ("x/c.yml", "normal_file", {"file_type": "SETTINGS"}), ("m.md", "ai_memory", {"extension": "md"}),
    ]
    df = spark.createDataFrame(rows, "source_path string, source_kind string, metadata map<string,string>")

    def keep(**f):
        return [r.source_path for r in df.filter(filters.predicate(f)).collect()]

    assert keep(drive="d:\\") == keep(drive="d") == [rows[0][0]]
    assert keep(project="proj") == [rows[0][0], rows[3][0]]
    assert keep(file_type="source_code") == [rows[0][0]] and keep(file_type="captions") == [rows[2][0]] and keep(file_type="config") == [rows[4][0]]
    assert keep(file_type="memories") == [rows[5][0]] and keep(extension="md") == [rows[5][0]]
    assert keep(date_from="2024-04-01") == [rows[2][0]] and keep(date_from="never", date_to="2024-12-31") == [rows[0][0], rows[2][0]]
    assert len(keep(project=None, drive=" ")) == len(rows)
    assert filters.candidates(10, {"drive": ""}) == 80 and filters.candidates(10, {}) == 10 and filters.clamped("x") == 10 and filters.clamped(99) == 50


def test_classification_and_skips(spark):
    rows = [("/r/build/a.py", "/r/build"), ("/r/x/build/a.py", "/r"), ("/r/a.zip", "/r"), ("/r/sessions/s.jsonl", "/r"), ("/r/projects/p.rs", "/r")]
    df = spark.createDataFrame(rows, "path string, root string").withColumn("rule", filters.classified_under(F.col("path"), F.col("root")))
    got = [(r.rule.kind, r.rule.reason) for r in df.collect()]
    assert got == [("normal_file", "normal_file"), ("system_cache", "skip_dir"), ("archive", "archive_extension"), ("ai_session", "session_log"), ("project_source", "project")]
    big = F.lit(21 << 20)
    assert [r[0] for r in df.select(filters.skip_reason(F.col("path"), big, F.col("rule"), archives=True)).collect()] == ["too_large", "skip_dir", None, None, "too_large"]


def test_scopes_and_folders(spark):
    """Folders and scopes as columns, as rules and as a walk's pruning agree with the plain definition."""
    folders, scopes = ("D:\\Games", "D:\\tools\\old", "/srv/cache"), ("C:\\Users\\me\\notes", "C:\\Users\\me\\.x\\brain")
    paths = ["D:\\games", "d:/GAMES/a.txt", "D:\\Games2\\a", "D:\\tools", "D:\\tools\\old\\x\\y", "/srv/cache/q", "/srv", "C:\\", "C:\\users", "C:\\Users\\me\\.x", "C:\\Users\\me\\.x\\brain\\deep\\f", "C:\\Users\\you", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rules = [filters.PathRule("left_out", "system_cache", True, folders=folders), filters.PathRule("unscoped", "system_cache", True, outside=scopes)]
    rows = df.select("path", filters.under_any(F.col("path"), folders).alias("under"), filters.in_scope_or_above(F.col("path"), scopes).alias("scope"), filters.classified(F.col("path"), rules)["reason"].alias("reason")).collect()

    def under(p, some):
        return any(filters.parts_of(p)[: len(f)] == f for f in map(filters.parts_of, some))

    for r in rows:
        if r.path is None:
            continue
        parts = filters.parts_of(r.path)
        assert r.under == under(r.path, folders), r.path
        assert r.scope == (under(r.path, scopes) or bool(parts) and any(f[: len(parts)] == parts for f in map(filters.parts_of, scopes))), r.path
        assert r.reason == ("left_out" if r.under else "unscoped" if parts[:1] == ("c:",) and not under(r.path, scopes) else "normal_file"), r.path
    p = filters.Pruning(frozenset(("build",)), ("ffmpeg-",), folders, scopes)
    assert p.begins("D:\\tools") and p.begins("/r/build") and not p.begins("D:\\Games\\one") and not p.begins("/srv/cache")
    assert [p.enters("C:\\", f) for f in ("C:\\Users", "C:\\Windows", "C:\\Users\\me\\notes", "C:\\Users\\me\\notes\\deep", "C:\\Users\\you")] == [True, False, True, True, False]
    assert [p.enters(r, f) for r, f in (("C:\\Users", "C:\\Users\\you"), ("/r", "/r/Build"), ("/r", "/r/ffmpeg-7"), ("/srv", "/srv/Cache"), ("/srv", "/srv/caches"))] == [True, False, False, False, True]
    assert len(filters.SKIPPED_FOLDERS) == 81


@pytest.mark.parametrize("wide, each", [(3 * listing.ENOUGH, 1), (100, 30), (1, 40)])
def test_driver_holds_few_folders(tmp_path, wide, each):
    """Whatever the tree's shape, the driver's list is bounded and the tasks find each file once."""
    want = set()
    for a in range(wide):
        for b in range(each):
            folder = tmp_path / f"d{a}" / f"e{b}"
            folder.mkdir(parents=True)
            (folder / "f.txt").write_text("x")
            want.add(str(folder / "f.txt"))
    (tmp_path / "own.txt").write_text("x")
    reader = listing.TreeReader([str(tmp_path)], ("node_modules",))
    branches = reader.partitions()
    assert len(branches) <= listing.ENOUGH and sum(len(b.folders) for b in branches) <= 2 * listing.ENOUGH
    got = [r[0] for b in branches for r in reader.read(b)]
    assert len(got) == len(set(got)) and set(got) == want | {str(tmp_path / "own.txt")}
    shares = Counter(sum(1 for _ in reader.read(b)) for b in branches)
    assert wide < listing.ENOUGH or max(shares) < 20


def test_tree_leaves_out_folders(spark, tmp_path):
    for p in ("a/one.txt", "a/deep/two.txt", "b/three.txt", "build/four.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("x")

    def got(*roots, **given):
        return sorted(os.path.relpath(r.path, tmp_path) for r in listing.listed(spark, [str(tmp_path / r) for r in roots], **given).collect())

    assert got(".", folders=[str(tmp_path / "A" / "deep")]) == ["a/one.txt", "b/three.txt"]
    assert got("a", "b", folders=[str(tmp_path / "b")]) == ["a/deep/two.txt", "a/one.txt"]
    assert got("build") == ["build/four.txt"] and got(".", pruned=()) == ["a/deep/two.txt", "a/one.txt", "b/three.txt", "build/four.txt"]


def test_redaction(spark):
    df = spark.createDataFrame([("api_key = 'abc123' and ghp_abcdefghij; my.token:xyz plain",)], "t string")
    assert df.select(S.redacted(F.col("t"))).first()[0] == "api_key = '[REDACTED_SECRET]' and [REDACTED_SECRET]; my.token:[REDACTED_SECRET] plain"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    assert [(r.chunk_id, r.score) for r in vectors.nearest(v, [1.0, 0.0], 2).collect()] == [(1, 1.0), (3, 1.0)]
    assert vectors.nearest(v, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        vectors.nearest(v, [1.0, 0.0], -1)
    with pytest.raises(Exception, match="components expected"):
        vectors.nearest(v, [1.0], 1).collect()
    assert vectors.added(v, spark.createDataFrame([(4, [0.5, 0.5])], v.schema), 2).count() == 4
    with pytest.raises(Exception, match="duplicate id"):
        vectors.added(v, v, 2).collect()


def test_hybrid_edges(spark):
    c = chunks_of(spark, TEXTS)
    corpus = hybrid.Corpus(c, *indexed(c), vectors.embedded(c, 16), lambda t: [0.25] * 16)
    assert hybrid.search(corpus, "  ", 5).count() == 0 == hybrid.search(corpus, "fox", 0).count()
    best = hybrid.search(corpus, "fox", 5).collect()
    assert len(best) == 5 and best[0].score <= 2.25 / 61 + 1e-12 and {r.rank_source for r in best} <= {"hybrid", "fts", "vector"}

    def down(_):
        raise OSError

    corpus.embed = down
    assert {r.rank_source for r in hybrid.search(corpus, "fox", 5).collect()} == {"fts"}
    assert {r.rank_source for r in hybrid.search(corpus, "fox?", 5).collect()} == set()
    assert hybrid.secret_variants("my token") == ["my token", "my", "token", "api key", "secret", "password", "credential"]
    with pytest.raises(KeyError):
        context.get_chunk(c, 99)


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_extractors(spark):
    t = "<a><t>{}</t></a>".format
    log = "\n".join([json.dumps({"timestamp": "2024-01-01", "payload": {"type": "message", "role": "user", "content": [{"text": ""}, {"input_text": " one "}, {"output_text": "two"}]}}), "bad", json.dumps({"payload": {"type": "other", "role": "user"}})])
    files = {
        "a.txt": "caf\xe9".encode("latin-1"), "a.csv": "﻿x, y ,\n\n1,2\n".encode(), "a.html": b"<p>A &amp;  b<script>x</script></p><p>c", "a.srt": "1\n00:00:01,000 --> 00:00:02,000\nHello\n\nNOTE x\n".encode(),
        "a.docx": zipped({"word/document.xml": t("doc")}), "a.pptx": zipped({f"ppt/slides/slide{k}.xml": t(f"s{k}") for k in (1, 2, 10)}),
        "a.xlsx": zipped({"xl/sharedStrings.xml": "<s><si><t>one</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>7</v></c><c t="s"><v>9</v></c></row></w>'}),
        "a.pdf": b"stream\n" + zlib.compress(b"(Hello) Tj <4869> Tj") + b"\nendstream", "a.zip": zipped({"b.txt": "B", "../up.txt": "no", "A.md": "a", "x.exe": "no", "e.txt": " "}),
        "a.mhtml": b"MIME-Version: 1.0\nContent-Type: text/html\n\n<p>m</p>", "bad.docx": b"no zip", "s.jsonl": log.encode(), "a.pb": b"\x00\x01abcd efgh\x02xy",
    }
    df = spark.createDataFrame([(p, "ai_session" if p == "s.jsonl" else "normal_file", bytearray(d)) for p, d in files.items()], "path string, kind string, content binary")
    rows = extract.records(df).collect()
    got = {r.source_path: r.text for r in rows if r.failed is None}
    assert got == {
        "a.txt": "caf�", "a.csv": "x | y\n1 | 2", "a.html": "A & b\nc", "a.srt": "Hello", "a.docx": "doc", "a.pptx": "s1\ns10\ns2", "a.xlsx": "one | 7", "a.pdf": "Hello\nHi", "a.zip#A.md": "a", "a.zip#b.txt": "B",
        "a.mhtml": "m", "s.jsonl#L1": "one\ntwo", "a.pb": "abcd efgh",
    }
    assert [r.source_path for r in rows if r.failed] == ["bad.docx"]


def test_session_and_fact_tables(spark):
    m = spark.createDataFrame([("x.db", 1, "s", "user", "hi", 1.5), ("x.db", 2, "z", "user", "yo", 2.0), ("x.db", 3, "s", "user", None, 3.0), ("y.db", 4, "s", "user", "other", 3.0)], "path string, id long, session_id string, role string, content string, timestamp double")
    s = spark.createDataFrame([("x.db", "s", "m1")], "path string, id string, model string")
    got = sorted((r.source_path, r.text, r.metadata["model"]) for r in extract.session_messages(m, s, "chat").collect())
    assert got == [("x.db#message:1", "hi", "m1"), ("x.db#message:2", "yo", ""), ("y.db#message:4", "other", "")]
    f = spark.createDataFrame([("x.db", 1, "water boils", "science", None, 0.5, "2024", "2024"), ("x.db", 2, None, "c", "t", 1.0, "", "")], "path string, fact_id long, content string, category string, tags string, trust_score double, created_at string, updated_at string")
    got = extract.facts(f, "notes").collect()
    assert [(r.source_path, r.source_kind, r.title, r.text, r.metadata["trust_score"], r.metadata["tags"]) for r in got] == [("x.db#fact:1", "ai_memory", "notes science", "water boils", "0.5", "")]


def test_tree_source(spark, tmp_path):
    for p in (".hidden/a.txt", "node_modules/b.js", "B/c.txt", "a.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    got = sorted(os.path.relpath(r.path, tmp_path) for r in listing.listed(spark, [str(tmp_path), str(tmp_path / "missing")]).collect())
    assert got == [".hidden/a.txt", "B/c.txt", "a.txt"]
    assert [r.path for r in listing.listed(spark, [str(tmp_path / "a.txt")]).collect()] == [str(tmp_path / "a.txt")]


def test_crawl_twice_change_and_delete(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for k in range(4):
        (root / f"f{k}.txt").write_text(f"words of file {k}")
    (root / "empty.txt").write_text("")
    (root / "pic.png").write_text("x")
    s = store.Store(spark, str(tmp_path / "store"))
    first = ingest.crawl(spark, s, [str(root)], T0)
    assert (first["discovered"], first["indexed"], first["skipped"], first["unchanged"]) == (6, 4, 2, 0)
    again = ingest.crawl(spark, s, [str(root)], T0)
    assert (again["indexed"], again["unchanged"]) == (0, 6)
    ids = {r.source_path: r.id for r in s.read("chunks").collect()}
    (root / "f0.txt").write_text("changed words")
    os.remove(root / "f1.txt")
    third = ingest.crawl(spark, s, [str(root)], T0 + timedelta(days=1))
    assert (third["indexed"], third["unchanged"]) == (1, 4)
    live = {r.source_path: r for r in s.read("chunks").filter("active").collect()}
    assert sorted(os.path.basename(p) for p in live) == ["f0.txt", "f2.txt", "f3.txt"]
    assert live[str(root / "f2.txt")].id == ids[str(root / "f2.txt")] and live[str(root / "f0.txt")].id > max(ids.values())
    assert {r.chunk_id for r in s.read("vectors").collect()} == {r.id for r in live.values()}
    assert {r.status for r in s.read("source_files").filter(F.col("path").endswith("f1.txt")).collect()} == {"deleted"}
    assert consistent(s)
    assert [r.source_path for r in hybrid.search(ingest.corpus(s, lambda t: [0.2] * 32), "changed", 5).filter("rank_source != 'vector'").collect()] == [str(root / "f0.txt")]
    before = {r.id: (r.source_path, r.active) for r in s.read("chunks").collect()}
    reader, copy = s.read("chunks"), s.copied(str(tmp_path / "copy"))
    assert len(copy.runs()) == 1 and copy.claimed() > max(s.runs())
    assert before == {r.id: (r.source_path, r.active) for r in copy.read("chunks").collect()} and consistent(copy)
    assert reader.count() == len(before)
    (root / "f3.txt").write_text("words after the copy")
    assert ingest.crawl(spark, copy, [str(root)], T0)["indexed"] == 1 and consistent(copy)
    jobs = s.read("index_jobs").orderBy("id").collect()
    assert [(j.status, j.indexed) for j in jobs] == [("completed", 4), ("completed", 0), ("completed", 1)]


def test_unreadable_files_keep_their_chunks(spark, tmp_path):
    """A file that can't be read is an error with its last chunks in place, whatever its format; a retry takes it up."""
    root = tmp_path / "data"
    root.mkdir()
    names = ("a.txt", "b.srt", "c.html", "d.txt")
    for n in names:
        (root / n).write_text(f"<p>first words of {n[0]}</p>")
    s = store.Store(spark, str(tmp_path / "store"))
    assert ingest.crawl(spark, s, [str(root)], T0)["indexed"] == 4
    before = {r.source_path: r.id for r in s.read("chunks").filter("active").collect()}
    for n in names[:3]:
        (root / n).write_text(f"<p>later words of {n[0]}</p>")
    real = listing.contents

    def torn(files):
        gone = F.endswith("path", F.lit("d.txt"))
        return real(files).withColumn("failed", F.when(~gone, "OSError: input/output error")).withColumn("content", F.when(gone, F.col("content")))

    listing.contents = torn
    try:
        out = ingest.crawl(spark, s, [str(root)], T0 + timedelta(days=1))
    finally:
        listing.contents = real
    assert (out["indexed"], out["error"], out["unchanged"]) == (0, 3, 1)
    assert {r.error for r in s.read("source_files").filter("status = 'error'").collect()} == {"OSError: input/output error"}
    assert before == {r.source_path: r.id for r in s.read("chunks").filter("active").collect()} and consistent(s)
    out = ingest.retry(s, T0 + timedelta(days=2))
    assert (out["retried"], out["indexed"], out["error"]) == (3, 3, 0)
    assert sum("later words" in r.text for r in s.read("chunks").filter("active").collect()) == 3 and consistent(s)
    rows = listing.contents(spark.createDataFrame([(str(root / "none"), "normal_file"), (str(root / "a.txt"), "normal_file")], "path string, kind string")).collect()
    assert [(r.content is None, r.failed) for r in rows] == [(True, "FileNotFoundError: No such file or directory"), (False, None)]


def test_winners_by_pushed_ids(spark, tmp_path):
    """The scan gets the ids, and passes over the row groups that have none of them."""
    rows = spark.range(4000).select("id", F.concat(F.lit("text "), "id").alias("text"), F.lit(True).alias("active"))
    path = str(tmp_path / "chunks")
    lookup.by_id_order(rows.repartition(8), "id").write.option("maxRecordsPerFile", 100).parquet(path)
    chunks = spark.read.parquet(path)
    ids = [5, 6, 7, 1234, *range(2000, 2030), 3999]
    hits = spark.createDataFrame([(k, i / 10) for i, k in enumerate(ids)], "chunk_id long, score double")
    got = lookup.winners(chunks.filter("active"), hits)
    assert {(r.chunk_id, r.text, r.score) for r in got.collect()} == {(k, f"text {k}", i / 10) for i, k in enumerate(ids)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan.partition("PushedFilters")[2].partition("ReadSchema")[0]
    few = lookup.by_ids(chunks, "id", ids).select("id")
    few.collect()
    leaves = few._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
    assert len(ids) <= read <= 500  # of 4000 rows, in row groups of 100
    assert lookup.by_ids(chunks, "id", []).count() == 0 and lookup.winners(chunks, hits.limit(0)).count() == 0


def test_many_winners(spark, tmp_path):
    """As many ids as several texts with a large limit have: no deep filter."""
    path = str(tmp_path / "chunks")
    lookup.by_id_order(spark.range(60_000), "id").write.parquet(path)
    ids = list(range(0, 54_000, 3))
    assert {r.id for r in lookup.by_ids(spark.read.parquet(path), "id", ids).collect()} == set(ids)


def test_tables_when_asked_for(spark, tmp_path):
    """Queries of chunks or terms write no postings and no vectors; chunks are in ranges of their ids, whatever the order of the documents."""
    from quarry.plans import corpus

    for t in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").orderBy(F.rand(1)).write.parquet(str(tmp_path / f"{t}.parquet"))
    there = str(tmp_path)
    of = {name: suite.QUERIES[name](spark, there) for name in ("snk5_deactivated_source", "agg11_terms")}
    assert {what for _, sf_dir, _, what in corpus._BUILT if sf_dir == there} == {"chunks", "terms"}
    assert of["snk5_deactivated_source"].count() == suite.QUERIES["snk5_deactivated_source"](spark, SF).count()
    rows = lambda df: sorted(map(tuple, df.select("term", "df", "tf").collect()))
    assert rows(of["agg11_terms"]) == rows(lexical.term_statistics(lexical.postings(corpus.chunk_table(spark, SF))))
    for name in ("documents", "mixed"):
        c = corpus.built(spark, there, name, "chunks")
        assert sorted(map(tuple, c.select("id", "text").collect())) == sorted(map(tuple, corpus.built(spark, SF, name, "chunks").select("id", "text").collect()))
        ends = sorted(map(tuple, c.groupBy(F.input_file_name()).agg(F.min("id"), F.max("id")).select("min(id)", "max(id)").collect()))
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("texts", [["fox quick", "quick NOT brown", '"brown fox"', "text:fo* OR zebra"], ["NEAR(quick fox, 2) OR ^title", "qu* fox*", "İstanbul"], ["(fox", "*", ""]])
def test_asked_postings(spark, texts):
    """A search in postings of its own terms alone finds what it finds in an index, with the same totals."""
    c = chunks_of(spark, TEXTS, inactive=(1, 5))
    index, total = indexed(c)
    own = lexical.asked(c, *texts).cache()
    assert lexical.totals_of_asked(own) == total and lexical.totals_of_asked(own.limit(0)) == lexical.Totals()
    rows = lambda *of: sorted(map(tuple, lexical.matched(*of, *texts).collect()))
    assert rows(own, total) == rows(index, total)
    slots = lexical.slots_of(lexical.phrases_of(lexical.read_all(texts)))
    named = F.lit(False)
    for w, prefix in slots:
        named |= F.col("term").startswith(w) if prefix else F.col("term") == w
    kept = own.filter("term <> ''")
    assert kept.exceptAll(index.filter(named)).isEmpty() and index.filter(named).exceptAll(kept).isEmpty()


def test_plain_words_without_an_expression(monkeypatch):
    """Texts that are ASCII once they are folded are cut without the regular expression, which finds the same; each ASCII character at a word's start, middle and end."""
    plain = ["", " ", "_", *(f"{c}A1{c}b{c}{c} Z_z{c}" for c in map(chr, range(128))), "Déjà vu, Çà"]
    want = [re.findall(r"[^\W_]+", t.translate(str.maketrans(S._FOLDED)).lower()) for t in plain]
    monkeypatch.setattr(match, "_RUN", None)
    assert [match.words_of(t) for t in plain] == want


def test_a_search_builds_no_index(spark, tmp_path):
    """One search of a folder makes postings of its own terms alone; where there is an index, it reads that."""
    from quarry.plans import corpus

    for t in ("documents", "conversations"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    there = str(tmp_path)
    rows = lambda: [sorted(map(tuple, suite.QUERIES[q](spark, there).select("chunk_id", "score").collect())) for q in ("hyb5_files", "hyb5_sessions")]
    alone = rows()
    assert {k[2:] for k in corpus._BUILT if k[1] == there} == {("mixed", "chunks"), ("mixed", ("asked", "thing")), ("mixed", "vectors")}
    whole = corpus.corpus(spark, there, "mixed")
    assert "bucket" in whole.postings.columns and whole.totals == corpus.corpus(spark, SF, "mixed", ["other"]).totals
    assert rows() == alone and "bucket" in corpus.corpus(spark, there, "mixed", ["thing"]).postings.columns


def test_folding():
    """Letter by letter what str.translate does."""
    for text in (*S._FOLDED, "".join(S._FOLDED), "Crème BRÛLÉE ß æ ø Ł İx ñ1_é", "日本 é"):
        assert match.words_of(text) == re.findall(r"[^\W_]+", text.translate(str.maketrans(S._FOLDED)).lower())


def test_bare_references(spark, tmp_path):
    """Character references without a semicolon: browsers read them, the pages' rule doesn't."""
    html = "<p>a&amp</p><p>x &ampy &#65 &lt;b&gt; &amp;lt; && &#66; &eacute; c&</p>"
    assert extract.visible_text(html) == "a&\nx &y A <b> &lt; && B é c&"
    assert extract.visible_text(html, bare=False) == "a&amp\nx &ampy &#65 <b> &lt; && B é c&"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert suite.QUERIES["src10_pages"](spark, str(tmp_path)).first()["text"] == extract.visible_text(html, bare=False)


def test_quantized_index(spark, tmp_path):
    """Recall of the codes against exact search, bytes on disk, odd widths, faults, and empty tables."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path, dim = str(tmp_path / "index"), 64
    quantized.quantized(e, dim).write.parquet(path)
    index = spark.read.parquet(path)
    assert index.agg(F.max(F.octet_length("codes"))).first()[0] == dim // 2  # of 4 * dim bytes
    queries = [r.embedding for r in e.filter("chunk_id % 50 = 7").collect()]
    same = found = 0
    for q in queries:
        exact = [(r.chunk_id, r.score) for r in vectors.nearest(e, q, 10).collect()]
        assert [(r.chunk_id, r.score) for r in quantized.nearest(index, e, q, 10).collect()] == exact
        same += len({i for i, _ in exact} & {r.chunk_id for r in quantized.candidates(index, q, 20).collect()})
        found += len(exact)
    assert same / found >= 0.95  # two candidates a result are enough
    odd = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, -2.0, 0.5]), (3, [1.0, -2.0, 0.5]), (4, None)], "chunk_id long, embedding array<float>")
    small = quantized.quantized(odd, 3)
    assert [(r.chunk_id, round(r.score, 6)) for r in quantized.nearest(small, odd, [1.0, 1.0, 2.0], 3).collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert quantized.nearest(small, odd, [1.0, 1.0, 2.0], 0).count() == 0 and quantized.nearest(small.limit(0), odd, [1.0, 1.0, 2.0], 5).count() == 0
    for bad, dim in ((odd, 4), (spark.createDataFrame([(1, [float("nan"), 1.0])], "chunk_id long, embedding array<float>"), 2)):
        with pytest.raises(Exception, match="expected|finite"):
            quantized.quantized(bad, dim).collect()
    with pytest.raises(Exception, match="expected"):
        quantized.candidates(small, [1.0] * 9, 3).collect()
    with pytest.raises(ValueError):
        quantized.nearest(small, odd, [1.0, 1.0, 2.0], -1)


def consistent(s):
    """Postings and totals are those of the live chunks."""
    c = s.read("chunks")
    own = lexical.postings(c)
    return s.totals() == lexical.totals(c, own) and own.exceptAll(s.read("postings").drop("bucket")).isEmpty() and s.read("postings").drop("bucket").exceptAll(own).isEmpty()


def written_bytes(s, before):
    return s.size_bytes() - before


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    """What a change of one file writes doesn't grow with the corpus."""
    cost = []
    for n in (4, 64):
        root = tmp_path / f"data{n}"
        root.mkdir()
        for k in range(n):
            (root / f"f{k}.txt").write_text(" ".join(f"w{k}x{i}" for i in range(2000)))
        s = store.Store(spark, str(tmp_path / f"store{n}"))
        ingest.crawl(spark, s, [str(root)], T0)
        (root / "f0.txt").write_text(" ".join(f"new{i}" for i in range(2000)))
        before = s.size_bytes()
        assert ingest.crawl(spark, s, [str(root)], T0)["indexed"] == 1
        cost.append(s.size_bytes() - before)
    assert cost[1] < 1.2 * cost[0]


def test_two_writers(spark, tmp_path):
    """Two crawls at once both count, with ids of their own; of a file that both touch, one state and its chunks."""
    roots = []
    for n in range(2):
        root = tmp_path / f"data{n}"
        root.mkdir()
        (root / "own.txt").write_text(f"words of writer {n}")
        roots.append(str(root))
    both = tmp_path / "both"
    both.mkdir()
    (both / "f.txt").write_text("words of both")
    s = store.Store(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(8) as pool:
        claimed = list(pool.map(lambda _: s.claimed(), range(40)))
        assert len(set(claimed)) == 40
        outs = list(pool.map(lambda r: ingest.crawl(spark, store.Store(spark, s.path), [r, str(both)], T0), roots))
    assert [o["indexed"] for o in outs] == [2, 2]
    live = s.read("chunks").filter("active").collect()
    assert sorted(r.text for r in live) == ["words of both", "words of writer 0", "words of writer 1"]
    assert len({r.id for r in live}) == 3 == s.read("source_files").count() and consistent(s)
    assert {r.chunk_id for r in s.read("vectors").collect()} == {r.id for r in live}
    assert [j.status for j in s.read("index_jobs").collect()] == ["completed"] * 2
    s.put("index_jobs", store.background_error(s.read("index_jobs"), "boom", F.lit(T0)).orderBy(F.desc("id")).limit(1))
    last = context.latest(s.read("index_jobs")).first()
    assert (last.root_path, last.status, last.error, last.finished_at) == ("background", "error", 1, T0)
    assert context.shown_job(context.by_id(s.read("index_jobs"), last.id)).first().error_count == 1


def files_read(df):
    """The folders of the files that df reads."""
    return {os.path.basename(os.path.dirname(f)) for f in df.inputFiles() if "/run=" in f}


def test_a_change_reads_its_own_files_only(spark, tmp_path):
    """What a run reads of chunks and vectors is in the runs, and there in the row groups, of its files; a crawl without changes reads none."""
    root = tmp_path / "data"
    root.mkdir()
    s = store.Store(spark, str(tmp_path / "store"))
    shared.checkpointed(spark.range(1))
    for n in range(3):
        for k in range(4):
            (root / f"r{n}f{k}.txt").write_text(f"words of file {k} of run {n}")
        assert ingest.crawl(spark, s, [str(root)], T0)["indexed"] == 4
    second = s.runs()[1]
    states = s.files(spark.createDataFrame([(str(root / "r1f2.txt"),)], "path string").select(store.place_of("path").alias("place"))).checkpoint()
    for name in ("chunks", "vectors"):
        rows = s.rows_of(name, states)
        assert files_read(rows) == {f"run={second}"} and rows.count() == 1
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*place", plan)
    # Chunks and vectors of all other runs can be away: neither a quiet crawl nor one of a single file opens them.
    for n in (s.runs()[0], s.runs()[2]):
        for name in ("chunks", "vectors", "postings"):
            os.rename(f"{s.path}/{name}/run={n}", tmp_path / f"away-{name}-{n}")
    assert ingest.crawl(spark, s, [str(root)], T0)["unchanged"] == 12
    (root / "r1f2.txt").write_text("other words")
    assert ingest.crawl(spark, s, [str(root)], T0)["indexed"] == 1
    for n in s.runs()[:1] + s.runs()[2:3]:
        for name in ("chunks", "vectors", "postings"):
            os.rename(tmp_path / f"away-{name}-{n}", f"{s.path}/{name}/run={n}")
    assert s.read("chunks").filter("active").count() == 12 and consistent(s)


def test_failed_run_is_never_read(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    (root / "a.txt").write_text("first words")
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.crawl(spark, s, [str(root)], T0)
    (root / "a.txt").write_text("later words")
    real = store.Store.publish
    store.Store.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver"))
    try:
        with pytest.raises(RuntimeError, match="lost driver"):
            ingest.crawl(spark, s, [str(root)], T0)
    finally:
        store.Store.publish = real
    assert [r.text for r in s.read("chunks").filter("active").collect()] == ["first words"] and consistent(s)
    assert ingest.crawl(spark, s, [str(root)], T0)["indexed"] == 1
    assert [r.text for r in s.read("chunks").filter("active").collect()] == ["later words"] and consistent(s)


def test_files_at_one_place(spark, tmp_path, monkeypatch):
    """Files whose numbers are equal are written together: a change of one keeps the other."""
    monkeypatch.setattr(store, "place_of", lambda c: F.lit(7).cast("long"))
    root = tmp_path / "data"
    root.mkdir()
    for n in "ab":
        (root / f"{n}.txt").write_text(f"first words of {n}")
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.crawl(spark, s, [str(root)], T0)
    (root / "a.txt").write_text("later words of a")
    assert ingest.crawl(spark, s, [str(root)], T0)["unchanged"] == 1
    assert sorted(r.text for r in s.read("chunks").filter("active").collect()) == ["first words of b", "later words of a"] and consistent(s)
    assert s.read("source_files").count() == 2 == s.read("vectors").count()


def test_paused_crawl_goes_on(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for k in range(12):
        (root / f"f{k}.txt").write_text(f"words of file {k}")
    s, asked = store.Store(spark, str(tmp_path / "store")), []
    out = ingest.crawl(spark, s, [str(root)], T0, flush=4, pause=lambda: asked.append(1) or len(asked) > 1)
    job = context.latest(s.read("index_jobs")).first()
    assert out["paused"] and 0 < out["indexed"] < 12 and out["indexed"] + out["left"] == 12
    assert (job.status, job.indexed, job.finished_at) == ("paused", out["indexed"], T0)
    assert s.read("chunks").filter("active").count() == out["indexed"] and consistent(s)
    rest = ingest.crawl(spark, s, [str(root)], T0)
    assert (rest["indexed"], rest["unchanged"], rest["paused"]) == (out["left"], out["indexed"], 0) and consistent(s)


def test_unreadable_folders_retire_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "data"
    (root / "deep").mkdir(parents=True)
    (root / "deep" / "f.txt").write_text("words in a folder")
    (root / "g.txt").write_text("other words")
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.crawl(spark, s, [str(root)], T0)
    entries = listing.TreeReader._entries
    denied = lambda self, folder: ([], "PermissionError: denied") if folder == str(root) else entries(self, folder)
    reader = listing.TreeReader([str(root)], ())
    monkeypatch.setattr(listing.TreeReader, "_entries", denied)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert rows == [(str(root), str(root), None, None, "PermissionError: denied")]
    monkeypatch.setattr(listing, "listed", lambda *a: spark.createDataFrame(rows, listing.LISTING))
    out = ingest.crawl(spark, s, [str(root)], T0)
    assert out["unreadable"] == 1 and s.read("chunks").filter("active").count() == 2
    assert {r.status for r in s.read("source_files").collect()} == {"indexed"}


def test_failed_embedder_retry_and_rebuild(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for k in range(3):
        (root / f"f{k}.txt").write_text(f"words of file {k}")
    s = store.Store(spark, str(tmp_path / "store"))

    def broken(chunks):
        return chunks.select(F.col("id").alias("chunk_id"), F.array(F.raise_error(F.lit("a fault")).cast("float")).alias("embedding"))

    with pytest.raises(Exception, match="a fault"):  # no matter of the model's server
        ingest.crawl(spark, s, [str(root)], T0, embed=broken)
    assert s.read("source_files").count() == 0

    def refused(model, texts):
        raise vectors.ClientError("no model", 401)

    down = vectors.ClientEmbedder(refused, ("m",), dim=32).chunks
    out = ingest.crawl(spark, s, [str(root)], T0, embed=down)
    assert out["indexed"] == 0 and {(r.status, "no model" in r.error) for r in s.read("source_files").collect()} == {("vector_pending", True)}
    assert {(r.active, r.vector_status) for r in s.read("chunks").collect()} == {(False, "vector_pending")}
    os.remove(root / "f2.txt")
    out = ingest.retry(s, T0)
    assert (out["retried"], out["missing"], out["indexed"]) == (3, 1, 2) and s.read("vectors").count() == 2 and consistent(s)
    kept = s.read("vectors", whole=True).orderBy("chunk_id").limit(1).checkpoint()
    s.write("vectors", kept, s.runs()[-1])  # as if a vector were lost
    assert [r.physical_path for r in ingest.recent_without_vectors(s.read("chunks"), s.read("vectors")).collect()] and ingest.rebuild_vectors(s) == 1
    assert s.read("vectors").count() == 2 and ingest.rebuild_vectors(s) == 0


def test_budget(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    (root / "a.txt").write_text("some words")
    s = store.Store(spark, str(tmp_path / "store"))
    with pytest.raises(ingest.BudgetExceeded):
        ingest.crawl(spark, s, [str(root)], T0, budget=ingest.Budget(stop=1))
    job = s.read("index_jobs").first()
    assert job.status == "error" and "allowed" in job.message
    assert ingest.Budget(100, 120).checked(79) == "ok" and ingest.Budget(100, 120).checked(80) == "warning"
    ingest.crawl(spark, s, [str(root)], T0, flush=1)
    used = s.usage()
    assert used["tables"] > 0 < used["vectors"] and used["total"] == used["tables"] + used["vectors"] + used["logs"] + used["other"]


def test_diagnostics(spark):
    c = chunks_of(spark, ["token=abc", "plain"])
    jobs = store.created_job(spark.createDataFrame([], store.JOBS), "root", F.lit(T0))
    files = spark.createDataFrame([("a", "normal_file", "f", 1, 1, "indexed", None, T0, T0)], store.SOURCE_FILES)
    got = json.loads(context.diagnostics(jobs, files, c, 1, redact=True).first()[0])
    assert got["latest_job"]["root_path"] == "root" and got["active_chunk_counts"] == [{"source_kind": "normal_file", "chunks": 2}]
    assert got["source_status_counts"] == [{"source_kind": "normal_file", "status": "indexed", "files": 1}] and got["chunk_samples"][0]["text"] == "token=[REDACTED_SECRET]"


class FakeClient:
    """Fails as told before it answers."""

    def __init__(self, *failures):
        self.failures = list(failures)
        self.asked = []

    def __call__(self, model, texts):
        self.asked.append((model, len(texts)))
        if self.failures and (status := self.failures.pop(0)) is not True:
            raise vectors.ClientError("failed", status)
        return [[float(len(t)), 1.0] for t in texts]


def test_client_embedder(spark):
    def answer(model, texts):
        return [[float(len(t)), float(len(texts))] for t in texts]

    waits = []
    client = FakeClient(503, None, True)
    e = vectors.ClientEmbedder(client, ("m",), dim=2, max_chars=5, wait=waits.append)
    assert e.query("too long") == [5.0, 1.0] and waits == [1.0, 2.0] and len(client.asked) == 3
    for failures in ((400,), (429, 500, 503)):
        with pytest.raises(OSError):
            vectors.ClientEmbedder(FakeClient(*failures), ("m",), dim=2, wait=waits.append).query("x")
    client = FakeClient(404)
    assert vectors.ClientEmbedder(client, ("m", "n"), dim=2).batch(["x"])[1] == 1 and [m for m, _ in client.asked] == ["m", "n"]
    with pytest.raises(ValueError):
        vectors.ClientEmbedder(answer, ("m",), dim=3).query("x")
    e = vectors.ClientEmbedder(answer, ("m",), dim=2, batch_size=2)
    df = spark.createDataFrame([(k, "x" * k) for k in range(5)], "id long, text string").coalesce(1)
    assert sorted((r.chunk_id, *r.embedding) for r in e.chunks(df).collect()) == [(0, 0.0, 2.0), (1, 1.0, 2.0), (2, 2.0, 2.0), (3, 3.0, 2.0), (4, 4.0, 1.0)]


def test_ids_in_key_order(spark):
    new = spark.createDataFrame([(f"p{k:02d}", 0, "h", "t") for k in range(40)], "source_path string, ordinal int, content_hash string, title string").repartition(5)
    got = store.gapless(new, store.KEY, "id", 100).orderBy("source_path").collect()
    assert [r.id for r in got] == list(range(100, 140))


def test_repeated_ids_activate_once(spark):
    c = chunks_of(spark, ["a", "b"], inactive={0, 1})
    ids = spark.createDataFrame([(0, "f0.txt"), (0, "f0.txt")], "chunk_id long, physical_path string")
    assert sorted((r.id, r.active) for r in store.activated(c, ids, F.lit(T0))[0].collect()) == [(0, True), (1, False)]


def test_labels(spark):
    sizes = {0: "0 KB", 512: "1 KB", 1010 * 1024: "1010 KB", 1 << 20: "1.0 MB", 5 << 30: "5.00 GB"}
    df = spark.createDataFrame([(k,) for k in sizes], "b long")
    assert [r[0] for r in df.select(S.byte_label(F.col("b"))).collect()] == list(sizes.values())
    rows = [({"start_line": "3"}, "Line 3"), ({"start_line": "3", "end_line": "3"}, "Line 3"), ({"start_line": "3", "end_line": "9"}, "Lines 3-9"), ({}, None), ({"start_line": ""}, None)]
    df = spark.createDataFrame([(m,) for m, _ in rows], "m map<string,string>")
    assert [r[0] for r in df.select(S.line_label(F.col("m"))).collect()] == [x for _, x in rows]
    names = [("a/.env", "ENV"), ("a/b.tar.gz#c.d", "GZ"), ("a.b/c", "File")]
    df = spark.createDataFrame([(p,) for p, _ in names], "p string")
    none = F.create_map().cast("map<string,string>")
    assert [r[0] for r in df.select(S.type_label(none, F.lit("normal_file"), F.col("p"))).collect()] == [x for _, x in names]


def test_odd_scalars(spark):
    """Cases that the registered queries' names don't have."""
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    for text, day in (("2024-02-29", "2024-02-29"), ("20240302", "2024-03-02"), ("2024-02-30", None), ("soon", None), (" 2024-03-05 ", "2024-03-05"), ("2024-03-01T10:00:00Z", "2024-03-01")):
        assert str(one(S.iso_date(F.lit(text)))) == str(day)
    for text, n in (("7", 7), (" 12 ", 12), ("0", None), ("-3", None), ("x", None), ("2.5", None)):
        assert one(S.positive_int(F.lit(text))) == n
    for text, kind in ((" Source_Code ", "code"), ("AI_SESSION", "session"), ("Captions", "transcript"), ("odd_one", "odd-one"), ("settings", "config")):
        assert one(S.normalized_type(F.lit(text))) == kind
    for line, level in (("12:00 ERROR disk", "error"), ("12:00 INFO WARNING ok", "info"), ("12:00 error disk", ""), ("ERROR", "")):
        assert one(S.log_level(F.lit(line))) == level
    for line, is_code in (("00:00:01,123 --> x", True), ("0:00:01.5004", True), ("00:00:01", False)):
        assert one(S.is_timecode(F.lit(line))) is is_code
    for path, ext in (("notes/.env", ""), ("a/b#L12", ""), ("arch/x.tar.gz", ".gz"), ("doc/Readme.md#message:3", ".md"), ("noext", "")):
        assert one(S.result_extension(F.create_map().cast("map<string,string>"), F.lit(path))) == ext
    with pytest.raises(ValueError):
        S.without_bom(F.lit("x"), "latin-1")




def test_stream_resumes(spark, tmp_path):
    s, source = store.Store(spark, str(tmp_path / "store")), str(tmp_path / "in")

    def put(n, text):
        spark.createDataFrame([(f"s{n}.txt", "normal_file", "t", text, {})], RECORD).coalesce(1).write.mode("append").parquet(source)

    put(1, "one")
    put(2, "two")
    for expected in (2, 3):
        ingest.stream(spark, s, source, RECORD, str(tmp_path / "cp")).awaitTermination()
        assert s.read("chunks").filter("active").count() == expected == s.read("vectors").count()
        put(3, "three")


def test_scan_status(spark):
    """Reasons in their order; a start that failed moves no due time; nulls hold back."""
    h = timedelta(hours=1)
    jobs = spark.createDataFrame(
        [(1, "a", "completed", "", T0), (2, "a", "error", "no start", None), (3, "b", "running", "", T0), (4, "c", "completed", "", T0 - h), (5, "f", "paused", "", T0), (6, "gone", "running", "", T0), (7, "g", "error", "no start", None)],
        "id long, root_path string, status string, message string, started_at timestamp",
    )
    plans = [("a", True, 3600, False), ("b", True, 60, False), ("c", True, 3600, True), ("d", True, 3600, False), ("e", None, 3600, False), ("f", False, 1, False), ("g", True, 3600, None), ("h", True, None, False)]
    schedules = spark.createDataFrame(plans, "root_path string, enabled boolean, interval_seconds long, busy boolean")

    def at(now):
        return {r.root_path: r for r in status.scans(jobs, schedules, F.lit(now), {"cluster_busy": F.col("busy")}).collect()}

    rows = at(T0 + h / 2)
    assert {k: r.reason for k, r in rows.items()} == {"a": "waiting_for_interval", "b": "scan_running", "c": "cluster_busy", "d": None, "e": "disabled", "f": "disabled", "g": "cluster_busy", "h": None}
    assert (rows["a"].last_job, rows["a"].last_message, rows["a"].last_triggered_at, rows["a"].next_due_at) == (2, "no start", T0, T0 + h)
    assert (rows["d"].last_job, rows["d"].next_due_at, rows["g"].last_triggered_at, rows["g"].last_job) == (None, None, None, 7)
    assert at(T0 + h)["a"].reason is None
    assert status.scans(jobs.limit(0), schedules.limit(0), F.lit(T0)).count() == 0
    assert {r.reason for r in status.scans(jobs.limit(0), schedules.limit(2), F.lit(T0)).collect()} == {None}


def test_stream_status(spark, tmp_path):
    """Two triggers of one query, a query that fails, and one that waits for its next trigger."""
    log, source = status.Progress(spark, str(tmp_path / "progress")), str(tmp_path / "in")
    spark.streams.addListener(log)

    def started(name, batch, **trigger):
        read = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        return read.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / name)).trigger(**trigger).start()

    def broken(df, n):
        raise ValueError("a fault")

    def seen(state, q):
        for _ in range(100):  # events come a little later than what they tell of
            row = status.streams(log.read(), 3600).filter(F.col("id") == q.id).first()
            if row and row.state in state:
                return row
            time.sleep(0.2)
        raise AssertionError(row)

    try:
        for _ in range(2):
            spark.range(3).coalesce(1).write.mode("append").parquet(source)
        one = started("one", lambda df, n: df.count(), availableNow=True)
        one.awaitTermination()
        row = seen({"stopped"}, one)
        assert (row.batches, row.rows, row.next_due_at, row.error) == (2, 6, None, None) and row.last_run_at
        two = started("two", broken, availableNow=True)
        with pytest.raises(Exception, match="a fault"):
            two.awaitTermination()
        assert "a fault" in seen({"failed"}, two).error
        three = started("three", lambda df, n: None, processingTime="1 hour")
        row = seen({"running", "waiting"}, three)
        for _ in range(50):
            if row.last_run_at:
                break
            time.sleep(0.2)
            row = seen({"running", "waiting"}, three)
        assert row.next_due_at == row.last_run_at + timedelta(hours=1)
        three.stop()
        assert seen({"stopped"}, three).next_due_at is None
    finally:
        spark.streams.removeListener(log)


def test_jobs_and_saved_searches(spark):
    jobs = spark.createDataFrame([(1, "r", "running", 0, 0, 0, 0, "", T0, T0, None)], store.JOBS)
    now = F.lit(T0 + timedelta(1))
    assert store.updated_job(jobs, 1, "running", "m", now, indexed=3).first().finished_at is None
    assert store.updated_job(jobs, 1, "completed", "m", now).first().finished_at is not None
    none = spark.createDataFrame([], store.SAVED_SEARCHES)
    one = store.saved_search(none, "a", "q", {}, now)
    two = store.saved_search(store.saved_search(one, "b", "q", {}, now), "a", "q2", {"k": "v"}, now)
    assert sorted((r.id, r.name, r.query) for r in two.collect()) == [(1, "a", "q2"), (2, "b", "q")]
