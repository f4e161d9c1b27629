"""The registered queries over the fixture tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import context, filters, hybrid, lexical, quantized, store, vectors
from .plans import corpus as P
from .shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TEXT = "attion thing"
FILTERS = {"project": "src1", "extension": "txt"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def chunk_ctes(records: str) -> str:
    """CTEs up to `chunks`, from records with doc_id, base (the first chunk's id), source, lang, source_path, source_kind, extension, title and text."""
    return rf"""
rec AS ({records}), wl AS (
  SELECT rec.* EXCLUDE (text), flatten(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'),
         lambda l, i: list_transform(list_filter(regexp_split_to_array(l, '[\s\x0b\x1c-\x1f]+'), lambda x: x <> ''), lambda x: {{'word': x, 'line': i}}))) AS ws
  FROM rec
), wn AS (
  SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(greatest(0, ceil((len(ws) - 900) / 780.0)) AS BIGINT) + 1 END)) AS ordinal FROM wl
), wp AS (
  SELECT * EXCLUDE (ws), ws[ordinal * 780 + 1 : ordinal * 780 + 900] AS part FROM wn
), chunks AS (
  SELECT base + ordinal AS id, doc_id, source, lang, source_path, source_kind, extension, title, CAST(ordinal AS INTEGER) AS ordinal,
         array_to_string(list_transform(part, lambda p: p.word), ' ') AS text, CAST(part[1].line AS INTEGER) AS start_line, CAST(part[-1].line AS INTEGER) AS end_line,
         source <> 'src3' AS active, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS updated_at
  FROM wp
)"""


#: The chunk tables in SQL: of documents, and of active documents and conversations (`P.mixed_chunks`).
DOCUMENTS = """SELECT doc_id, doc_id * 65536 AS base, source, lang, 'doc/' || source || '/' || doc_id || '.txt' AS source_path, 'normal_file' AS source_kind, '.txt' AS extension, 'document ' || doc_id AS title, text FROM documents"""
CHUNKS = chunk_ctes(DOCUMENTS)
MIXED = chunk_ctes(
    DOCUMENTS.replace("'.txt' AS extension", "CASE WHEN source = 'src2' THEN '.yaml' ELSE '.txt' END AS extension")
    + """ WHERE source <> 'src3' UNION ALL SELECT 0, 1099511627776 + (conv_id * 4096 + turn) * 64, 'chat', '', 'chat/' || conv_id || '.jsonl#message:' || turn, 'ai_session', '.jsonl', 'chat ' || role, text
FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''"""
)


def terms(chunks: str) -> str:
    return (
        chunks
        + r""", tok AS (
  SELECT id, active, source_path, source_kind, extension, title, text, source, regexp_extract_all(strip_accents(lower(title)), '[\p{L}\p{N}]+') AS tt, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS tx FROM chunks
), st AS (
  SELECT count(*) AS total, avg(len(tt) + len(tx)) AS mean FROM tok
), term AS (
  SELECT id, t AS term, count(*) AS f FROM (SELECT id, unnest(tt || tx) AS t FROM tok) GROUP BY ALL
)"""
    )


TERMS = terms(CHUNKS)


def weight(f: str, n: str) -> str:
    idf = f"ln((total - {n} + 0.5) / ({n} + 0.5))"
    return f"-(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * (len(tt) + len(tx)) / mean))"


def lexical_ctes(words: list[str], every: bool = True, name: str = "") -> str:
    """CTE `lex<name>(id, score)` for chunks with all, or any, of the words."""
    names = ", ".join(f"'{w}'" for w in words)
    return f"""hit{name} AS (SELECT * FROM term WHERE term IN ({names})), cnt{name} AS (SELECT term, count(*) AS n FROM hit{name} GROUP BY term),
lex{name} AS (SELECT id, sum({weight('f', 'n')}) AS score FROM hit{name} JOIN cnt{name} USING (term) JOIN tok USING (id) CROSS JOIN st GROUP BY id HAVING count(*) >= {len(words) if every else 1})"""


def hits(words: list[str], every: bool = True) -> str:
    return f"{TERMS}, {lexical_ctes(words, every)}"


def embedded(dim: int) -> str:
    return f"""raw AS (SELECT id, list_transform(range(0, {dim}), lambda i: CAST(('0x' || substr(sha256(text), CAST((i % 32) * 2 + 1 AS BIGINT), 2)) AS INTEGER) / 255.0::DOUBLE) AS r FROM chunks),
vec AS (SELECT id, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS embedding FROM raw)"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search, the flagship."""
    return QUERIES["hyb1_search"](spark, sf_dir)


# Chunking and scalars


@query("win5_chunks", f"WITH {CHUNKS} SELECT id, source_path, ordinal, sha256(text) AS content_hash, start_line, end_line, active FROM chunks")
def win5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made from the documents, not read from the table that was built."""
    lines = [F.element_at("metadata", k).cast("int").alias(k) for k in ("start_line", "end_line")]
    return P.chunked_documents(spark, sf_dir).select("id", "source_path", "ordinal", "content_hash", *lines, "active")


@query("scl1_hashes", r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g'))) AS content_hash,
  sha256('doc/' || source || '/' || doc_id || '.txt|' || strlen(text) || '|0') AS fingerprint FROM documents""")  # fmt: skip
def scl1_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.document_records(spark, sf_dir)
    return r.select("doc_id", S.content_hash(F.col("text")).alias("content_hash"), S.file_fingerprint(F.col("source_path"), F.octet_length("text"), F.lit(0)).alias("fingerprint"))


@query("udf1_embedding", f"WITH {CHUNKS}, {embedded(32)} SELECT id AS chunk_id, round(list_sum(embedding), 9) AS total, round(embedding[32], 9) AS last FROM vec")
def udf1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.embedded(P.chunk_table(spark, sf_dir), 32)
    return v.select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), F.round(F.element_at("embedding", 32), 9).alias("last"))


def redacted_sql(column: str) -> str:
    """The assignments with double quotes, single quotes and none, then tokens: RE2 has no references back to a quote."""
    name = rf"(?i)([A-Za-z0-9_.-]*(?:{S.SECRET_NAMES})[A-Za-z0-9_.-]*)(\s*[:=]\s*)"
    for quote in ('"', "''", ""):
        column = rf"regexp_replace({column}, '{name}{quote}[^\s\"'';&]+{quote}', '\1\2{quote}[REDACTED_SECRET]{quote}', 'g')"
    return f"regexp_replace({column}, '{S.SECRET_TOKEN}', '[REDACTED_SECRET]', 'g')"


@query("scl16_redaction", f"SELECT doc_id, {redacted_sql('text')} AS text FROM documents")
def scl16_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", S.redacted(F.col("text")).alias("text"))


# Lexical search


@query("agg11_terms", f"WITH {TERMS} SELECT term, count(*) AS df, CAST(sum(f) AS BIGINT) AS tf FROM term GROUP BY term")
def agg11_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.terms(spark, sf_dir)


def scores(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    c = P.corpus(spark, sf_dir, asked=[text])
    return lexical.matched(c.postings, c.totals, text).filter("active").select("chunk_id", F.round("score", 9).alias("score"))


SCORED = " SELECT id AS chunk_id, round(score, 9) AS score FROM lex JOIN tok USING (id) WHERE active"


@query("txt1_term", f"WITH {hits(['thing'])}{SCORED}")
def txt1_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "Thing")


@query("txt1_and", f"WITH {hits(['attion', 'thing'])}{SCORED}")
def txt1_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "attion AND thing")


@query("txt1_or", f"WITH {hits(['attion', 'thing', 'eaux'], False)}{SCORED}")
def txt1_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "attion OR thing OR eaux")


@query("txt1_not", f"WITH {hits(['thing'])}{SCORED} AND NOT list_contains(tt || tx, 'attion')")
def txt1_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "thing NOT attion")


@query("txt1_phrase", f"""WITH {TERMS}, ph AS (SELECT *, len(list_filter(range(1, len(tx)), lambda i: tx[i] = 'attion' AND tx[i + 1] = 'to')) AS f FROM tok), pn AS (SELECT count(*) AS n FROM ph WHERE f > 0)
SELECT id AS chunk_id, round({weight('f', 'n')}, 9) AS score FROM ph CROSS JOIN pn CROSS JOIN st WHERE f > 0 AND active""")  # fmt: skip
def txt1_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, 'text:"attion to"')


@query("txt1_prefix", f"""WITH {TERMS}, ph AS (SELECT *, len(list_filter(tt || tx, lambda t: starts_with(t, 'attion'))) AS f FROM tok), pn AS (SELECT count(*) AS n FROM ph WHERE f > 0)
SELECT id AS chunk_id, round({weight('f', 'n')}, 9) AS score FROM ph CROSS JOIN pn CROSS JOIN st WHERE f > 0 AND active""")  # fmt: skip
def txt1_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "attion*")


def positions(word: str) -> str:
    return f"""list_filter(range(0, len(tt)), lambda i: tt[i + 1] = '{word}') || list_transform(list_filter(range(0, len(tx)), lambda i: tx[i + 1] = '{word}'), lambda i: i + 16777216)"""


@query("txt1_near", f"""WITH {TERMS}, ps AS (SELECT *, {positions('attion')} AS pa, {positions('to')} AS pb FROM tok),
pe AS (SELECT *, list_filter(list_distinct(pa || pb), lambda m: len(list_filter(pa, lambda a: a <= m AND a >= m - 6)) > 0 AND len(list_filter(pb, lambda b: b <= m AND b >= m - 6)) > 0) AS ends FROM ps),
pf AS (SELECT *, len(list_filter(pa, lambda a: len(list_filter(ends, lambda m: a <= m AND a >= m - 6)) > 0)) AS fa, len(list_filter(pb, lambda b: len(list_filter(ends, lambda m: b <= m AND b >= m - 6)) > 0)) AS fb,
  len(list_filter(pa, lambda a: a = 0 OR a = 16777216)) AS ff FROM pe),
pn AS (SELECT count(*) FILTER (len(pa) > 0) AS na, count(*) FILTER (len(pb) > 0) AS nb, count(*) FILTER (ff > 0) AS nf FROM pf)
SELECT id AS chunk_id, round(CASE WHEN fa > 0 THEN {weight('fa', 'na')} + {weight('fb', 'nb')} ELSE 0 END + CASE WHEN ff > 0 THEN {weight('ff', 'nf')} ELSE 0 END, 9) AS score
FROM pf CROSS JOIN pn CROSS JOIN st WHERE active AND (fa > 0 OR ff > 0)""")  # fmt: skip
def txt1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "NEAR(attion to, 5) OR ^attion")


@query("txt2_top20", f"WITH {hits(['attion', 'thing'])} SELECT id AS chunk_id, source_path, round(score, 9) AS score FROM lex JOIN tok USING (id) WHERE active ORDER BY lex.score, id LIMIT 20")
def txt2_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.corpus(spark, sf_dir, asked=[TEXT])
    return lexical.lexical_search(c.chunks, c.postings, c.totals, TEXT).select("chunk_id", "source_path", F.round("score", 9).alias("score"))


@query("txt3_snippets", rf"""WITH {CHUNKS}, w AS (SELECT id, string_split(text, ' ') AS ws FROM chunks WHERE active),
m AS (SELECT *, greatest(0, len(ws) - 8) AS last, list_filter(range(0, len(ws)), lambda i: list_has_any(regexp_extract_all(strip_accents(lower(ws[i + 1])), '[\p{{L}}\p{{N}}]+'), ['attion', 'thing'])) AS hits FROM w),
b AS (SELECT *, list_distinct(list_transform(hits, lambda i: least(i, last))) AS starts FROM m),
c AS (SELECT *, list_max(list_transform(starts, lambda s: len(list_filter(hits, lambda j: j >= s AND j < s + 8)))) AS most FROM b),
d AS (SELECT *, coalesce(list_min(list_filter(starts, lambda s: len(list_filter(hits, lambda j: j >= s AND j < s + 8)) = most)), 0) AS s FROM c)
SELECT id, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(ws[s + 1 : s + 8], ' ') || CASE WHEN s < last THEN '...' ELSE '' END AS snippet FROM d""")  # fmt: skip
def txt3_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return c.filter("active").select("id", lexical.snippet(F.col("text"), F.array(F.lit("attion"), F.lit("thing"))).alias("snippet"))


# Vectors and hybrid search


@query("vec1_topk", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), e), 9) AS score FROM embeddings CROSS JOIN q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), e) DESC, vec_id LIMIT 50""")  # fmt: skip
def vec1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    q = v.orderBy("chunk_id").select("embedding").first()[0]
    return vectors.nearest(v, q, 50).select("chunk_id", F.round("score", 9).alias("score"))


def semantic_ctes(text: str, n: int, k: int, name: str = "") -> str:
    """CTE `sem<name>(id, score)`, after `embedded`."""
    q = ", ".join(repr(x) for x in P.query_vector(text))
    return f"""near{name} AS (SELECT id, list_dot_product(embedding, [{q}]::DOUBLE[]) AS score FROM vec ORDER BY score DESC, id LIMIT {k}),
sem{name} AS (SELECT id, score FROM near{name} JOIN chunks USING (id) WHERE active ORDER BY score DESC, id LIMIT {n})"""


@query("vec2_topk", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
SELECT vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), e), 9) AS score FROM embeddings CROSS JOIN q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), e) DESC, vec_id LIMIT 10""")  # fmt: skip
def vec2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a quantized index, written like an ingest would, and the exact vectors of its best."""
    v = P.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    q = v.orderBy(F.desc("chunk_id")).first()["embedding"]
    path = new_path(spark, "quantized")
    quantized.quantized(v, len(q)).write.parquet(path)
    return quantized.nearest(spark.read.parquet(path), v, q, 10).withColumn("score", F.round("score", 9))


@query("sem1_search", f"WITH {CHUNKS}, {embedded(P.DIM)}, {semantic_ctes(TEXT, 10, 80)} SELECT id AS chunk_id, source_path, substr(text, 1, 240) AS snippet, round(score, 9) AS score FROM sem JOIN chunks USING (id)")
def sem1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.semantic(P.corpus(spark, sf_dir, asked=[TEXT]), TEXT, limit=10).select("chunk_id", "source_path", "snippet", F.round("score", 9).alias("score"))


def fused_ctes(words: list[str], text: str, n: int, k: int, limit: int, where: str = "true", name: str = "") -> str:
    """CTE `g<name>(id, score, lists, list, place, rank)`: both lists filtered, cut and fused."""
    return f"""{lexical_ctes(words, name=name)}, {semantic_ctes(text, n, k, name)},
a{name} AS (SELECT id, row_number() OVER (ORDER BY s.score DESC, id) AS rank FROM sem{name} s JOIN chunks USING (id) WHERE {where} QUALIFY rank <= {limit}),
b0{name} AS (SELECT id, l.score FROM lex{name} l JOIN tok USING (id) WHERE active ORDER BY l.score, id LIMIT {n}),
b{name} AS (SELECT id, row_number() OVER (ORDER BY l.score, id) AS rank FROM b0{name} l JOIN chunks USING (id) WHERE {where} QUALIFY rank <= {limit}),
u{name} AS (SELECT id, 0 AS list, rank, 1.0::DOUBLE / (rank + 60) AS part FROM a{name} UNION ALL SELECT id, 1, rank, 1.25::DOUBLE / (rank + 60) FROM b{name}),
f{name} AS (SELECT id, sum(part) AS score, count(*) AS lists, min(list) AS list, arg_min(rank, list) AS place FROM u{name} GROUP BY id),
g{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, list, place, id) AS rank FROM f{name} QUALIFY rank <= {limit})"""


RESULT = "g.id AS chunk_id, source_path, round(g.score, 9) AS score, CASE WHEN lists > 1 THEN 'hybrid' WHEN list = 0 THEN 'vector' ELSE 'fts' END AS rank_source"


def fused_sql(words: list[str], text: str, n: int, k: int, limit: int, where: str = "true", chunks: str = CHUNKS, kept: str = "true", cut: int | None = None) -> str:
    return f"WITH {terms(chunks)}, {embedded(P.DIM)}, {fused_ctes(words, text, n, k, limit, where)} SELECT {RESULT} FROM g JOIN chunks USING (id) WHERE {kept} ORDER BY g.rank LIMIT {cut or limit}"


def _fused(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "source_path", F.round("score", 9).alias("score"), "rank_source")


@query("hyb1_search", fused_sql(["attion", "thing"], TEXT, 10, 80, 10))
def hyb1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(hybrid.search(P.corpus(spark, sf_dir, asked=[TEXT]), TEXT, 10))


@query("hyb1_filtered", fused_sql(["attion", "thing"], TEXT, 80, 640, 10, "contains(source_path, 'src1') OR contains(source, 'src1')"))
def hyb1_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(hybrid.search(P.corpus(spark, sf_dir, asked=[TEXT]), TEXT, 10, FILTERS))


@query("hyb4_all", fused_sql(["attion", "thing"], TEXT, 50, 400, 50))
def hyb4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit beyond the largest is cut to it."""
    return _fused(hybrid.search_all(P.corpus(spark, sf_dir, asked=[TEXT]), TEXT, limit="500"))


ASKED = "thing"


@query("hyb5_files", fused_sql([ASKED], ASKED, 30, 240, 30, chunks=MIXED, kept="source_kind = 'normal_file'", cut=7))
def hyb5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(hybrid.search_files(P.corpus(spark, sf_dir, "mixed", [ASKED]), ASKED, limit=7))


@query("hyb5_sessions", fused_sql([ASKED], ASKED, 30, 240, 30, chunks=MIXED, kept="source_kind = 'ai_session' AND source = 'chat'", cut=5))
def hyb5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(hybrid.search_sessions(P.corpus(spark, sf_dir, "mixed", [ASKED]), ASKED, "chat", limit=5))


VARIANTS = hybrid.secret_variants("thing key")


@query("hyb6_secrets", f"""WITH {terms(MIXED)}, {embedded(P.DIM)}, {', '.join(fused_ctes(v.split(), v, 320, 2560, 40, "extension = '.yaml'", str(k)) for k, v in enumerate(VARIANTS))},
v AS ({' UNION ALL '.join(f'SELECT {k} AS query, id, score, lists, list, rank FROM g{k}' for k in range(len(VARIANTS)))}), g AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY query, rank) = 1)
SELECT {RESULT} FROM g JOIN chunks USING (id) ORDER BY query, g.rank LIMIT 40""")  # fmt: skip
def hyb6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one source pass as config files. The limit is above the longest list, so several variants give rows."""
    return _fused(hybrid.find_secrets(P.corpus(spark, sf_dir, "mixed", VARIANTS), "thing key", 40))


@query("prj9_compact", fused_sql(["attion", "thing"], TEXT, 10, 80, 10).replace("AS chunk_id, source_path,", "AS id, source_path AS path,"))
def prj9_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.compact(hybrid.search(P.corpus(spark, sf_dir, asked=[TEXT]), TEXT, 10)).select("id", "path", F.round("score", 9).alias("score"), "rank_source")


@query("top9_resorted", f"WITH s AS ({fused_sql(['attion', 'thing'], TEXT, 50, 400, 50)}), t AS (SELECT chunk_id, 'document ' || (chunk_id // 65536) AS title FROM s) SELECT chunk_id, title, CAST(row_number() OVER (ORDER BY title DESC, chunk_id) AS INTEGER) AS place FROM t")
def top9_resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each result by name, from Z to A; places are the rows' order, numbered in one small partition."""
    out = hybrid.resorted(hybrid.search_all(P.corpus(spark, sf_dir, asked=[TEXT]), TEXT, limit=50), "name", descending=True).select("chunk_id", "title")
    numbered = out.coalesce(1).withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))
    return numbered


# Filters

SESSIONS = r"""s AS (SELECT conv_id, turn, role, text, 'chat/' || conv_id || '.jsonl#message:' || turn AS source_path, DATE '2024-01-01' + CAST(conv_id % 7 AS INTEGER) AS day
FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')"""


@query("src15_sessions", f"WITH {SESSIONS} SELECT source_path, 'chat ' || role AS title, text FROM s")
def src15_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.session_records(spark, sf_dir).select("source_path", "title", "text")


@query("fil9_dates", f"WITH {SESSIONS} SELECT source_path FROM s WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")
def fil9_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.session_records(spark, sf_dir).filter(filters.predicate({"date_from": "2024-01-03", "date_to": "2024-01-05", "source_kind": "AI_SESSION"})).select("source_path")


@query("fil7_project", "SELECT doc_id FROM documents WHERE contains(source, 'src1')")
def fil7_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_records(spark, sf_dir).filter(filters.predicate({"project": "SRC1", "file_type": "docs", "path_contains": "doc/", "extension": ".TXT"})).select("doc_id")


@query("fil2_source_prefix", f"WITH {SESSIONS} SELECT source_path FROM s WHERE conv_id = 1")
def fil2_source_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.session_records(spark, sf_dir).filter(filters.of_source("chat/1.jsonl")).select("source_path")


@query("fil3_under_root", "SELECT 'doc/' || source || '/' || doc_id || '.txt' AS path FROM documents WHERE source = 'src1'")
def fil3_under_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.source_files(spark, sf_dir).filter(filters.under_root("doc/src1")).select("path")


# Joins, roll-ups and listings


@query("join1_labels", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def join1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id").join(P.table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


HAVE = f"{CHUNKS}, have AS (SELECT id FROM chunks WHERE lang <> 'es')"


@query("join6_missing_vectors", f"WITH {HAVE} SELECT id FROM chunks WHERE active AND id NOT IN (SELECT id FROM have)")
def join6_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return vectors.missing(c, c.filter(F.element_at("metadata", "lang") != "es").select(F.col("id").alias("chunk_id"))).select("id")


@query("join7_complete", f"WITH {HAVE} SELECT source_path AS physical_path, bool_and(have.id IS NOT NULL) AS complete FROM chunks LEFT JOIN have USING (id) WHERE active GROUP BY source_path")
def join7_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return context.complete_sources(c, c.filter(F.element_at("metadata", "lang") != "es").select(F.col("id").alias("chunk_id")))


@query("join8_vanished", "SELECT 'doc/' || source || '/' || doc_id || '.txt' AS path FROM documents WHERE lang = 'fr' AND source = 'src1'")
def join8_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import ingest

    seen = P.document_records(spark, sf_dir).filter(F.element_at("metadata", "lang") != "fr").select(F.col("source_path").alias("path"))
    return ingest.vanished(P.source_files(spark, sf_dir), seen, ["doc/src1"])


@query("agg1_kinds", f"WITH {CHUNKS} SELECT source_kind, count(*) AS chunks FROM chunks WHERE active GROUP BY source_kind")
def agg1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.kinds(P.chunk_table(spark, sf_dir))


STATE = "CASE WHEN quality = 0 THEN 'skipped' WHEN toxic = 1 THEN 'error' ELSE 'indexed' END"


@query("agg2_file_states", f"SELECT 'normal_file' AS source_kind, {STATE} AS status, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def agg2_file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.file_states(P.source_files(spark, sf_dir))


@query("agg3_summary", f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY source_path, ordinal, id) AS nth FROM chunks WHERE active)
SELECT source AS project, count(*) AS chunks, count(DISTINCT source_path) AS files, count(*) || ' chunks in ' || count(DISTINCT source_path) || ' files (normal_file: ' || count(*) || ')' || chr(10)
  || string_agg(CASE WHEN nth <= 3 THEN substr(text, 1, 240) END, chr(10) ORDER BY nth) AS summary FROM n GROUP BY source""")  # fmt: skip
def agg3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir).withColumn("project", F.element_at("metadata", "project"))
    return context.summary(c).select("project", "chunks", "files", "summary")


@query("agg4_outcomes", f"SELECT count(*) AS discovered, count(*) FILTER (s = 'indexed') AS indexed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'error') AS error FROM (SELECT {STATE} AS s FROM documents LEFT JOIN labels USING (doc_id))")
def agg4_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.outcomes(P.source_files(spark, sf_dir))


@query("agg6_usage", """WITH b AS (SELECT doc_id % 5 AS part, strlen(text) AS n FROM documents), u AS (
  SELECT CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (part IN (0, 2)), 0) AS BIGINT) AS tables, CAST(coalesce(sum(n) FILTER (part = 1), 0) AS BIGINT) AS vectors,
         CAST(coalesce(sum(n) FILTER (part = 3), 0) AS BIGINT) AS logs, CAST(coalesce(sum(n) FILTER (part = 4), 0) AS BIGINT) AS other FROM b)
SELECT *, CASE WHEN total >= 12884901888 THEN 'hard_stop' WHEN total >= 7516192768 THEN 'warning' ELSE 'ok' END AS state FROM u""")  # fmt: skip
def agg6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a data folder, a fifth of them each in chunks, vectors, source_files, logs and elsewhere."""
    d = P.table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, ("data/chunks/%d.parquet", "data/vectors/%d.parquet", "data/Source_Files/%d.parquet", "data/run-%d.LOG", "data/%d.bin")))
    path = F.replace(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("%d"), F.col("doc_id").cast("string"))
    return context.usage(d.select(path.alias("path"), F.octet_length("text").cast("long").alias("size_bytes")))


@query("agg9_chunks_per_file", f"WITH {CHUNKS} SELECT source_path AS physical_path, count(*) AS chunks FROM chunks GROUP BY source_path")
def agg9_chunks_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_table(spark, sf_dir).groupBy(S.physical_path(F.col("source_path")).alias("physical_path")).agg(F.count("*").alias("chunks"))


@query("win1_neighbours", f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY ordinal, id) AS position FROM chunks WHERE active)
SELECT a.id AS target, b.id AS id, b.ordinal AS ordinal, CAST(b.position AS INTEGER) AS position FROM n a JOIN n b ON a.source_path = b.source_path AND abs(a.position - b.position) <= 2 AND a.id <> b.id""")  # fmt: skip
def win1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return context.surrounding(c, c, 2).select("target", "id", "ordinal", "position")


@query("win8_context", f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY ordinal, id) AS position FROM chunks WHERE active)
SELECT a.id AS target, string_agg(b.text, chr(10) || chr(10) ORDER BY b.ordinal, b.id) AS context FROM n a JOIN n b ON a.source_path = b.source_path AND abs(a.position - b.position) <= 1 GROUP BY a.id""")  # fmt: skip
def win8_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return context.context_text(c, c)


@query("top4_latest_job", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status, value FROM events ORDER BY event_id DESC LIMIT 1")
def top4_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.latest(P.jobs(spark, sf_dir)).select("id", "status", "value")


@query("top5_recent_sources", f"""WITH {CHUNKS}, l AS (SELECT source_path, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS position FROM chunks WHERE active ORDER BY updated_at DESC, id DESC LIMIT 25)
SELECT source_path AS physical_path, CAST(min(position) AS INTEGER) AS position FROM l GROUP BY source_path""")  # fmt: skip
def top5_recent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.recent_sources(P.chunk_table(spark, sf_dir), 25)


@query("top7_samples", f"WITH {CHUNKS} SELECT id, source_path FROM chunks WHERE active ORDER BY id LIMIT 5")
def top7_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.samples(P.chunk_table(spark, sf_dir), 5).select("id", "source_path")


@query("fil24_retry", f"SELECT 'doc/' || source || '/' || doc_id || '.txt' AS path FROM documents LEFT JOIN labels USING (doc_id) WHERE {STATE} = 'error'")
def fil24_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_retry(P.source_files(spark, sf_dir)).select("path")


@query("set2_first_seen", """SELECT doc_id, CASE WHEN contains(text, 'password') THEN 0 WHEN contains(text, 'token') THEN 1 ELSE 2 END AS variant FROM documents WHERE contains(text, 'password') OR contains(text, 'token') OR contains(text, 'key')""")
def set2_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents")
    all_ = None
    for k, word in enumerate(("password", "token", "key")):
        found = d.filter(F.col("text").contains(word)).select("doc_id", F.lit(k).alias("variant"))
        all_ = found if all_ is None else all_.unionByName(found)
    return all_.groupBy("doc_id").agg(F.min("variant").alias("variant"))


# Table changes

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("snk3_staged", f"WITH {CHUNKS} SELECT id, active, CASE WHEN active THEN 'indexed' ELSE 'vector_pending' END AS vector_status FROM chunks WHERE lang = 'de' UNION ALL SELECT id, active, CASE WHEN active THEN 'indexed' ELSE 'inactive' END FROM chunks WHERE lang <> 'de'")
def snk3_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German chunks staged again: active ones keep their state, inactive ones await vectors."""
    c = P.chunk_table(spark, sf_dir)
    again = c.filter(F.element_at("metadata", "lang") == "de").select("source_path", "source_kind", "title", "text", "metadata", "ordinal", "content_hash")
    return store.upserted(c, again, False, F.expr(NOW), 1 << 60).select("id", "active", "vector_status")


@query("snk4_activated", f"WITH {CHUNKS} SELECT id, (active OR ordinal = 0) AND NOT (active AND ordinal > 0) AS active FROM chunks")
def snk4_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each file activated, the others of those files retired."""
    c = P.chunk_table(spark, sf_dir)
    ids = c.filter("ordinal = 0").select(F.col("id").alias("chunk_id"), S.physical_path(F.col("source_path")).alias("physical_path"))
    return store.activated(c, ids, F.expr(NOW))[0].select("id", "active")


@query("snk6_deactivated", f"WITH {CHUNKS} SELECT id, active AND source <> 'src1' AS active, CASE WHEN source = 'src1' THEN 'vector_pending' WHEN active THEN 'indexed' ELSE 'inactive' END AS vector_status FROM chunks")
def snk6_deactivated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return store.deactivated(c, filters.under_root("doc/src1", "source_path"), F.expr(NOW), "vector_pending").select("id", "active", "vector_status")


@query("snk8_purged", f"WITH {CHUNKS} SELECT id FROM chunks WHERE active OR lang <> 'en'")
def snk8_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return store.purged(c, c.filter(F.element_at("metadata", "lang") == "en").select(F.col("id").alias("chunk_id"))).select("id")


@query("snk9_files", f"SELECT 'doc/' || source || '/' || doc_id || '.txt' AS path, CASE WHEN lang = 'es' THEN 'indexed' ELSE {STATE} END AS status, CASE WHEN lang = 'es' THEN {NOW} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_indexed_at FROM documents LEFT JOIN labels USING (doc_id)")
def snk9_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = P.source_files(spark, sf_dir)
    es = P.document_records(spark, sf_dir).filter(F.element_at("metadata", "lang") == "es").select(F.col("source_path").alias("path"))
    new = files.join(es, "path", "left_semi").withColumns({"status": F.lit("indexed"), "error": F.lit(None).cast("string")})
    return store.merged_files(files, new, F.expr(NOW)).select("path", "status", F.col("last_indexed_at").cast("timestamp_ntz").alias("last_indexed_at"))


# Extraction


def visible_sql(html: str) -> str:
    """Text nodes, a line each; only the entities that the fixture has."""
    for entity, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&amp;", "&")):
        html = f"list_transform({html}, lambda x: replace(x, '{entity}', '{put}'))"
    return html


@query("src10_pages", rf"""WITH n AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '<x>', 'g'), '<[^>]*>') AS nodes FROM pages),
e AS (SELECT page_id, {visible_sql('nodes')} AS nodes FROM n)
SELECT page_id, array_to_string(list_filter(list_transform(nodes, lambda x: trim(regexp_replace(x, '[\s\x{{a0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM e""")  # fmt: skip
def src10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_records(spark, sf_dir).select("page_id", "text")


@query("win3_ranks", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events")
def win3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))


from . import suite_rules  # noqa: E402, F401  (registers its queries here)
