"""More registered queries: scalar rules, filters, lookups, table changes and extractors over the fixture tables.

Rules on names are tried on names made from the tables' own columns (urls, sources, ids), and the SQL states
the rule. Their odd cases are in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import chunking, context, filters, hybrid, store, vectors
from .plans import corpus as P
from .schema import JOBS, SAVED_SEARCHES
from .sources import extract
from .streaming import status
from .suite import CHUNKS, NOW, SESSIONS, STATE, query

FILE = "'doc/' || source || '/' || doc_id || '.txt'"


#: A path a page: its url's host as a drive or folder, its language and number as names, and an extension by its number.
EXTENSIONS = (".md", ".PY", ".srt", ".yaml", ".pdf", ".zip", ".PNG", "", ".env", ".jsonl", ".docx")
SQL_HOST = "regexp_extract(url, '://([^/]+)', 1)"
SQL_FOLDER = f"CASE WHEN contains({SQL_HOST}, '.net') THEN 'D:\\Projects\\' WHEN contains({SQL_HOST}, '.org') THEN 'home/sessions/' ELSE '/srv/' END"
SQL_EXTENSION = f"([{', '.join(repr(x) for x in EXTENSIONS)}])[page_id % {len(EXTENSIONS)} + 1]"
SQL_PATH = f"{SQL_FOLDER} || {SQL_HOST} || '/' || page_id || {SQL_EXTENSION}"
SQL_NAMED = f"n AS (SELECT page_id, {SQL_PATH} AS path, {SQL_EXTENSION} AS ext, url, length(html) AS size FROM pages)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/]+)", 1)
    folder = F.when(host.contains(".net"), "D:\\Projects\\").when(host.contains(".org"), "home/sessions/").otherwise("/srv/")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("page_id") % len(EXTENSIONS) + 1).cast("int"))
    p = P.table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(folder, host, F.lit("/"), "page_id", ext).alias("path"), "url", F.length("html").alias("size"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as search results: sessions by their folder, and a language as metadata."""
    kind = F.when(F.col("path").startswith("home/sessions"), "ai_session").otherwise("normal_file")
    return names(spark, sf_dir).select("page_id", F.col("path").alias("source_path"), kind.alias("source_kind"), pair("lang", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1)).alias("metadata"))


def pair(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), value)


# Scalar rules


@query("scl2_fingerprints", f"SELECT {FILE} AS path, sha256({FILE} || '|' || strlen(text) || '|0') AS fingerprint FROM documents")
def scl2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.source_files(spark, sf_dir).select("path", "fingerprint")


@query("scl4_base_lines", "SELECT doc_id, CASE WHEN n_chars % 7 > 0 THEN n_chars % 7 WHEN doc_id > 0 THEN doc_id ELSE 1 END AS line FROM documents")
def scl4_base_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start_line where it is above 0, else line, else 1; with blanks around."""
    m = F.create_map(F.lit("start_line"), (F.col("n_chars") % 7).cast("string"), F.lit("line"), F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ")))
    return P.table(spark, sf_dir, "documents").select("doc_id", S.base_line(m).cast("long").alias("line"))


@query("scl5_record_extensions", f"WITH {SQL_NAMED} SELECT page_id, lower(ext) AS extension, CASE WHEN regexp_matches(url, '[^./]\\.html$') THEN '.html' WHEN regexp_matches(url, '\\.[a-z]+$') THEN regexp_extract(url, '(\\.[a-z]+)$', 1) ELSE '' END AS of_url FROM n")
def scl5_record_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = pair("lang", F.lit("en"))
    return names(spark, sf_dir).select("page_id", S.record_extension(none, F.col("path")).alias("extension"), S.record_extension(none, F.regexp_replace("url", r"[?#].*$|/$", "")).alias("of_url"))


@query("scl6_result_extensions", f"WITH {SQL_NAMED} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '.' || regexp_extract(url, '/([a-z][a-z])/', 1) ELSE lower(ext) END AS extension FROM n")
def scl6_result_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata's, in capitals and without a dot, or else the path's, whose fragment doesn't count."""
    own = F.when(F.col("page_id") % 2 == 0, F.upper(F.regexp_extract("url", "/([a-z][a-z])/", 1))).otherwise("")
    return names(spark, sf_dir).select("page_id", S.result_extension(pair("extension", own), F.concat("path", F.lit("#a.b"))).alias("extension"))


SQL_TYPE = "CASE WHEN path LIKE 'home/sessions%' THEN 'session' WHEN lower(ext) = '.srt' THEN 'transcript' WHEN lower(ext) IN ('.yaml', '.env') THEN 'config' WHEN lower(ext) = '.py' THEN 'code' WHEN lower(ext) IN ('.md', '.pdf', '.docx') THEN 'document' ELSE 'file' END"


@query("scl7_file_types", f"WITH {SQL_NAMED} SELECT page_id, {SQL_TYPE} AS file_type FROM n")
def scl7_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("page_id", S.file_type(F.col("metadata"), F.col("source_kind"), F.col("source_path")).alias("file_type"))


@query("scl8_type_aliases", "SELECT event_id, CASE event_type WHEN 'view' THEN 'view-settings' WHEN 'click' THEN 'session' WHEN 'error' THEN 'code' ELSE event_type END AS file_type FROM events")
def scl8_type_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", " View_Settings ").when(F.col("event_type") == "click", "AI_SESSION").when(F.col("event_type") == "error", "source_code").otherwise(F.upper("event_type"))
    return P.table(spark, sf_dir, "events").select("event_id", S.normalized_type(kind).alias("file_type"))


@query("scl10_iso_dates", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) AS basic, TRY_CAST('2024-' || strftime(ts, '%d') || '-30' AS DATE) AS odd FROM events")
def scl10_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with a time, as eight digits, and with day and month changed over, which may be none."""
    e = P.table(spark, sf_dir, "events")
    made = {"day": F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "basic": F.date_format("ts", "yyyyMMdd"), "odd": F.concat(F.lit("2024-"), F.date_format("ts", "dd"), F.lit("-30"))}
    return e.select("event_id", *[S.iso_date(v).alias(k) for k, v in made.items()])


@query("scl9_record_dates", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) ELSE DATE '2024-05-06' END AS day FROM events")
def scl9_record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("mtime"), F.lit("2024-05-06"), F.lit("timestamp"), F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")).otherwise("unknown"))
    return P.table(spark, sf_dir, "events").select("event_id", S.record_date(m).alias("day"))


@query("scl11_path_parts", r"SELECT page_id, array_to_string(list_filter(string_split(lower(replace(split_part(url, '#', 1), '/', '\')), '\'), lambda x: x <> ''), '|') AS parts FROM pages")
def scl11_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "pages").select("page_id", F.array_join(S.path_parts(F.col("url")), "|").alias("parts"))


@query("scl13_json_maps", "SELECT event_id, props ->> '$.k' AS k FROM events")
def scl13_json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read from JSON, written and read again."""
    e = P.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.element_at(F.from_json(F.to_json("m"), "map<string,string>"), "k").alias("k"))


@query("scl15_truncated", "SELECT doc_id, substr(text, 1, 240) AS snippet, length(substr(text, 1, 6000)) AS embedded_chars FROM documents")
def scl15_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, hybrid.SNIPPET_CHARS).alias("snippet"), F.length(F.substring("text", 1, 6000)).cast("long").alias("embedded_chars"))


@query("scl17_console_safe", r"SELECT doc_id, replace(text, chr(65279), '') AS text, regexp_replace(replace(text, chr(65279), ''), '[^\x00-\x7f]', '?', 'g') AS ascii FROM documents")
def scl17_console_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("\ufeff"), "text")
    return P.table(spark, sf_dir, "documents").select("doc_id", S.without_bom(marked).alias("text"), S.without_bom(marked, "US-ASCII").alias("ascii"))


@query("scl18_collapsed", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g')) AS text FROM documents")
def scl18_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", S.collapsed(F.col("text")).alias("text"))


@query("scl19_timecodes", "SELECT event_id, user_id % 2 = 0 AS timecode FROM events")
def scl19_timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with thousandths are time codes, with hundredths they aren't."""
    at = F.when(F.col("user_id") % 2 == 0, F.date_format("ts", "HH:mm:ss,SSS")).otherwise(F.date_format("ts", "HH:mm:ss.SS"))
    return P.table(spark, sf_dir, "events").select("event_id", S.is_timecode(F.concat(at, F.lit(" --> x"))).alias("timecode"))


@query("scl22_positive_ints", "SELECT event_id, CASE WHEN user_id % 3 = 0 AND event_id > 0 THEN event_id END AS n FROM events")
def scl22_positive_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with blanks around, negative ones, and with a fraction: only the first are one."""
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" "))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return P.table(spark, sf_dir, "events").select("event_id", S.positive_int(text).cast("long").alias("n"))


SQL_BYTES = "CASE WHEN b >= 1073741824 THEN printf('%.2f GB', floor(b / 1073741824.0::DOUBLE * 100 + 0.5) / 100) WHEN b >= 1048576 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE CAST(floor(b / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB' END"
SQL_SIZES = "z AS (SELECT doc_id, CAST(strlen(text) * (1 << (doc_id % 24)) AS BIGINT) AS b FROM documents)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from bytes to tens of gigabytes: each text's, times a power of two by its id."""
    return P.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") * F.pow(F.lit(2.0), F.col("doc_id") % 24)).cast("long").alias("b"))


@query("scl23_byte_labels", f"WITH {SQL_SIZES} SELECT doc_id, {SQL_BYTES} AS label FROM z")
def scl23_byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("doc_id", S.byte_label(F.col("b")).alias("label"))


@query("scl24_labels", f"""WITH {SQL_NAMED} SELECT page_id, CASE WHEN path LIKE 'home/sessions%' THEN 'Session' WHEN ext = '' THEN CASE WHEN contains(path, '.example.') THEN 'File' END ELSE upper(substr(ext, 2)) END AS type_label,
CASE WHEN path LIKE 'home/sessions%' THEN 'ai session' ELSE 'normal file' END AS source_label, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'Line ' || size ELSE 'Lines ' || size || '-' || (size + page_id) END AS line_label FROM n""")  # fmt: skip
def scl24_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir).select("page_id", "size")
    third = F.col("page_id") % 3
    lines = F.create_map(F.lit("start_line"), F.when(third > 0, F.col("size").cast("string")), F.lit("end_line"), F.when(third == 2, (F.col("size") + F.col("page_id")).cast("string")).otherwise(F.col("size").cast("string")))
    return results(spark, sf_dir).join(n, "page_id").select("page_id", S.type_label(F.col("metadata"), F.col("source_kind"), F.col("source_path")).alias("type_label"), S.source_label(F.col("source_kind")).alias("source_label"), S.line_label(lines).alias("line_label"))


@query("scl24_scan_labels", """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'Auto: off' ELSE 'Auto: ' || CASE WHEN event_id % 5 = 0 THEN (user_id % 9 + 1) || 'h' ELSE CAST(floor((user_id % 9 * 60 + 90) / 60.0::DOUBLE + 0.5) AS BIGINT) || 'm' END || CASE WHEN event_type = 'view' THEN ' charging/idle' ELSE ' idle' END END AS label FROM events""")
def scl24_scan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(F.col("event_id") % 5 == 0, (F.col("user_id") % 9 + 1) * 3600).otherwise(F.col("user_id") % 9 * 60 + 90)
    return P.table(spark, sf_dir, "events").select("event_id", S.scan_label(F.col("user_id") % 4 != 0, seconds, F.col("event_type") == "view").alias("label"))


@query("scl25_log_levels", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE '' END AS level FROM events")
def scl25_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of events: a level counts in capitals and between blanks, the first one only."""
    word = F.when(F.col("event_type") == "view", "INFO WARNING").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "debug").otherwise("xINFO")
    return P.table(spark, sf_dir, "events").select("event_id", S.log_level(F.concat(F.col("ts").cast("string"), F.lit(" "), word, F.lit(" "), "props")).alias("level"))


@query("scl26_code_chunks", """SELECT 'code/' || item_id || '.py' AS source_path, n AS ordinal, CASE n WHEN 0 THEN 'def load' || item_id || '(x): return x' ELSE 'class Item' || item_id || ': y = 1' END AS text,
CASE n WHEN 0 THEN 'load' ELSE 'Item' END || item_id AS symbol, CASE n WHEN 0 THEN '3' ELSE '6' END AS start_line, CASE n WHEN 0 THEN '4' ELSE '7' END AS end_line FROM benchmark, (VALUES (0), (1)) v(n)""")  # fmt: skip
def scl26_code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function and a class a record; what stands before them is left out."""
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("import os\n\ndef load"), i, F.lit("(x):\n    return x\n\nclass Item"), i, F.lit(":\n    y = 1\n\n"))
    records = P.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("code/"), i, F.lit(".py")).alias("source_path"), F.lit("project_source").alias("source_kind"), i.alias("title"), text.alias("text"), pair("extension", F.lit(".py")).alias("metadata"))
    m = {k: F.element_at("metadata", v).alias(k) for k, v in (("symbol", "code_symbol"), ("start_line", "start_line"), ("end_line", "end_line"))}
    return chunking.chunked(records).select("source_path", "ordinal", "text", *m.values())


# Filters

DOCS = "SELECT doc_id FROM documents WHERE "


def passing(spark: SparkSession, sf_dir: str, **f: object) -> DataFrame:
    return P.document_records(spark, sf_dir).filter(filters.predicate(f)).select("doc_id")


@query("fil1_path_contains", f"{DOCS} contains({FILE}, 'src1/1')")
def fil1_path_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passing(spark, sf_dir, path_contains=" SRC1/1 ")


@query("fil4_source_kind", f"WITH {SESSIONS} SELECT source_path FROM s")
def fil4_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = P.session_records(spark, sf_dir).select("source_path", "source_kind", "metadata").unionByName(P.document_records(spark, sf_dir).select("source_path", "source_kind", "metadata"))
    return both.filter(filters.predicate({"source_kind": "AI_Session"})).select("source_path")


@query("fil5_drive", f"WITH {SQL_NAMED} SELECT page_id FROM n WHERE path LIKE 'D:%'")
def fil5_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).filter(filters.predicate({"drive": "d:\\"})).select("page_id")


@query("fil6_extension", f"WITH {SQL_NAMED} SELECT page_id FROM n WHERE ext = '.PY'")
def fil6_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).filter(filters.predicate({"extension": "py"})).select("page_id")


@query("fil8_file_type", f"WITH {SQL_NAMED} SELECT page_id FROM n WHERE {SQL_TYPE} = 'config'")
def fil8_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).filter(filters.predicate({"file_type": "settings", "path_contains": None})).select("page_id")


@query("fil11_sessions", f"WITH {SESSIONS} SELECT source_path FROM s WHERE role = 'user'")
def fil11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one source, which is the role here, among sessions and documents."""
    turns = P.session_records(spark, sf_dir).withColumn("metadata", pair("source", F.element_at("metadata", "role"))).select("source_path", "source_kind", "metadata")
    both = turns.unionByName(P.document_records(spark, sf_dir).select("source_path", "source_kind", "metadata"))
    return both.filter((F.col("source_kind") == "ai_session") & (F.element_at("metadata", "source") == "user")).select("source_path")


@query("fil12_active", f"WITH {CHUNKS} SELECT id FROM chunks WHERE active")
def fil12_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_table(spark, sf_dir).filter("active").select("id")


@query("fil13_changed_files", f"SELECT {FILE} AS path FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'fr' OR {STATE} = 'error' OR (source <> 'src3' AND lang = 'es' AND regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f]'))")
def fil13_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French files were touched, failed ones are tried again, and the chunks of Spanish ones lack vectors."""
    from .streaming import ingest

    files, c, lang = P.source_files(spark, sf_dir), P.chunk_table(spark, sf_dir), P.document_records(spark, sf_dir).select(F.col("source_path").alias("path"), F.element_at("metadata", "lang").alias("lang"))
    listed = files.select("path", "fingerprint").join(lang, "path").withColumn("fingerprint", F.when(F.col("lang") == "fr", "new").otherwise(F.col("fingerprint"))).drop("lang")
    have = c.filter(F.element_at("metadata", "lang") != "es").select(F.col("id").alias("chunk_id"))
    return ingest.changed(listed, files, c, have).select("path")


@query("fil15_size_caps", f"WITH {SQL_NAMED} SELECT page_id, CAST(CASE lower(ext) WHEN '.docx' THEN 500 WHEN '.pdf' THEN 150 ELSE 20 END * 1048576 AS BIGINT) AS cap FROM n")
def fil15_size_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("page_id", filters.size_cap(F.col("path")).cast("long").alias("cap"))


SQL_REASON = """CASE WHEN ext = '.PNG' THEN 'media_extension' WHEN ext = '.zip' THEN 'archive_extension' WHEN path LIKE 'home/sessions%' AND ext = '.jsonl' THEN 'session_log' WHEN path LIKE 'D:%' THEN 'project' ELSE 'normal_file' END"""


@query("fil19_classes", f"""WITH {SQL_NAMED}, r AS (SELECT *, {SQL_REASON} AS reason FROM n) SELECT page_id, reason,
  CASE WHEN reason IN ('media_extension', 'archive_extension') THEN reason WHEN reason = 'session_log' THEN NULL WHEN size * 4096 > CASE lower(ext) WHEN '.docx' THEN 500 WHEN '.pdf' THEN 150 ELSE 20 END * 1048576 THEN 'too_large' END AS skip FROM r""")  # fmt: skip
def fil19_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's path is, and why it is skipped if it is 4096 times as large."""
    rule = filters.classified(F.col("path"))
    return names(spark, sf_dir).select("page_id", rule["reason"].alias("reason"), filters.skip_reason(F.col("path"), F.col("size") * 4096, rule).alias("skip"))


@query("fil20_relaxed_rules", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'normal_file' WHEN source LIKE 'src%' THEN 'skip_dir' END AS reason FROM documents")
def fil20_relaxed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder `build`, which is skipped; the root of some sources is that folder, so it doesn't count."""
    path = F.concat(F.lit("/data/build/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    root = F.when(F.col("source").startswith("src1"), "/data/build").otherwise("/data")
    return P.table(spark, sf_dir, "documents").select("doc_id", filters.classified_under(path, root)["reason"].alias("reason"))


@query("fil22_scope_rules", "SELECT doc_id, CASE WHEN source LIKE '%1' AND lang = 'fr' THEN 'backup' WHEN source = 'src2' THEN 'scope' WHEN source LIKE '%3' AND lang IN ('de', 'es') THEN 'scope' ELSE 'normal_file' END AS reason FROM documents")
def fil22_scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by prefix, by a sequence of parts and by a part after another, as a caller's data."""
    last = F.right("source", F.lit(1))
    path = F.concat_ws("\\", "source", F.concat(F.lit("Kind"), last), "lang", F.col("doc_id").cast("string"))
    rules = (
        filters.PathRule("backup", "system_cache", True, sequence=("kind1", "fr")), filters.PathRule("scope", "project_source", False, prefix=("src2",)), filters.PathRule("scope", "project_source", False, after=("kind3", "de")),
        filters.PathRule("scope", "project_source", False, after=("kind3", "es")),
    )
    return P.table(spark, sf_dir, "documents").select("doc_id", filters.classified(path, rules)["reason"].alias("reason"))


LEFT_OUT, ALLOWED = ("D:\\Projects\\Blog.tionsh.example.net\\", "home\\sessions\\thther.example.org", "/srv/www"), ("D:\\Projects\\blog.ththan.example.net", "d:/projects/m.ththth.example.net")


@query("fil18_folders", f"""WITH {SQL_NAMED}, p AS (SELECT page_id, lower(replace(path, '/', '\\')) AS p FROM n),
w AS (SELECT page_id, starts_with(p, 'd:\\projects\\blog.tionsh.example.net\\') OR starts_with(p, 'home\\sessions\\thther.example.org\\') OR starts_with(p, '\\srv\\www\\') AS left_out,
  starts_with(p, 'd:\\projects\\blog.ththan.example.net\\') OR starts_with(p, 'd:\\projects\\m.ththth.example.net\\') AS scope, starts_with(p, 'd:') AS drive FROM p)
SELECT page_id, left_out, scope, CASE WHEN left_out THEN 'left_out' WHEN drive AND NOT scope THEN 'unscoped' ELSE 'normal_file' END AS reason FROM w""")  # fmt: skip
def fil18_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths in folders that are left out, and on a drive of which only scopes count."""
    path, rules = F.col("path"), (filters.PathRule("left_out", "system_cache", True, folders=LEFT_OUT), filters.PathRule("unscoped", "system_cache", True, outside=ALLOWED))
    return names(spark, sf_dir).select("page_id", filters.under_any(path, LEFT_OUT).alias("left_out"), filters.in_scope_or_above(path, ALLOWED).alias("scope"), filters.classified(path, rules)["reason"].alias("reason"))


# Lookups and listings


@query("prj1_chunk", f"WITH {CHUNKS} SELECT id, source_path, text FROM chunks WHERE active ORDER BY id LIMIT 1")
def prj1_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    return context.get_chunk(c, c.filter("active").agg(F.min("id")).first()[0]).select("id", "source_path", "text")


@query("prj3_chunks_by_ids", f"WITH {CHUNKS} SELECT id, title FROM chunks WHERE active AND doc_id % 7 = 0 AND ordinal = 0")
def prj3_chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = P.table(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select((F.col("doc_id") * P.SLOTS).alias("id"))
    return context.by_ids(P.chunk_table(spark, sf_dir), ids.unionByName(ids)).select("id", "title")


@query("prj4_source_file", f"SELECT {FILE} AS path, strlen(text) AS size_bytes FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1')")
def prj4_source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = P.table(spark, sf_dir, "documents").filter("source = 'src1'").agg(F.min("doc_id")).first()[0]
    return P.source_files(spark, sf_dir).filter(F.col("path") == f"doc/src1/{first}.txt").select("path", "size_bytes")


@query("prj7_contained", f"WITH {CHUNKS} SELECT id AS chunk_id FROM chunks WHERE ordinal = 0 AND lang <> 'es'")
def prj7_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    have = c.filter(F.element_at("metadata", "lang") != "es").select(F.col("id").alias("chunk_id"))
    return vectors.contained(c.filter("ordinal = 0").select(F.col("id").alias("chunk_id")), have)


@query("prj12_opened", f"WITH {CHUNKS} SELECT id, source_path AS physical_path, start_line, end_line FROM chunks")
def prj12_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir).withColumn("source_path", F.concat("source_path", F.lit("#part")))
    return context.opened(c).select("id", "physical_path", "start_line", "end_line")


@query("agg5_retry_totals", f"""SELECT count(*) AS retried, count(*) FILTER (lang = 'fr') AS missing FROM documents LEFT JOIN labels USING (doc_id) WHERE {STATE} = 'error'""")
def agg5_retry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = P.document_records(spark, sf_dir).filter(F.element_at("metadata", "lang") != "fr").select(F.col("source_path").alias("path"))
    return store.retry_totals(P.source_files(spark, sf_dir), there)


SQL_STATE = "CASE WHEN b >= 12884901888 THEN 'hard_stop' WHEN b >= 7516192768 THEN 'warning' ELSE 'ok' END"


@query("agg7_storage_states", f"WITH {SQL_SIZES} SELECT doc_id, {SQL_STATE} AS state, CASE {SQL_STATE} WHEN 'hard_stop' THEN 'Storage stop: ' WHEN 'warning' THEN 'Storage warning: ' ELSE 'Storage: ' END || {SQL_BYTES} AS label FROM z")
def agg7_storage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("doc_id", S.storage_state(F.col("b")).alias("state"), S.storage_label(F.col("b")).alias("label"))


@query("top12_source_chunks", f"WITH {CHUNKS} SELECT id FROM chunks WHERE active AND source_path = 'doc/src1/1.txt' OR active AND source_path LIKE 'doc/src1/1.txt#%'")
def top12_source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_table(spark, sf_dir).filter(F.col("active") & filters.of_source("doc/src1/1.txt")).select("id").orderBy("id")


@query("set1_roots", f"SELECT {FILE} AS path FROM documents WHERE source = 'src1' UNION ALL SELECT {FILE} FROM documents WHERE source IN ('src1', 'src2')")
def set1_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of overlapping roots, one after the other, nothing dropped."""
    f = P.source_files(spark, sf_dir).select("path")
    return f.filter(filters.under_root("doc/src1")).unionAll(f.filter(filters.under_root("doc/src1") | filters.under_root("doc/src2")))


@query("set6_seen_paths", f"SELECT {FILE} AS path FROM documents WHERE source IN ('src1', 'src2')")
def set6_seen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set1_roots(spark, sf_dir).distinct()


# Table changes


@query("snk1_upserted", f"""WITH {CHUNKS}, n AS (SELECT count(*) AS old FROM chunks), f AS (SELECT count(*) AS fresh FROM chunks WHERE lang = 'fr')
SELECT old + fresh AS rows, old + fresh AS ids, {1 << 60} AS first_new, {1 << 60} + fresh - 1 AS last_new, (SELECT count(*) FROM chunks WHERE active OR lang = 'de') + fresh AS active FROM n, f""")  # fmt: skip
def snk1_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German chunks upserted as they are, French ones with another text: known keys keep their ids, new ones get the next."""
    c, start = P.chunk_table(spark, sf_dir), 1 << 60
    lang = F.element_at("metadata", "lang")
    new = c.filter(lang.isin("de", "fr")).withColumn("content_hash", F.when(lang == "fr", F.sha2(F.concat("content_hash", F.lit("+")), 256)).otherwise(F.col("content_hash")))
    out = store.upserted(c, new, True, F.expr(NOW), start)
    fresh = F.when(F.col("id") >= start, F.col("id"))
    return out.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.min(fresh).alias("first_new"), F.max(fresh).alias("last_new"), F.count_if("active").alias("active"))


@query("snk5_deactivated_source", f"WITH {CHUNKS} SELECT id, active AND doc_id <> 1 AS active, CASE WHEN doc_id = 1 THEN 'inactive' WHEN active THEN 'indexed' ELSE 'inactive' END AS vector_status FROM chunks")
def snk5_deactivated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = F.col("source_path").endswith("/1.txt")
    return store.deactivated(P.chunk_table(spark, sf_dir), here, F.expr(NOW)).select("id", "active", "vector_status")


@query("snk10_file_status", f"SELECT {FILE} AS path, CASE WHEN source = 'src1' THEN 'error' ELSE {STATE} END AS status, CASE WHEN source = 'src1' THEN 'unreadable' WHEN {STATE} = 'error' THEN 'label' END AS error FROM documents LEFT JOIN labels USING (doc_id)")
def snk10_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_status(P.source_files(spark, sf_dir), filters.under_root("doc/src1"), "error", "unreadable", F.expr(NOW)).select("path", "status", "error")


@query("snk11_job", f"SELECT event_id AS id, CASE WHEN event_id = 3 THEN 'paused' ELSE 'running' END AS status, CASE WHEN event_id = 3 THEN 9 ELSE 0 END AS indexed, CASE WHEN event_id = 3 THEN {NOW} END AS finished_at FROM events")
def snk11_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"id": F.col("event_id"), "root_path": F.lit("root"), "status": F.lit("running"), "message": F.lit(""), "started_at": F.col("ts"), "updated_at": F.col("ts"), "finished_at": F.lit(None)}
    jobs = P.table(spark, sf_dir, "events").select(*[values.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in JOBS])
    return store.updated_job(jobs, 3, "paused", "paused by user", F.expr(NOW), indexed=9).select("id", "status", F.col("indexed").cast("int").alias("indexed"), F.col("finished_at").cast("timestamp_ntz").alias("finished_at"))


@query("snk12_saved_searches", "SELECT item_id AS id, 'search ' || item_id AS name, CASE WHEN item_id = 2 THEN 'new words' ELSE text END AS query FROM benchmark UNION ALL SELECT max(item_id) + 1, 'fresh', 'more' FROM benchmark")
def snk12_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known name keeps its id, a new one gets the next."""
    values = {"id": F.col("item_id"), "name": F.concat(F.lit("search "), "item_id"), "query": F.col("text"), "filters": F.create_map(), "created_at": F.expr(P.EPOCH), "updated_at": F.expr(P.EPOCH)}
    known = P.table(spark, sf_dir, "benchmark").select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SAVED_SEARCHES])
    out = store.saved_search(store.saved_search(known, "search 2", "new words", {}, F.expr(NOW)), "fresh", "more", {}, F.expr(NOW))
    return out.select("id", "name", "query")


@query("snk14_vectors_added", "SELECT vec_id AS chunk_id, len(embedding) AS dim FROM embeddings")
def snk14_vectors_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id").select("chunk_id", "embedding")
    return vectors.added(v.filter("chunk_id % 3 > 0"), v.filter("chunk_id % 3 = 0"), 64).select("chunk_id", F.size("embedding").cast("long").alias("dim"))


@query("snk15_vectors_removed", "SELECT vec_id AS chunk_id FROM embeddings WHERE label <> 3")
def snk15_vectors_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return vectors.removed(v.select("chunk_id", "embedding"), v.filter("label = 3").select("chunk_id")).select("chunk_id")


@query("join9_retired", f"WITH {CHUNKS} SELECT id AS chunk_id FROM chunks WHERE active AND ordinal > 0")
def join9_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chunk_table(spark, sf_dir)
    ids = c.filter("ordinal = 0").select(F.col("id").alias("chunk_id"), S.physical_path(F.col("source_path")).alias("physical_path"))
    return store.activated(c, ids, F.expr(NOW))[1]


# Extractors, on files made from rows


def files(df: DataFrame, path: Column, content: Column, kind: str = "normal_file") -> DataFrame:
    return df.select(path.alias("path"), F.lit(kind).alias("kind"), content.cast("binary").alias("content"))


def named(key: str, ext: str) -> Column:
    return F.concat(F.lit("in/"), F.col(key).cast("string"), F.lit(ext))


@query("src4_plain_files", "SELECT 'in/' || doc_id || '.log' AS source_path, text FROM documents")
def src4_plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.records(files(P.table(spark, sf_dir, "documents"), named("doc_id", ".log"), F.col("text"))).select("source_path", "text")


@query("src9_csv_files", "SELECT 'in/' || p_partkey || '.csv' AS source_path, 'name | brand' || chr(10) || p_name || ' | ' || p_brand || ', \"x\"' AS text FROM part")
def src9_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("\ufeffname,,brand\n"), F.col("p_name"), F.lit(',"'), F.col("p_brand"), F.lit(', ""x"""\n , \n'))
    return extract.records(files(P.table(spark, sf_dir, "part"), named("p_partkey", ".csv"), content)).select("source_path", "text")


@query("src12_transcripts", "SELECT 'in/' || event_id || '.srt' AS source_path, 'said ' || event_type || chr(10) || 'by ' || user_id AS text FROM events")
def src12_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("WEBVTT\n\n1\n"), F.date_format("ts", "HH:mm:ss"), F.lit(",000 --> 00:00:09,000\nsaid "), F.col("event_type"), F.lit("\nNOTE x\n by "), F.col("user_id"), F.lit(" \n"))
    return extract.records(files(P.table(spark, sf_dir, "events"), named("event_id", ".srt"), content)).select("source_path", "text")


@query("src13_printable_runs", "SELECT 'in/' || item_id || '.pb' AS source_path, 'item ' || item_id || chr(10) || 'long run' AS text FROM benchmark")
def src13_printable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("\x01\x02abc\x03item "), F.col("item_id"), F.lit("\x04\x05long  run\x06xy"))
    return extract.records(files(P.table(spark, sf_dir, "benchmark"), named("item_id", ".pb"), content)).select("source_path", "text")


@query("src15_session_logs", "SELECT 'in/' || conv_id || '-' || turn || '.jsonl#L2' AS source_path, trim(text, ' ') AS text, role FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ') <> ''")
def src15_session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bad line, then a message: only the message is a record, with its line."""
    part = F.struct(F.lit("").alias("text"), F.col("text").alias("input_text"))
    line = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct(F.lit("message").alias("type"), "role", F.array(part).alias("content")).alias("payload")))
    path = F.concat(F.lit("in/"), F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit(".jsonl"))
    made = files(P.table(spark, sf_dir, "conversations"), path, F.concat(F.lit("not json\n"), line), "ai_session")
    return extract.records(made).select("source_path", "text", F.element_at("metadata", "role").alias("role"))


# Schedules: a user's events as the jobs of a root, whose next scans are due by intervals of 1 to 24 hours.


@query("str7_scan_status", """WITH j AS (SELECT event_id AS id, user_id AS root,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND value < 1 THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN event_type <> 'error' OR value >= 20 THEN ts END AS started FROM events),
s AS (SELECT DISTINCT user_id AS root, user_id % 11 <> 0 AS enabled, 3600 * (1 + user_id % 24) AS secs, user_id % 5 = 0 AS busy FROM events),
e AS (SELECT root, max(started) FILTER (WHERE status <> 'error' OR started IS NOT NULL) AS last_at, bool_or(status = 'running') AS running, max(id) AS last_job, arg_max(status, id) AS last_status FROM j GROUP BY root)
SELECT CAST(s.root AS VARCHAR) AS root_path, last_job, last_status, last_at AS last_triggered_at, last_at + to_seconds(secs) AS next_due_at,
  CASE WHEN NOT enabled THEN 'disabled' WHEN running THEN 'scan_running' WHEN TIMESTAMP '2024-01-31 00:00:00' < last_at + to_seconds(secs) THEN 'waiting_for_interval' WHEN busy THEN 'cluster_busy' END AS reason
FROM s JOIN e ON s.root = e.root""")  # fmt: skip
def str7_scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").withColumn("root_path", F.col("user_id").cast("string"))
    kind, value = F.col("event_type"), F.col("value")
    jobs = e.select(
        F.col("event_id").alias("id"), "root_path", F.when(kind == "error", "error").when((kind == "signup") & (value < 1), "running").otherwise("completed").alias("status"),
        F.when((kind != "error") | (value >= 20), F.col("ts")).alias("started_at"), kind.alias("message"),
    )
    schedules = e.select("root_path", (F.col("user_id") % 11 != 0).alias("enabled"), (3600 * (1 + F.col("user_id") % 24)).alias("interval_seconds"), (F.col("user_id") % 5 == 0).alias("busy")).distinct()
    out = status.scans(jobs, schedules, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), {"cluster_busy": F.col("busy")})
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_triggered_at", "next_due_at")]
    return out.select("root_path", "last_job", "last_status", *times, "reason")
