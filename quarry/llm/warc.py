"""WARC derivatives: responses become linked metadata and plain-text conversion records.

`read` takes WARC files as text records with the records' own separator, so Spark decompresses them, and
joins again what a payload that quotes the separator was cut into: a record is as long as its Content-Length
says. Compressed files are one task each; plain ones are split for reading and meet in one stream a file.
`parsed` takes a record's bytes apart. Each response gives two records that refer to it: `metadata`
(application/warc-fields: title, language, links, every header line of the source's HTTP response, and its
length and digest) and `conversion` (the visible text). Identifiers are derived from the source's, so a rerun
gives the same ones; digests are `sha1:` with hex digits over the bytes of a block. A source's payload digest
is carried on as its header has it; without one it is made over the payload's bytes. For the text, chunked
transfers are joined, gzip and deflate contents unpacked, and bytes read in the charset of the HTTP header or
else of the page (UTF-8 if neither names a known one); what can't be unpacked or read becomes U+FFFD. Headers
and tags are built-in functions; Python steps read the bytes and decode character references.

A null payload is an empty one; a null target URI leaves its header lines out; a null identifier is
derived from URI and payload digest. Header names may repeat: `parsed` keeps all values in their order.
A block that is shorter than its Content-Length is `complete = false`, and so are its derivatives. Repeated
responses give repeated derivatives, empty tables none. Texts are converted whole. Extra columns are left
out, but for those named in `keep`, which must not be named like results. A record of over 2 GiB stays
incomplete.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.scalars import let
from .common import spread, table

#: The pages table has no fetch time; responses made from it carry this one.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: What lies between two records of a file; the digit of the minor version is left at the start of the next.
SEPARATOR = f"{CRLF}{CRLF}WARC/1."
#: A tag ends at the first `>` that isn't in quotes.
_ATTRIBUTES = """[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
_BREAKING = "p|div|br|hr|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|tr|td|th|caption|table|article|nav|section|header|footer|main|aside|figure|figcaption|form|option|blockquote|pre"
#: Patterns that both Java and RE2 read alike, in this order: what isn't shown, breaking tags, other tags.
TO_TEXT = (
    (r"(?s)<(?:!--.*?(?:-->|\z)|(?i:script\b[^>]*>.*?(?:</script[^>]*>|\z)|style\b[^>]*>.*?(?:</style[^>]*>|\z)|head\b[^>]*>.*?</head>))", " "),
    (rf"(?i)</?(?:{_BREAKING})\b{_ATTRIBUTES}", "\n"),
    (rf"</?[a-zA-Z!?]{_ATTRIBUTES}", ""),
)
SPACES = ((r"[ \t\r]+", " "), (r" ?\n[ \n]*", "\n"))
RESULTS = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "complete", "block")


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Character references of HTML, named and numeric."""
    return text.map(lambda t: entities.unescape(t) if t and "&" in t else t)


def visible_text(html: Column) -> Column:
    for pattern, put in TO_TEXT:
        html = F.regexp_replace(html, pattern, put)
    html = decoded(html)
    for pattern, put in SPACES:
        html = F.regexp_replace(html, pattern, put)
    return F.trim(html, F.lit(" \n"))


def sha1_of(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text.cast("binary")))


def urn(*parts: Column) -> Column:
    """A name-based identifier (version 3) of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def checked(keep: Sequence[str]) -> None:
    if clash := set(keep) & {*RESULTS, "http_header", "payload"}:
        raise ValueError(f"kept columns named like results: {sorted(clash)}")


def http_responses(pages: DataFrame, date: str = DATE, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """WARC response records, as bytes in `record`, for rows of url and html."""
    checked(keep)
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2), payload)
    uri = F.concat(F.lit("WARC-Target-URI: "), "url")
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), urn(F.coalesce("url", F.lit("")), sha1_of(payload))), uri, F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: "), sha1_of(payload)), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(http).cast("string")),
    )
    return pages.select(*keep, F.concat(head, F.lit(CRLF * 2), http, F.lit(CRLF * 2)).cast("binary").alias("record"))


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments of files, in order, as records of the length that their headers state.

    Fragments follow a record until it is long enough. If no fragment ends where the record has to, it is torn,
    and the fragments behind its first one are records of their own.
    """
    gap, start = f"{CRLF * 2}".encode() + b"WARC/1.", b"WARC/1."

    def need(data: bytes) -> int:
        at = data.find(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", data[: max(0, at)])
        size = at + 4 + int(length[1]) if length else 0
        return size if size < 1 << 31 else 0

    def settled(parts: list[bytes], ended: bool) -> Iterator[bytes]:
        """Records off the front of parts; what may go on stays."""
        while parts:
            if not parts[0]:  # no record begins so
                del parts[0]
                continue
            first = parts[0] if parts[0].startswith(b"WARC/") else start + parts[0]
            size, have, used = need(first), len(first), 1
            while have < size and used < len(parts):
                have += len(gap) + len(parts[used])
                used += 1
            if have < size and not ended:
                return
            if used > 1 and not size <= have <= size + 8:  # a closing blank line may follow the last record
                used = 1
            yield gap.join([first, *parts[1:used]])
            del parts[:used]

    def packed(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    held, name = [], None
    for batch in batches:
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
            if file != name:
                yield from (packed([r]) for r in settled(held, True))
                held, name = [], file
            held.append(value.as_py())
            if done := list(settled(held, False)):
                yield packed(done)
    yield from (packed([r]) for r in settled(held, True))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of WARC files, compressed or not, as bytes in `record`."""
    files = spark.read.text(list(paths)).inputFiles()
    out = []
    for packed in (True, False):
        own = [f for f in files if f.lower().endswith((".gz", ".bz2", ".zst")) == packed]
        if own:
            lines = spark.read.option("lineSep", SEPARATOR).text(own)
            lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("value"))
            ordered = lines if packed else lines.repartition("file").sortWithinPartitions("file", "split", "nth")
            out.append(ordered.select("file", "value").mapInArrow(whole_records, "record binary"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def fields_of(head: Column) -> Column:
    """The name and value of each line of a header but the first, in order; folded lines are joined."""
    whole = F.split(F.regexp_replace(head, r"\r\n[ \t]+", " "), CRLF)
    lines = F.filter(whole, lambda x, i: (i > 0) & x.contains(":"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))


def by_name(fields: Column) -> Column:
    """A map of lower-case names to all of their values."""

    def grouped(low: Column) -> Column:
        names = F.array_distinct(F.transform(low, lambda f: f["name"]))
        return let(names, lambda ns: F.map_from_arrays(ns, F.transform(ns, lambda n: F.transform(F.filter(low, lambda f: f["name"] == n), lambda f: f["value"]))))

    return let(F.transform(fields, lambda f: F.struct(F.lower(f["name"]).alias("name"), f["value"].alias("value"))), grouped)


def split_at_blank_line(data: Column) -> tuple[Column, Column]:
    """The header of bytes as text, and the bytes that follow."""
    head = F.substring_index(data.cast("string"), CRLF * 2, 1)
    return head, F.substring(data, F.octet_length(head) + 5, F.octet_length(data))


def parsed(records: DataFrame, column: str = "record") -> DataFrame:
    """records with header (a map of lower-case names to lists of values), block (bytes) and complete."""
    head, rest = split_at_blank_line(F.col(column))
    out = records.withColumns({"__head": head, "__rest": rest}).withColumn("header", by_name(fields_of(F.col("__head"))))
    length = F.try_element_at(F.col("header"), F.lit("content-length"))[0].try_cast("int")
    return out.withColumns({"block": F.substring("__rest", F.lit(1), F.coalesce(length, F.lit(0))), "complete": F.coalesce(F.octet_length("__rest") >= length, F.lit(False))}).drop("__head", "__rest")


def dechunked(data: bytes) -> bytes:
    """The body of a chunked transfer; from the first length that is none on, the rest as it is."""
    out, at = [], 0
    while m := re.compile(rb"[ \t]*([0-9A-Fa-f]{1,8})[^\r\n]*\r?\n").match(data, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"
    return b"".join([*out, data[at:]])


def unpacked(data: bytes, coding: str) -> bytes:
    """gzip or deflate contents, as far as they go; others as they are."""
    for width in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        part = zlib.decompressobj(width)
        try:
            return part.decompress(data)
        except zlib.error:
            continue
    return data


def read_text(data: bytes, charset: str) -> str:
    """Bytes in a charset, or else in that which the page's first kilobyte names, or in UTF-8."""
    named = charset or (m[1].decode() if (m := re.search(rb"""(?i)<meta[^>]{0,200}charset=["']?([a-z0-9_:.-]+)""", data[:1024])) else "utf-8")
    try:
        return data.decode(named, "replace")
    except (LookupError, ValueError):  # no charset of text
        return data.decode("utf-8", "replace")


@F.pandas_udf(StructType().add("text", "string").add("body_length", "long").add("body_sha1", "string"))
def body(payload: pd.Series, header: pd.Series) -> pd.DataFrame:
    """Of each payload's bytes under its HTTP header: the text, and length and digest of the body as it was sent."""

    def of(data: bytes, head: str) -> tuple[str, int, str]:
        one = lambda name, value: m[1].lower() if (m := re.search(rf"(?im)^{name}:[^\r\n]*?{value}", head)) else ""
        sent = dechunked(data) if one("transfer-encoding", r"\b(chunked)\b") else data
        content = unpacked(sent, one("content-encoding", r"\b(x-gzip|gzip|deflate)\b"))
        return read_text(content, one("content-type", r"charset=[\"']?([^\s;\"']+)")), len(sent), hashlib.sha1(sent).hexdigest()

    return pd.DataFrame([of(d or b"", h or "") for d, h in zip(payload, header, strict=True)], columns=["text", "body_length", "body_sha1"])


def responses(records: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """record_id, target_uri, date, http_header, payload (text), payload_length and payload_digest (of its bytes), complete: of the response records among WARC records (bytes in `record`)."""
    checked(keep)
    # The record's header is read for the few names that are needed; `parsed` has them all.
    head, rest = split_at_blank_line(F.col("record"))
    whole = F.regexp_replace(head, r"\r\n[ \t]+", " ")
    out = records.withColumns({"__head": whole, "__rest": rest}).filter(F.col("__head").rlike(r"(?i)\r\nWARC-Type:[ \t]*response[ \t]*(\r\n|$)"))
    one = lambda name: F.nullif(F.regexp_extract("__head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1), F.lit(""))
    length = one("Content-Length").try_cast("long")
    block = F.substring("__rest", F.lit(1), F.coalesce(F.least(length, F.lit((1 << 31) - 1)), F.lit(0)).cast("int"))
    out = out.select(
        *keep, one("WARC-Record-ID").alias("record_id"), one("WARC-Target-URI").alias("target_uri"), one("WARC-Date").alias("date"), one("WARC-Payload-Digest").alias("__digest"),
        F.coalesce(F.octet_length("__rest") >= length, F.lit(False)).alias("complete"), block.alias("__block"),
    )
    http, payload = split_at_blank_line(F.col("__block"))
    out = spread(out).withColumns({"http_header": F.make_valid_utf8(http), "__payload": payload}).drop("__block").withColumn("b", body("__payload", "http_header"))
    return out.select(
        *keep, "record_id", "target_uri", "date", "http_header", F.col("b.text").alias("payload"), F.col("b.body_length").alias("payload_length"),
        F.coalesce("__digest", F.concat(F.lit("sha1:"), "b.body_sha1")).alias("payload_digest"), "complete",
    )


def derivatives(source: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Two rows a response, as `responses` gives them: record_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest, payload_digest, complete, block."""
    checked(keep)
    payload = F.coalesce("payload", F.lit(""))
    digest = F.coalesce("payload_digest", sha1_of(payload))
    s = source.select(
        *keep, "target_uri", "date", payload.alias("__payload"), F.coalesce("http_header", F.lit("")).alias("__http"), digest.alias("payload_digest"), "complete",
        F.coalesce("payload_length", F.octet_length(payload).cast("long")).alias("__length"), F.coalesce("record_id", urn(F.coalesce("target_uri", F.lit("")), digest)).alias("refers_to"),
    )
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract("__payload", r"(?is)<title[^>]*>(.*?)</title>", 1)), r"[ \t\r\n]+", " "))
    fields = [
        ("title", title),
        ("language", F.regexp_extract("__payload", r"(?i)<html[^>]* lang=\"([^\"]*)\"", 1)),
        ("links", F.regexp_count("__payload", F.lit(r"(?i)<a [^>]*href=")).cast("string")),
        ("source-status", F.regexp_extract("__http", r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        ("source-payload-length", F.col("__length").cast("string")),
        ("source-payload-digest", F.col("payload_digest")),
    ]
    source_lines = F.array_join(F.transform(fields_of(F.col("__http")), lambda f: F.concat(F.lit("source-header: "), f["name"], F.lit(": "), f["value"], F.lit(CRLF))), "")
    metadata = F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields], source_lines)
    made = [("metadata", "application/warc-fields", F.col("__metadata")), ("conversion", "text/plain; charset=utf-8", F.col("__text"))]
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("record_type"), F.lit(c).alias("content_type"), b.alias("block")) for t, c, b in made]))
    out = s.withColumns({"__metadata": metadata, "__text": visible_text(F.col("__payload"))}).select(*keep, "target_uri", "date", "refers_to", "payload_digest", "complete", both.alias("r")).select("*", "r.*").drop("r")
    return out.select(
        *keep, "record_type", urn(F.col("refers_to"), F.col("record_type")).alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), sha1_of(F.col("block")).alias("block_digest"), "payload_digest", "complete", "block",
    )


def serialized(records: DataFrame) -> DataFrame:
    """records with `record`: the bytes of the WARC/1.0 record, header lines, block and closing lines. The digest of the source's payload is a field of its own."""
    uri = F.col("target_uri")
    lines = [
        F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri), F.concat(F.lit("WARC-Refers-To-Date: "), "date"), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Refers-To-Payload-Digest: "), "payload_digest"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    text = F.concat(F.concat_ws(CRLF, F.lit("WARC/1.0"), *lines), F.lit(CRLF * 2), "block", F.lit(CRLF * 2))
    return records.withColumn("record", text.cast("binary"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the bytes of WARC responses, parsed, and their derivatives."""
    return derivatives(responses(http_responses(table(spark, sf_dir, "pages").select("page_id", "url", "html"))))


def _sql_text(column: str) -> str:
    """The visible text by rules of the SQL's own, for the tags and character references that the fixture has."""
    for pattern, put in (
        ("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("(?is)<head[^>]*>.*?</head>", " "), ("(?s)<!--.*?-->", " "),
        ("(?i)</?(article|aside|blockquote|br|caption|d[dlt]|div|fig[a-z]+|foot[a-z]+|form|h[1-6r]|header|li|main|nav|ol|option|p|pre|section|t[dhr]|table|ul)(\\s[^>]*)?/?>", "' || chr(10) || '"),
        ("</?[A-Za-z!?][^>]*>", ""),
    ):
        column = f"regexp_replace({column}, '{pattern}', '{put}', 'g')"
    column = f"regexp_replace(regexp_replace({_sql_decoded(column)}, '[ \\t\\r]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')"
    return f"trim({column}, ' ' || chr(10))"


def _sql_decoded(column: str) -> str:
    for entity, put in (("&nbsp;?", "\xa0"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&copy;?", "\xa9"), ("&middot;?", "\xb7"), ("&amp;?", "&")):
        column = f"regexp_replace({column}, '{entity}', '{put}', 'g')"
    return column


def _sql_urn(h: str) -> str:
    variant = f"substr('89ab', CAST(('0x' || {h}[17]) AS INTEGER) % 4 + 1, 1)"
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-3' || {h}[14:16] || '-' || {variant} || {h}[18:20] || '-' || {h}[21:32] || '>'"


OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, 'sha1:' || sha1(coalesce(html, '')) AS payload_digest, chr(13) || chr(10) AS nl FROM pages
), s AS (
  SELECT *, md5(coalesce(target_uri, '') || '|' || payload_digest) AS h FROM p
), u AS (
  SELECT *, {_sql_urn("h")} AS refers_to FROM s
), m AS (
  SELECT page_id, target_uri, refers_to, payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || trim(regexp_replace({_sql_decoded("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '[ \t\r\n]+', ' ', 'g')) || nl
         || 'language: ' || regexp_extract(payload, '(?i)<html[^>]* lang="([^"]*)"', 1) || nl
         || 'links: ' || len(regexp_extract_all(payload, '(?i)<a [^>]*href=')) || nl
         || 'source-status: 200' || nl || 'source-payload-length: ' || strlen(payload) || nl || 'source-payload-digest: ' || payload_digest || nl
         || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || strlen(payload) || nl AS block
  FROM u
  UNION ALL
  SELECT page_id, target_uri, refers_to, payload_digest, 'conversion', 'text/plain; charset=utf-8', {_sql_text("payload")} FROM u
), r AS (
  SELECT *, md5(refers_to || '|' || record_type) AS k FROM m
)
SELECT page_id, record_type, {_sql_urn("k")} AS record_id, refers_to, target_uri, '{DATE}' AS date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha1:' || sha1(block) AS block_digest, payload_digest, true AS complete, block
FROM r
"""
