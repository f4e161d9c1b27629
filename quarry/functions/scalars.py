"""Scalar rules of the corpus as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and are stated as the corpus format states them.
CODE_TYPE = (".bat", ".c", ".cmd", ".cpp", ".cs", ".css", ".dart", ".go", ".h", ".html", ".java", ".js", ".jsx", ".kt", ".lua", ".php", ".ps1", ".py", ".rb", ".rs", ".sh", ".sql", ".swift", ".tsx", ".ts", ".vue")
CONFIG_TYPE = (".cfg", ".conf", ".env", ".ini", ".json", ".lock", ".properties", ".toml", ".xml", ".yaml", ".yml")
DOCUMENT_TYPE = (".csv", ".doc", ".docx", ".htm", ".md", ".pdf", ".ppt", ".pptx", ".rtf", ".txt", ".xls", ".xlsx")
TRANSCRIPT_TYPE = (".srt", ".vtt", ".ass")
TYPE_ALIASES = {
    "ai-session": "session", "sessions": "session", "ai-memory": "memory", "memories": "memory", "docs": "document", "documents": "document", "captions": "transcript",
    "subtitle": "transcript", "subtitles": "transcript", "transcripts": "transcript", "configs": "config", "settings": "config", "source": "code", "source-code": "code",
}
DATE_KEYS = ("date", "timestamp", "created_at", "updated_at", "modified_at", "mtime", "file_mtime")
PROJECT_KEYS = ("project", "project_name", "repository", "repo")
SECRET_NAMES = "api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|password|credential"
SECRET_ASSIGNMENT = rf"(?i)([A-Za-z0-9_.-]*(?:{SECRET_NAMES})[A-Za-z0-9_.-]*)(\s*[:=]\s*)([\"']?)([^\s\"';&]+)\3"
SECRET_TOKEN = r"\b(?:sk|ghp|gho|ghu|ghs|glpat|xox[baprs])[-_][A-Za-z0-9][A-Za-z0-9._-]{6,}\b"

#: White space and line ends below U+0080, for texts that went through plain_spaces; LINE_END also has the others.
BLANK, WORD = r"[\x09-\x0d\x1c-\x20]+", r"[^\x09-\x0d\x1c-\x20]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_OTHER_LINE_ENDS, _OTHER_SPACES = r"[\x85\u2028\u2029]", r"[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"


def plain_spaces(text: Column) -> Column:
    """text with white space beyond ASCII as spaces and line feeds; texts of ASCII alone, told by their length, are not searched."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.regexp_replace(text, _OTHER_LINE_ENDS, "\n"), _OTHER_SPACES, " "))


#: Latin letters whose mark a search ignores: letter to base letter, from the Unicode decomposition.
_FOLDED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values())))


def tokens(text: Column) -> Column:
    """Search terms: runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(plain_spaces(text), BLANK, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def file_fingerprint(path: Column, size: Column, mtime_ns: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, size.cast("string"), mtime_ns.cast("string")), 256)


def physical_path(source_path: Column) -> Column:
    """A virtual path without its #fragment."""
    return F.substring_index(source_path, "#", 1)


def suffix(path: Column) -> Column:
    """The last name's extension in lower case, with its dot; a leading dot starts none."""
    return F.lower(F.regexp_extract(path, r"[^.\\/](\.[^.\\/]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)[\\/]*$", 1)


def path_parts(source_path: Column) -> Column:
    return F.filter(F.split(F.lower(F.translate(physical_path(source_path), "/", "\\")), r"\\"), lambda x: x != "")


def meta(metadata: Column, key: str) -> Column:
    return F.coalesce(F.trim(F.element_at(metadata, key)), F.lit(""))


def record_extension(metadata: Column, path: Column) -> Column:
    own = F.lower(meta(metadata, "extension"))
    return F.when(own != "", own).otherwise(suffix(path))


def result_extension(metadata: Column, path: Column) -> Column:
    own = F.lower(meta(metadata, "extension"))
    return F.when(own.startswith("."), own).when(own != "", F.concat(F.lit("."), own)).otherwise(suffix(physical_path(path)))


def normalized_type(value: Column) -> Column:
    plain = F.translate(F.lower(F.trim(value)), "_", "-")
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, plain), plain)


def file_type(metadata: Column, kind: Column, path: Column) -> Column:
    ext, own = result_extension(metadata, path), meta(metadata, "file_type")
    out = F.when(own != "", normalized_type(own)).when(kind == "ai_session", "session").when(kind == "ai_memory", "memory")
    for name, extensions in (("transcript", TRANSCRIPT_TYPE), ("config", CONFIG_TYPE), ("code", CODE_TYPE), ("document", DOCUMENT_TYPE)):
        out = out.when(ext.isin(*extensions), name)
    return out.otherwise("file")


def iso_date(value: Column) -> Column:
    """A date from the first ten characters, or from a whole date-time; null if neither is one."""
    v = F.trim(value)
    day = F.when(F.substring(v, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.substring(v, 1, 10)))
    basic = F.when(v.rlike(r"^\d{8}([T ].*)?$"), F.try_to_date(F.substring(v, 1, 8), "yyyyMMdd"))
    return F.coalesce(day, basic)


def record_date(metadata: Column) -> Column:
    return F.coalesce(*[iso_date(F.element_at(metadata, k)) for k in DATE_KEYS])


def positive_int(value: Column) -> Column:
    n = F.trim(value).try_cast("int")
    return F.when(n > 0, n)


def base_line(metadata: Column) -> Column:
    return F.coalesce(*[positive_int(F.element_at(metadata, k)) for k in ("start_line", "line")], F.lit(1))


def redacted(text: Column) -> Column:
    """Values of secret-like assignments, then secret-like tokens, replaced."""
    return F.regexp_replace(F.regexp_replace(text, SECRET_ASSIGNMENT, "$1$2$3[REDACTED_SECRET]$3"), SECRET_TOKEN, "[REDACTED_SECRET]")


def redacted_map(metadata: Column) -> Column:
    return F.transform_values(metadata, lambda _, v: redacted(v))


def like_escaped(text: str) -> str:
    """text for LIKE ... ESCAPE '!', taken literally."""
    return "".join("!" + c if c in "!%_" else c for c in text)


def is_timecode(line: Column) -> Column:
    return line.rlike(r"\d{1,2}:\d{2}:\d{2}[,.]\d{3}")


def byte_label(n: Column) -> Column:
    """A size in whole KB, MB with one digit or GB with two, for reports."""
    kb = F.lit(1024.0)
    return (
        F.when(n >= kb**3, F.format_string("%.2f GB", n / kb**3))
        .when(n >= kb**2, F.format_string("%.1f MB", n / kb**2))
        .otherwise(F.format_string("%d KB", F.floor(n / kb + 0.5).cast("long")))
    )


def source_label(kind: Column) -> Column:
    return F.translate(kind, "_", " ")


def line_label(metadata: Column) -> Column:
    """The lines of a result as its metadata states them; null without a first line."""
    a, b = (F.nullif(F.element_at(metadata, k), F.lit("")) for k in ("start_line", "end_line"))
    return F.when(b.isNotNull() & (a != b), F.concat(F.lit("Lines "), a, F.lit("-"), b)).otherwise(F.concat(F.lit("Line "), a))


def shown_extension(metadata: Column, path: Column) -> Column:
    """Of metadata or else from the last dot of the last name, a leading one included; for labels only."""
    own = F.nullif(F.element_at(metadata, "extension"), F.lit(""))
    return F.coalesce(own, F.lower(F.regexp_extract(physical_path(path), r"(\.[^.\\/]*)$", 1)))


def type_label(metadata: Column, kind: Column, path: Column) -> Column:
    """How a result's type is shown: sessions and memories by kind, others by their extension."""
    ext = shown_extension(metadata, path)
    bare = F.upper(F.regexp_replace(ext, r"^([^.]*)\.", "$1"))
    return F.when(kind == "ai_session", "Session").when(kind == "ai_memory", "Memory").when(ext == "", "File").otherwise(bare)


def storage_label(used: Column) -> Column:
    state = storage_state(used)
    return F.concat(F.when(state == "hard_stop", "Storage stop: ").when(state == "warning", "Storage warning: ").otherwise("Storage: "), byte_label(used))


def scan_label(enabled: Column, seconds: Column, on_power: Column) -> Column:
    """How a scan's interval and guard are shown."""
    every = F.when((seconds >= 3600) & (seconds % 3600 == 0), F.format_string("%dh", (seconds / 3600).cast("long"))).otherwise(F.format_string("%dm", F.floor(seconds / 60 + 0.5).cast("long")))
    return F.when(enabled.isNull(), "Auto: unknown").when(~enabled, "Auto: off").otherwise(F.concat(F.lit("Auto: "), every, F.when(on_power, " charging/idle").otherwise(" idle")))


def log_level(line: Column) -> Column:
    """The first level that stands between blanks, in lower case; else empty."""
    return F.lower(F.regexp_extract(line, r"\s(DEBUG|INFO|WARNING|ERROR)\s", 1))


def without_bom(text: Column, charset: str | None = None) -> Column:
    """text without byte order marks; with a charset as an output in it shows the text, `?` for what it lacks."""
    bare = F.replace(text, F.lit("\ufeff"), F.lit(""))
    if charset is None or charset.upper() in ("UTF-8", "UTF8"):
        return bare
    if charset.upper() != "US-ASCII":
        raise ValueError("UTF-8 or US-ASCII")
    return F.regexp_replace(bare, r"[^\x00-\x7f]", "?")


def storage_state(used: Column, warn: int = 7 << 30, stop: int = 12 << 30) -> Column:
    return F.when(used >= stop, "hard_stop").when(used >= warn, "warning").otherwise("ok")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression named inside a lambda is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """A deterministic unit vector from the text's SHA-256 bytes, repeated to dim; for tests and smoke runs."""

    def unit(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(F.exists(raw, lambda x: x > 0), let(norm, lambda n: F.transform(raw, lambda x: x / n))).otherwise(raw)

    def byte(h: Column, i: int) -> Column:
        return F.conv(F.substring(h, (i % 32) * 2 + 1, 2), 16, 10).cast("double") / 255.0

    return let(F.sha2(F.coalesce(text, F.lit("")), 256), lambda h: let(F.array(*[byte(h, i) for i in range(dim)]), unit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
