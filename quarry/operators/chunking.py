"""Records to chunks: overlapping word windows, and code cut at its symbols."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MAX_WORDS, OVERLAP = 900, 120

# Extensions and the lines at which a symbol of each language starts.
CODE_EXTENSIONS = (".c", ".cc", ".cpp", ".cs", ".dart", ".go", ".h", ".hpp", ".java", ".py", ".rs", ".sql", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
_NAME = "([A-Za-z_][A-Za-z0-9_]*)"
_JS_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
LANGUAGES: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "python": ((".py",), [("function", rf"^def\s+{_NAME}\b"), ("class", rf"^class\s+{_NAME}\b")]),
    "javascript": (
        (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"),
        [
            ("function", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+{_JS_NAME}\b"),
            ("class", rf"^(?:export\s+)?(?:default\s+)?class\s+{_JS_NAME}\b"),
            ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{_JS_NAME}\s*=.*=>"),
        ],
    ),
    "go": ((".go",), [("function", rf"^func\s+(?:\([^)]+\)\s*)?{_NAME}\b"), ("class", rf"^type\s+{_NAME}\s+(?:struct|interface)\b")]),
    "rust": ((".rs",), [("function", rf"^{_PUB}(?:async\s+)?fn\s+{_NAME}\b"), ("class", rf"^{_PUB}(?:struct|enum|trait)\s+{_NAME}\b"), ("class", rf"^impl(?:<[^>]+>)?\s+{_NAME}\b")]),
    "sql": (
        (".sql",),
        [
            ("function", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_.$]*)\b"),
            ("class", r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_.$]*)\b"),
        ],
    ),
    "c_like": (
        (".c", ".cc", ".cpp", ".cs", ".dart", ".h", ".hpp", ".java", ".kt", ".php", ".swift"),
        [
            ("class", rf"^(?:(?:public|private|protected|internal|abstract|sealed|final|static)\s+)*(?:class|interface|enum|struct)\s+{_NAME}\b"),
            ("function", rf"^(?!(?:if|for|while|switch|catch|return|new)\b)(?:[\w:<>,~*&\[\]?]+\s+)+{_NAME}\s*\([^;{{}}]*\)\s*(?:async\s*)?(?:const\s*)?(?:\{{|=>)"),
        ],
    ),
}


def checked(max_words: int, overlap: int) -> None:
    if max_words <= 0:
        raise ValueError("max_words must be positive")
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least 0 and less than max_words")


WINDOW = "struct<text:string,start_line:int,end_line:int,kind:string,symbol:string>"
_COMPILED = {ext: [(kind, re.compile(p)) for kind, p in patterns] for extensions, patterns in LANGUAGES.values() for ext in extensions}
Window = tuple[str, int, int, str | None, str | None]


def cut(lines: list[str], first_line: int, max_words: int, step: int, kind: str | None = None, symbol: str | None = None) -> Iterator[Window]:
    """Windows of the words of lines; none where there are no words."""
    words: list[str] = []
    ends = []  # how many words there are up to the end of each line
    for line in lines:
        words += line.split()
        ends.append(len(words))
    n = len(words)
    for at in range(0, max(1, n - max_words + step) if n else 0, step):
        last = min(at + max_words, n)
        yield " ".join(words[at:last]), first_line + bisect_right(ends, at), first_line + bisect_right(ends, last - 1), kind, symbol


def symbol_of(line: str, extension: str) -> tuple[str, str] | None:
    """Kind and name of the symbol that starts on a line; the first pattern that fits decides."""
    for kind, pattern in _COMPILED.get(extension, ()):
        if m := pattern.search(line):
            return kind, m[1].rpartition(".")[2]
    return None


def cut_code(lines: list[str], extension: str, first_line: int, max_words: int, step: int) -> list[Window]:
    """Each symbol up to the next; what stands before the first is left out."""
    marks = [(k, *found) for k, line in enumerate(lines) if (found := symbol_of(line, extension))]
    ends = [k for k, *_ in marks[1:]] + [len(lines)]
    return [w for (at, kind, symbol), end in zip(marks, ends, strict=True) for w in cut(lines[at:end], first_line + at, max_words, step, kind, symbol)]


def chunked(records: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """source_path, source_kind, title, text, metadata, ordinal, content_hash of any records: code by symbol where a record has any, the rest by windows.

    Words and lines are those of Unicode. A record is cut inside its row, whole batches at a time, which is
    several times faster than regular expressions over arrays; ordinals need no exchange.
    """
    checked(max_words, overlap)
    step = max_words - overlap

    @F.arrow_udf(f"array<{WINDOW}>")
    def found(texts: pa.Array, first_lines: pa.Array, extensions: pa.Array) -> pa.Array:
        rows = []
        for text, first, ext in zip(texts.to_pylist(), first_lines.to_pylist(), extensions.to_pylist(), strict=True):
            lines = (text or "").splitlines()
            rows.append(cut_code(lines, ext, first, max_words, step) if ext in _COMPILED and any(symbol_of(x, ext) for x in lines) else list(cut(lines, first, max_words, step)))
        flat = list(zip(*[w for r in rows for w in r], strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        inner = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names=["text", "start_line", "end_line", "kind", "symbol"])
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), inner)

    ext = S.record_extension(F.col("metadata"), F.col("source_path"))
    is_code = F.coalesce((F.col("source_kind") == "project_source") | ext.isin(*CODE_EXTENSIONS), F.lit(False))
    w = records.select("source_path", "source_kind", "title", "metadata", F.posexplode(found("text", S.base_line(F.col("metadata")), F.when(is_code, ext).otherwise(""))).alias("ordinal", "w"))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("start_line", "end_line", "code_symbol", "code_symbol_kind"))
    lines = F.create_map(F.lit("start_line"), F.col("w.start_line").cast("string"), F.lit("end_line"), F.col("w.end_line").cast("string"))
    symbol = F.create_map(F.lit("code_symbol"), "w.symbol", F.lit("code_symbol_kind"), "w.kind")
    return w.select(
        "source_path", "source_kind", F.when(F.col("w.kind").isNull(), F.col("title")).otherwise(F.concat_ws(" ", "title", "w.kind", "w.symbol")).alias("title"), "w.text",
        F.when(F.col("w.kind").isNull(), F.map_concat(own, lines)).otherwise(F.map_concat(own, lines, symbol)).alias("metadata"), "ordinal", F.sha2("w.text", 256).alias("content_hash"),
    )
