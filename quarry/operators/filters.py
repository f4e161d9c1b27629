"""Search filters over results, and the rules that classify and skip files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ("path_contains", "source_kind", "drive", "extension", "project", "file_type", "date_from", "date_to")


def normalized(filters: Mapping[str, object] | None) -> dict[str, str]:
    """Trimmed lower-case values; blank and None values drop out; a drive keeps its letter and colon."""
    out = {k: str(v).strip().lower() for k, v in (filters or {}).items() if k in KEYS and v is not None and str(v).strip()}
    if "drive" in out:
        out["drive"] = out["drive"].rstrip("\\/").rstrip(":") + ":"
    if "extension" in out:
        out["extension"] = "." + out["extension"].lstrip(".")
    return out


def predicate(filters: Mapping[str, object] | None) -> Column:
    """Whether a row of source_path, source_kind and metadata passes all filters."""
    f, path, metadata = normalized(filters), F.col("source_path"), F.col("metadata")
    out = F.lit(True)
    if v := f.get("path_contains"):
        out &= F.lower(path).contains(v)
    if v := f.get("source_kind"):
        out &= F.lower("source_kind") == v
    if v := f.get("drive"):
        out &= F.lower(path).startswith(v)
    if v := f.get("extension"):
        out &= S.result_extension(metadata, path) == v
    if v := f.get("project"):
        named = F.exists(F.array(*[F.lower(S.meta(metadata, k)) for k in S.PROJECT_KEYS]), lambda x: x.contains(v))
        out &= named | F.exists(S.path_parts(path), lambda x: x.contains(v))
    if v := f.get("file_type"):
        out &= S.file_type(metadata, F.col("source_kind"), path) == S.normalized_type(F.lit(v))
    if "date_from" in f or "date_to" in f:
        day = S.record_date(metadata)
        out &= day.isNotNull()
        for key, sign in (("date_from", 1), ("date_to", -1)):
            bound = S.iso_date(F.lit(f.get(key)).cast("string"))
            out &= bound.isNull() | ((day >= bound) if sign > 0 else (day <= bound))
    return out


def candidates(limit: int, filters: Mapping[str, object] | None) -> int:
    """How many results are fetched before filters; a dict with blank values still fetches more."""
    return max(8 * limit, 50) if filters else limit


def of_source(path: str, column: str = "source_path") -> Column:
    """The source itself or one of its #fragments, whose prefix is matched without regard to ASCII case."""
    return (F.col(column) == path) | ilike(F.col(column), S.like_escaped(path) + "#%")


def ilike(column: Column, pattern: str) -> Column:
    """A pattern whose escape sign is `!`, without regard to case."""
    return F.ilike(column, F.lit(pattern), F.lit("!"))


def under_root(root: str, column: str = "path") -> Column:
    base = S.like_escaped(root.rstrip("\\/"))
    p = F.col(column)
    return (p == root) | ilike(p, base + "\\%") | ilike(p, base + "/%")


def clamped(value: object, low: int = 1, high: int = 50, default: int = 10) -> int:
    """A limit from user input."""
    try:
        return max(low, min(high, int(str(value))))
    except ValueError:
        return default


def parts_of(path: str) -> tuple[str, ...]:
    """A path's lower-case parts, between slashes of either kind: what `scalars.path_parts` gives for a column (which drops a record's #fragment first)."""
    return tuple(p for p in path.replace("/", "\\").lower().split("\\") if p)


def _starts(parts: Column, folders: Sequence[str]) -> Column:
    """Whether the parts begin with those of one of the folders: one lookup a length of folder."""
    by_length: dict[int, list[str]] = {}
    for f in map(parts_of, folders):
        by_length.setdefault(len(f), []).append("\\".join(f))
    out = F.lit(False)
    for n, some in sorted(by_length.items()):
        out |= F.array_join(F.slice(parts, 1, n), "\\").isin(*some)
    return out


def under_any(path: Column, folders: Sequence[str]) -> Column:
    """Whether a path is one of the folders or in one of them, without regard to case or to the kind of slash."""
    return _starts(S.path_parts(path), folders)


def in_scope_or_above(path: Column, scopes: Sequence[str]) -> Column:
    """Whether a path is a scope, in one, or one of the folders that lead to one."""
    above = sorted({"\\".join(s[:n]) for s in map(parts_of, scopes) for n in range(1, len(s) + 1)})
    parts = S.path_parts(path)
    return _starts(parts, scopes) | F.array_join(parts, "\\").isin(*above)


@dataclass(frozen=True)
class Pruning:
    """Which folders a walk enters below its root.

    names and name_prefixes: of a folder, judged below the root only, so a root that has such a name itself is
    walked. folders: left out with all that is in them, even as a root. scopes: a walk from the very top of
    their drive (their first part) enters only what is in a scope or leads to one; any other root is free.
    """

    names: frozenset[str] = frozenset()
    name_prefixes: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "_folders", frozenset(map(parts_of, self.folders)))
        object.__setattr__(self, "_scopes", frozenset(map(parts_of, self.scopes)))
        object.__setattr__(self, "_above", frozenset(s[:n] for s in map(parts_of, self.scopes) for n in range(1, len(s) + 1)))

    def begins(self, root: str) -> bool:
        parts = parts_of(root)
        return not any(parts[:n] in self._folders for n in range(1, len(parts) + 1))

    def enters(self, root: str, folder: str) -> bool:
        """folder: below root, in a folder that was entered."""
        parts, top = parts_of(folder), parts_of(root)
        name = parts[-1]
        if name in self.names or name.startswith(self.name_prefixes) or parts in self._folders:
            return False
        if len(top) == 1 and top in self._above:
            return parts in self._above or any(parts[:n] in self._scopes for n in range(1, len(parts)))
        return True


@dataclass(frozen=True)
class PathRule:
    """The first rule whose condition holds decides a path's kind, whether it is skipped, and why.

    sequence: consecutive parts anywhere; prefix: at the start; folders: one of them is the path or holds it;
    outside: the path is on the drive (first part) of these scopes, but in none of them; any_part: one of the
    parts; after: a part somewhere after another; name_prefix: a part that starts so; suffixes: the extension.
    All that are given must hold.
    """

    reason: str
    kind: str
    skip: bool
    sequence: tuple[str, ...] = ()
    prefix: tuple[str, ...] = ()
    any_part: tuple[str, ...] = ()
    after: tuple[str, str] | None = None
    name_prefix: str = ""
    suffixes: tuple[str, ...] = ()
    depth: int = 0
    folders: tuple[str, ...] = ()
    outside: tuple[str, ...] = ()

    def holds(self, path: Column, parts: Column | None = None) -> Column:
        """parts: those of the path, where they were split before."""
        parts, out = S.path_parts(path) if parts is None else parts, F.lit(True)
        if self.folders:
            out &= _starts(parts, self.folders)
        if self.outside:
            out &= F.get(parts, 0).isin(*sorted({parts_of(s)[0] for s in self.outside})) & ~_starts(parts, self.outside)
        if self.sequence:
            n, want = len(self.sequence), F.array(*map(F.lit, self.sequence))
            at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.slice(parts, i, F.lit(n)) == want)
            out &= F.exists(at, lambda x: x)
        if self.prefix:
            out &= F.slice(parts, 1, len(self.prefix)) == F.array(*map(F.lit, self.prefix))
        if self.any_part:
            out &= F.exists(parts, lambda x: x.isin(*self.any_part))
        if self.after:
            anchor = F.array_position(parts, self.after[0])
            out &= (anchor > 0) & F.array_contains(F.slice(parts, F.greatest(anchor, F.lit(1)).cast("int") + 1, F.size(parts) + 1), self.after[1])
        if self.name_prefix:
            out &= F.exists(parts, lambda x: x.startswith(self.name_prefix))
        if self.suffixes:
            out &= S.suffix(path).isin(*self.suffixes)
        if self.depth:
            out &= F.size(parts) == self.depth
        return out


# Extensions that hold no text worth indexing. Layout-specific rules are the caller's data.
MEDIA = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".webm", ".mp3", ".wav", ".flac", ".ogg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg")
ARCHIVES = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".zst")
BINARIES = (".exe", ".dll", ".node", ".sys", ".iso", ".bin", ".dat", ".db", ".sqlite", ".sqlite-shm", ".sqlite-wal", ".tv", ".tvim")
# Folder names that are skipped everywhere.
SKIPPED_FOLDERS = frozenset((
    "$recycle.bin", ".android", ".cache", ".dart_tool", ".ollama", ".pub-cache", "boot", "system volume information", "windows", "program files", "program files (x86)", "programdata", "recovery",
    "chrome-debug-profile", "ffmpeg", "inetpub", "intel", "jaxcorecache", "node_modules", ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "dist", "build", "buildtools", "target", "out",
    ".next", ".nuxt", ".turbo", ".angular", ".claw", ".claude", ".nox", ".npm", ".parcel-cache", ".pip-cache", ".pnpm-store", ".svelte-kit", ".tox", ".tmp-skill-research", ".uv-cache", ".vite", ".yarn",
    ".gradle", ".fvm", ".pytest_cache", ".mypy_cache", ".ruff_cache", "bower_components", "bugreports", "cache", "game a plague tale", "pods", "pub-cache", "tmp", "temp", "ollama", "hf_cache",
    "image_cache", "logs", "msdownld.tmp", "npm-cache", "onedrivetemp", "perflogs", "pip-cache", "pnpm-store", "site-packages", "session_tiktok", "temp_pip", "uv-cache", "ubuntu", "windows kits",
    "vs community", "wsl", "_commonredist", "a plague tale - innocence",
))
SKIPPED_PREFIX = "ffmpeg-"
RULES = (
    PathRule("media_extension", "media", True, suffixes=MEDIA),
    PathRule("archive_extension", "archive", True, suffixes=ARCHIVES),
    PathRule("binary_extension", "binary", True, suffixes=BINARIES),
    PathRule("session_log", "ai_session", False, any_part=("sessions",), suffixes=(".jsonl",)),
    PathRule("memory_notes", "ai_memory", False, any_part=("memories",)),
    PathRule("appdata", "system_cache", True, any_part=("appdata",)),
    PathRule("skip_dir", "system_cache", True, any_part=tuple(sorted(SKIPPED_FOLDERS))),
    PathRule("skip_dir", "system_cache", True, name_prefix=SKIPPED_PREFIX),
    PathRule("project", "project_source", False, any_part=("projects", "repos")),
)
#: Reasons that don't count where the part that gives them lies in the root itself.
RELAXED = ("skip_dir", "appdata")
CAPS = {".docx": 500 << 20, ".pptx": 500 << 20, ".xlsx": 500 << 20, ".pdf": 150 << 20}
OTHER_CAP = 20 << 20


def classified(path: Column, rules: Sequence[PathRule] = RULES) -> Column:
    """struct(kind, skip, reason) by the first rule that holds. The path is split once for all rules."""
    rest = F.struct(F.lit("normal_file").alias("kind"), F.lit(False).alias("skip"), F.lit("normal_file").alias("reason"))

    def first(parts: Column) -> Column:
        out = None
        for r in rules:
            value = F.struct(F.lit(r.kind).alias("kind"), F.lit(r.skip).alias("skip"), F.lit(r.reason).alias("reason"))
            out = F.when(r.holds(path, parts), value) if out is None else out.when(r.holds(path, parts), value)
        return out.otherwise(rest)

    return F.get(F.transform(F.array(S.path_parts(path)), first), 0) if rules else rest


def classified_under(path: Column, root: Column, rules: Sequence[PathRule] = RULES) -> Column:
    """As classified; relaxed reasons are judged on the part of the path below its root."""
    below = F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)
    whole, inner = classified(path, rules), classified(below, [r for r in rules if r.reason in RELAXED])
    kept = classified(path, [r for r in rules if r.reason not in RELAXED])
    return F.when(whole["reason"].isin(*RELAXED) & ~inner["reason"].isin(*RELAXED), kept).otherwise(whole)


def size_cap(path: Column) -> Column:
    out = F.lit(OTHER_CAP)
    for ext, cap in CAPS.items():
        out = F.when(S.suffix(path) == ext, F.lit(cap)).otherwise(out)
    return out


def skip_reason(path: Column, size: Column, rule: Column, archives: bool = False) -> Column:
    """Why a file isn't indexed, or null: archives on request bypass the rules, sessions the size cap."""
    zip_asked = F.lit(archives) & (S.suffix(path) == ".zip")
    return (
        F.when(zip_asked, F.lit(None).cast("string")).when(rule["skip"], rule["reason"]).when(size.isNull(), "unreadable")
        .when(rule["kind"] == "ai_session", F.lit(None).cast("string")).when(size > size_cap(path), "too_large")
    )
