"""Schemas of the corpus tables. All operators take and return DataFrames of these shapes."""

from pyspark.sql import types as T

SOURCE_KINDS = ("normal_file", "project_source", "ai_session", "ai_memory", "system_cache", "archive", "media", "binary")

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "map<string,string>": T.MapType(T.StringType(), T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType())}


def table(columns: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.strip().split(" ") for c in columns.split(", "))])


RECORDS = table("source_path string, source_kind string, title string, text string, metadata map<string,string>")
CHUNKS = table(
    "id long, source_path string, source_kind string, title string, text string, metadata map<string,string>, ordinal int, content_hash string, "
    "active boolean, vector_status string, created_at timestamp, updated_at timestamp"
)
VECTORS = table("chunk_id long, embedding array<float>")
POSTINGS = table("term string, chunk_id long, positions array<int>, len int, active boolean")
SOURCE_FILES = table(
    "path string, source_kind string, fingerprint string, size_bytes long, mtime_ns long, status string, error string, last_indexed_at timestamp, updated_at timestamp"
)
#: A file's state in a store: its place, and of its chunks how many there are, their tokens, and how many active ones lack a vector.
FILE_STATES = T.StructType(SOURCE_FILES.fields + table("place long, chunks long, tokens long, lacking long").fields)
JOBS = table(
    "id long, root_path string, status string, discovered long, indexed long, skipped long, error long, message string, started_at timestamp, updated_at timestamp, finished_at timestamp"
)
SAVED_SEARCHES = table("id long, name string, query string, filters map<string,string>, created_at timestamp, updated_at timestamp")
LISTING = table("path string, root string, size_bytes long, mtime_ns long, error string")
RESULT_COLUMNS = ["chunk_id", "source_path", "source_kind", "title", "snippet", "score", "rank_source", "metadata"]
