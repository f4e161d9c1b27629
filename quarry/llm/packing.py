"""Concatenate-and-cut packing.

Pass one tokenizes each document where it lies, appends the end id and keeps, beside the ids, the count
of ids before the document in its partition. The partitions' totals (a row a partition) are summed to
global offsets. Pass two cuts the stream at every multiple of the window: a document that crosses a
window's end becomes boundary records in each window it touches. No text or ids are shuffled.

A null text is an empty document, which is the end id alone. Repeated rows are packed as often as they
occur. Documents of any length are cut as often as needed. An empty table gives no pieces. Documents
are packed in the order in which the input's partitions hold them. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Byte-level BPE splits a text by this published pattern before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Text to ids as little-endian uint16, equal to the tokenizer file's own.

    A faster encoder gets the file's vocabulary as ranks; what it refuses (very long white space) goes
    to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special}
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u2").tobytes()
        except ValueError:
            return self.whole(text)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (uint16, the end id last), tokens, part, before: the ids before this document in its partition."""
    last = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, tokens, starts = [], [], []
            for text in batch.column("text"):
                ids.append(encoder.encode(text.as_py() or "") + last)
                tokens.append(len(ids[-1]) // 2)
                starts.append(before)
                before += tokens[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                names=["doc_id", "ids", "tokens", "part", "before"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, tokens long, part int, before long")


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (uint16), ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = written(tokenized(docs, path or vocabulary_path(), end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("total"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "ids", (F.col("ahead") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("at").to_pylist(), strict=True):
                data = np.frombuffer(ids.as_buffer(), "<u2")
                wide, start = data.astype("<u4"), 0
                while start < len(data):
                    sequence, offset = divmod(at + start, window)
                    stop = min(len(data), start + window - offset)
                    out.append((doc_id, start, stop - start, data[start:stop].tobytes(), zlib.crc32(wide[start:stop].tobytes()), len(data), sequence, offset))
                    start = stop
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)], names=NAMES)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (uint16), tokens: the pieces of each window put together; a window bounds its group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(whole.alias("ids"), F.sum("length").alias("tokens"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
