"""A quantized vector index: four bits a component for the scan, the exact vectors for the best.

A vector is kept as its largest absolute component (`scale`) and a code from 1 to 15 for each component, two
in a byte, so that a scan reads about an eighth of the bytes of 32-bit vectors. A query makes a table of the
256 products that a byte can stand for at each place; a task adds them up in Arrow batches and keeps its best.
Of these the `over * k` best of all (LEAST at least) are scored anew on the exact vectors, which are read by
their ids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .lookup import by_ids

OVER, LEAST = 8, 50
#: Codes are from -STEPS to STEPS; 8 more makes four bits.
STEPS = 7


def codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scales, and codes as bytes: the component with the even number in the high bits; an odd number of them is filled up with a zero."""
    scale = np.abs(rows).max(axis=1).astype(np.float32)
    unit = np.divide(rows, scale[:, None], out=np.zeros(rows.shape), where=scale[:, None] > 0)
    code = (np.rint(unit * STEPS) + 8).astype(np.uint8)
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)), constant_values=8)
    return scale, code[:, ::2] << 4 | code[:, 1::2]


def table(query: Sequence[float]) -> np.ndarray:
    """For each byte of the codes, what each of its 256 values adds to the inner product with a scale of one."""
    q = np.array([*query, 0.0][: len(query) + len(query) % 2], np.float64).reshape(-1, 2)
    value = (np.arange(16) - 8) / STEPS
    return (q[:, :1, None] * value[None, :, None] + q[:, 1:, None] * value[None, None, :]).reshape(-1, 256).astype(np.float32)


def quantized(rows: DataFrame, dim: int) -> DataFrame:
    """chunk_id, scale, codes of rows of chunk_id and embedding; a task fails on a vector of another length or with components that are no numbers.

    A null vector is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("embedding").offsets))
            if (lengths != dim).any():
                raise ValueError(f"vectors of {dim} components expected")
            flat = batch.column("embedding").flatten()
            if flat.null_count or not np.isfinite(values := flat.to_numpy(zero_copy_only=False).astype(np.float64)).all():
                raise ValueError("components must be finite numbers")
            scale, packed = codes(values.reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(scale), pa.array([r.tobytes() for r in packed], pa.binary())], names=["chunk_id", "scale", "codes"])

    return rows.filter("embedding is not null").select("chunk_id", "embedding").mapInArrow(run, "chunk_id long, scale float, codes binary")


def candidates(index: DataFrame, query: Sequence[float], n: int) -> DataFrame:
    """chunk_id, score: the n best by the codes, ties to smaller ids. A task fails on codes of another length."""
    products, width = table(query), (len(query) + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        place = np.arange(width)
        for batch in batches:
            column = batch.column("codes")
            data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if (np.diff(offsets) != width).any():
                raise ValueError(f"codes of {len(query)} components expected")
            if not len(column):
                continue
            bits = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)
            ids = np.concatenate((ids, batch.column("chunk_id").to_numpy()))
            scores = np.concatenate((scores, products[place, bits].sum(axis=1, dtype=np.float64) * batch.column("scale").to_numpy()))
            if len(ids) > n:  # a task holds its n best
                best = np.lexsort((ids, -scores))[:n]
                ids, scores = ids[best], scores[best]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], names=["chunk_id", "score"])

    return index.select("chunk_id", "scale", "codes").mapInArrow(run, "chunk_id long, score double").orderBy(F.desc("score"), "chunk_id").limit(n)


def nearest(index: DataFrame, exact: DataFrame, query: Sequence[float], k: int, over: int = OVER) -> DataFrame:
    """chunk_id, score: the k largest inner products among the best by the codes, in double precision as `vectors.nearest` has them.

    The candidates' ids, max(over * k, LEAST) of them, go through the driver into the scan of the exact vectors.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    ids = [r["chunk_id"] for r in candidates(index, query, max(over * k, LEAST)).collect()]
    return vectors.nearest(by_ids(exact, "chunk_id", ids), query, k)
