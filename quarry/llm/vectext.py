"""Numpy text kernels: runs of bytes, their 64-bit hashes, and bit votes. One text at a time, in bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of a text that are worked on at once; a chunk ends at white space where there is some.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LANES = np.uint64(0x0101010101010101)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        x = np.full(CHUNK + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(data: bytes) -> Iterator[bytes]:
    """data in pieces of at most CHUNK bytes, cut after white space where the piece has any."""
    at = 0
    while len(data) - at > CHUNK:
        end = max(data.rfind(c, at, at + CHUNK) for c in (b" ", b"\n", b"\t")) + 1
        end = end if end > at else at + CHUNK
        yield data[at:end]
        at = end
    if at < len(data):
        yield data[at:]


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in kind, runs of 0 left out."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(kind)]))
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def run_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each b[start:end], from prefix sums of a polynomial modulo 2**64."""
    power, inverse = _powers()
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def bit_votes(h: np.ndarray) -> np.ndarray:
    """For each bit from 0 to 63, how many of the uint64 values in h have it set; h may have rows, each counted alone."""
    h2 = np.atleast_2d(h)
    out = np.zeros((len(h2), 64), np.int64)
    for at in range(0, h2.shape[1], 255 << 8):
        part = h2[:, at : at + (255 << 8)]
        part = np.pad(part, ((0, 0), (0, -part.shape[1] % 255))).reshape(len(h2), -1, 255)
        for j in range(8):  # eight counters of a byte in each word; 255 values can't overflow them
            lanes = ((part >> np.uint64(j)) & _LANES).sum(axis=2, dtype=np.uint64)
            out[:, j::8] += lanes.view(np.uint8).reshape(len(h2), -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(*h.shape[:-1], 64)


def packed(bits: np.ndarray) -> int:
    """The number whose bit i is bits[i]."""
    return int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little")
