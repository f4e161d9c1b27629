"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text gets one leading space, spaces become U+2581, and its characters are the first symbols. An agenda
(a heap) holds every adjacent pair of symbols whose union is in the vocabulary, best score first and the
leftmost of equal scores; the best pair is merged and its new neighbours enter, until the agenda is empty.
What is no piece falls back to its UTF-8 bytes. If no piece of the vocabulary holds a U+2581 after another
character (looked up when it is loaded), no merge crosses the place before a U+2581, so a text is encoded
segment by segment, and short segments are remembered, up to a bound. Short segments that are new in a
batch have their agendas worked off side by side in numpy: each round takes the best pair of every one.
Each Arrow batch is checked against the sentencepiece library: the ids of the segments that were not seen
before, and the decoding of every whole text. A difference ends the job.

A null text is an empty one, which has the end id alone. Texts are encoded whole, of any length. Repeated
rows and null ids are kept as they are, an empty table gives an empty result, and columns but doc_id and
text are left out. Strings of control symbols in a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import spread, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments that a worker remembers, and the longest of them; what is not remembered is encoded again.
REMEMBERED, LONGEST = 600_000, 48
KINDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NEVER = np.iinfo(np.int32).max


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(k, m.id_to_piece(k)) for k in range(m.get_piece_size())]
        self.bytes = {int(p[3:5], 16): k for k, p in kinds if m.is_byte(k)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces to fall back to")
        self.ids = {p: k for k, p in kinds if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k))}
        self.scores = {p: m.get_score(k) for p, k in self.ids.items()}
        #: Bytes of each id in a decoded text; control symbols have none.
        self.said = [p.replace(SPACE, " ").encode() if p in self.ids else b"" for _, p in kinds]
        for b, k in self.bytes.items():
            self.said[k] = bytes([b])
        self.end = m.eos_id()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self._pairs()

    def _pairs(self) -> None:
        """Tables of symbols (pieces, and characters of pieces that are none) and of the pairs that make a piece."""
        symbols = dict(self.ids)
        for c in sorted(set("".join(self.ids)) - self.ids.keys()):
            symbols[c] = len(symbols) + len(self.said)
        self.symbol = np.full(0x110000, -1, np.int32)  # by code point
        for p, k in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)] = k
        order = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.most = max(symbols.values()) + 1
        made = sorted((symbols[p[:k]] * self.most + symbols[p[k:]], order[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair, self.rank, self.union = (np.array(x, t) for x, t in zip(zip(*made, strict=True), (np.int64, np.int32, np.int32), strict=True))
        self.ints = list(range(len(self.said)))

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of symbols its place in the order of scores, _NEVER if its union is no piece, and the union."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.most + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.rank[at], _NEVER), self.union[at]

    def merged_together(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of many segments, none of them empty: the agenda of each gives its best pair, the leftmost of equals, in each round."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym = self.symbol[points]
        sym = np.where(sym < 0, -1 - points.astype(np.int64), sym).astype(np.int64)  # an unknown character keeps its code point
        seg = np.repeat(np.arange(len(segments)), list(map(len, segments)))
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at k."""
            last = k + 1 >= len(sym)
            after = np.where(last, k, k + 1)
            rank, union = self.ranked(sym[k], sym[after])
            return np.where(last | (seg[after] != seg[k]), _NEVER, rank), union

        rank, union = ranks(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            lens = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if not (least < _NEVER).all():  # agendas that are empty
                out = np.repeat(least == _NEVER, lens)
                done.append((sym[out], seg[out]))
                sym, seg, rank, union = sym[~out], seg[~out], rank[~out], union[~out]
                lens, least = lens[least < _NEVER], least[least < _NEVER]
            if not len(sym):
                break
            best = np.flatnonzero(rank == np.repeat(least, lens))
            best = best[np.concatenate(([True], seg[best[1:]] != seg[best[:-1]]))]
            sym[best] = union[best]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            sym, seg, rank, union = sym[keep], seg[keep], rank[keep], union[keep]
            best -= np.arange(len(best))  # one symbol less before each
            stale = np.concatenate((best, best[best > 0] - 1))
            rank[stale], union[stale] = ranks(stale)
        sym, seg = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(seg, kind="stable")
        ends = np.cumsum(np.bincount(seg, minlength=len(segments))).tolist()
        plain = bool(sym.min() >= 0) and bool(sym.max() < len(self.said))
        shared = self.ints.__getitem__  # the same objects in all tuples
        return [tuple(map(shared, x)) if plain else self.numbered(x) for x in self._sliced(sym[order].tolist(), ends)]

    @staticmethod
    def _sliced(values: list[int], ends: list[int]) -> Iterator[list[int]]:
        at = 0
        for end in ends:
            yield values[at:end]
            at = end

    def numbered(self, symbols: list[int]) -> tuple[int, ...]:
        """Ids of symbols: those of their pieces, or of the bytes of what is no piece."""
        if min(symbols) >= 0 and max(symbols) < len(self.said):
            return tuple(map(self.ints.__getitem__, symbols))
        out: list[int] = []
        for k in symbols:
            if 0 <= k < len(self.said):
                out.append(k)
            else:
                c = chr(-1 - k) if k < 0 else self.spelled(k)
                out.extend(self.bytes[b] for b in c.encode())
        return tuple(out)

    def spelled(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.symbol == symbol)[0]))

    def merged(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment of any length, by one agenda in a heap."""
        ids, scores = self.ids, self.scores
        piece: list[str | None] = list(segment)
        n = len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-scores[p], k, p) for k, p in enumerate(map("".join, pairwise(segment))) if p in scores]
        heapq.heapify(agenda)
        while agenda:
            _, k, both = heapq.heappop(agenda)
            left, right = piece[k], after[k]
            if left is None or right >= n or left + piece[right] != both:
                continue  # one of the two has been merged meanwhile
            piece[k], piece[right] = both, None
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (score := scores.get(new := both + piece[right])) is not None:
                    heapq.heappush(agenda, (-score, k, new))
            if (left := before[k]) >= 0 and (score := scores.get(new := piece[left] + both)) is not None:
                heapq.heappush(agenda, (-score, left, new))
        out: list[int] = []
        for p in piece:
            if p is not None:
                k = ids.get(p)
                out.extend([k] if k is not None else [self.bytes[b] for b in p.encode()])
        return tuple(out)

    def cut(self, text: str) -> list[str]:
        """The segments of a text that isn't empty, without the U+2581 that each begins with."""
        if self.segments is None:
            return [text.replace(" ", SPACE)]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in self.segments.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last; segments that are new here are checked against the library."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, here = self.known, set().union(*cuts)
        new = [s for s in here if s not in known]
        for s in [s for s in new if s in self.older]:
            known[s] = self.older[s]
        new = [s for s in new if s not in known]
        short, long = [s for s in new if len(s) <= LONGEST], [s for s in new if len(s) > LONGEST]
        own = self.merged_together([SPACE + s for s in short]) if short else []
        passing = {s: self.merged(SPACE + s) for s in long}
        # A segment of one U+2581 is an empty text to the library, which has no ids for that.
        theirs = self.library.encode(new, num_threads=1) if new else []
        known.update(zip(short, own, strict=True))
        for s, ids in zip(new, theirs, strict=True):
            if s and list(known.get(s) or passing[s]) != ids:
                raise AssertionError(f"ids differ from the library's: {s[:100]!r}")
        ids_of = known if not passing else {**{s: known[s] for s in here if s in known}, **passing}
        out = []
        for segments in cuts:
            ids: list[int] = []
            for x in map(ids_of.__getitem__, segments):
                ids += x
            ids.append(self.end)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the leading space; bytes that are no UTF-8 become U+FFFD."""
        said = b"".join(map(self.said.__getitem__, ids))
        return said.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One encoder a worker process; its segments are remembered over tasks."""
    return Pieces(path)


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids, decoded: every whole text's ids with the end id, and what they decode to."""
    return _run(docs, path or model_path(), "doc_id long, text string, ids array<int>, decoded string", _texts)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same ids and texts, without moving them out of the task."""
    return _run(docs, path or model_path(), KINDS, _digests)


def _texts(doc_id: pa.Array, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    return [doc_id, pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]


def _digests(doc_id: pa.Array, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    joined = (hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids)
    return [doc_id, pa.array(map(len, ids), pa.int64()), pa.array(joined, pa.string()), pa.array((hashlib.sha256(x.encode()).hexdigest() for x in decoded), pa.string())]


def _run(docs: DataFrame, path: str, kinds: str, columns) -> DataFrame:
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # about a million characters at once, or one longer text
                part = [batch.column("text")[at].as_py() or ""]
                size = len(part[0])
                while at + len(part) < batch.num_rows and size < 1 << 20:
                    part.append(batch.column("text")[at + len(part)].as_py() or "")
                    size += len(part[-1])
                ids = own.encode(part)
                decoded = list(map(own.decode, ids))
                for x, y in zip(ids, decoded, strict=True):
                    if own.library.decode(x) != y:
                        raise AssertionError(f"the decoded text differs from the library's: {y[:100]!r}")
                yield pa.RecordBatch.from_arrays(columns(batch.column("doc_id").slice(at, len(part)), part, ids, decoded), names=names)
                at += len(part)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, kinds)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
