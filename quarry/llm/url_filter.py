"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into multiword Shift-And masks: one bit for the start of a pattern and one
for each literal; a `*` (any run without `/`) or `**` (any run) keeps the bit before it alive. Each
byte of a canonical URL advances every pattern of every URL of a batch at once.

Null URLs, and URLs without `://`, have an empty host and path and match no rule. Empty tables give
empty results; repeated rows each get their verdict; extra columns pass through untouched, but for
columns named like the results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells (URLs x bytes) of the character matrix that is simulated at once.
CELLS = 1 << 22


@dataclass(frozen=True)
class Rule:
    """`host/path-prefix` and its verdict; a rule fits its host and all subdomains. Host and path may hold `*` and `**`."""

    name: str
    verdict: str

    def globs(self) -> tuple[str, str]:
        return self.name, f"*.{self.name}"


#: The production rules, fixed by the contract of the query.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


class ShiftAnd:
    """Prefix matcher for many globs; `match` gives for each URL the index of its longest rule, or -1."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.n = len(rules)
        bit, start, final = 0, [], [[] for _ in rules]
        advance: list[tuple[int, int]] = []
        stay: list[tuple[int, bool]] = []
        for k, rule in enumerate(rules):
            for glob in rule.globs():
                start.append(bit)
                at, data = 0, glob.encode()
                while at < len(data):
                    if data[at] == 0x2A:
                        deep = data[at + 1 : at + 2] == b"*"
                        stay.append((bit, deep))
                        at += 1 + deep
                    else:
                        bit += 1
                        advance.append((bit, data[at]))
                        at += 1
                final[k].append(bit)
                bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.final = self._mask(start), [self._mask(x) for x in final]
        self.advance, self.stay = np.zeros((257, self.words), np.uint64), np.zeros((257, self.words), np.uint64)
        for i, c in advance:
            self.advance[c] |= self._mask([i])
        for i, deep in stay:
            for c in range(256):
                if deep or c != 0x2F:
                    self.stay[c] |= self._mask([i])
        #: Rules from the longest to the shortest; among equals the first.
        self.order = sorted(range(self.n), key=lambda k: (-len(rules[k].name), k))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def _accepted(self, urls: list[bytes]) -> np.ndarray:
        longest = max(map(len, urls), default=0)
        chars = np.full((longest, len(urls)), 256, np.int16)
        for k, u in enumerate(urls):
            chars[: len(u), k] = np.frombuffer(u, np.uint8)
        state = np.tile(self.start, (len(urls), 1))
        seen = np.zeros_like(state)
        for c in chars:
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.advance[c]) | (state & self.stay[c])
            seen |= state
        return np.stack([(seen & f).any(axis=1) for f in self.final], axis=1)

    def match(self, urls: list[bytes]) -> np.ndarray:
        out = np.full(len(urls), -1, np.int64)
        if not self.n:
            return out
        by_length = sorted(range(len(urls)), key=lambda k: len(urls[k]))
        while by_length:  # from the longest URL down, as many as fit
            most = max(1, CELLS // max(1, len(urls[by_length[-1]])))
            part, by_length = by_length[-most:], by_length[:-most]
            accepted = self._accepted([urls[k] for k in part])[:, self.order]
            out[part] = np.where(accepted.any(axis=1), np.array(self.order)[accepted.argmax(axis=1)], -1)
        return out


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict (the rule's, else default)."""

    @F.pandas_udf("int")
    def longest(canonical: pd.Series) -> pd.Series:
        return pd.Series(ShiftAnd(rules).match([x.encode() for x in canonical])).astype("int32")

    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    found = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("__rule", longest(F.concat("host", "path")))
    return found.withColumns({
        "rule": F.when(F.col("__rule") >= 0, F.get(names, F.col("__rule"))),
        "verdict": F.when(F.col("__rule") >= 0, F.get(verdicts, F.col("__rule"))).otherwise(F.lit(default)),
    }).drop("__rule")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS row_no,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), j AS (
  SELECT p.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY row_no ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""
