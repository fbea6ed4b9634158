"""URL filter: all glob rules as one bit-parallel automaton over each canonical URL.

The rules' globs are laid out one after the other in 64-bit words. Bit i stands for "the glob's
first literals up to i have been read". A step shifts all words by one with carry (Shift-And), adds
the first bits, keeps the bits whose literal fits the character read, and keeps bits that are
followed by `*` as they were. Every URL of a batch takes the same step at once.

Rules are `host/path-prefix`; each becomes two globs, `host/path*` and `*.host/path*`, over the
canonical URL (lower-case host, then the path, without query and fragment). The leading `*` reads no `/`, so
a rule's host fits the URL's host only, never text in its path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    def globs(self) -> list[str]:
        return [f"{self.text}*", f"*.{self.text}*"]


#: The rules of the registered query; fixed values.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


class ShiftAnd:
    """Globs (`*` any run, at the start a run without `/`, `?` any byte, all else itself) over bytes, anchored at both ends."""

    def __init__(self, globs: list[str]):
        literals: list[list[int]] = []
        self.leading: list[bool] = []
        loops: list[list[bool]] = []
        for g in globs:
            raw, lit, loop, lead = g.encode(), [], [], False
            for c in raw:
                if c == ord("*"):
                    if lit:
                        loop[-1] = True
                    else:
                        lead = True
                else:
                    lit.append(-1 if c == ord("?") else c)
                    loop.append(False)
            literals.append(lit)
            loops.append(loop)
            self.leading.append(lead)
        n = sum(map(len, literals))
        self.words = max(1, -(-n // 64))
        self.table = np.zeros((256, self.words), np.uint64)
        self.start, self.always, self.loop = (np.zeros(self.words, np.uint64) for _ in range(3))
        self.last: list[tuple[int, np.uint64] | bool] = []
        bit = 0
        for lit, loop, lead in zip(literals, loops, self.leading, strict=True):
            first = bit
            for c, stay in zip(lit, loop, strict=True):
                w, v = divmod(bit, 64)
                one = np.uint64(1 << v)
                for b in range(256) if c < 0 else (c,):
                    self.table[b, w] |= one
                if stay:
                    self.loop[w] |= one
                bit += 1
            if lit:
                self.start[first // 64] |= np.uint64(1 << first % 64)
                if lead:
                    self.always[first // 64] |= np.uint64(1 << first % 64)
                self.last.append(((bit - 1) // 64, np.uint64(1 << (bit - 1) % 64)))
            else:
                self.last.append(lead)

    def matches(self, urls: list[bytes], cells: int = 1 << 22) -> np.ndarray:
        """A boolean row for each URL and column for each glob. Long URLs go in small groups."""
        out = np.zeros((len(urls), len(self.last)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * (len(urls[order[j]]) + 1) <= cells:
                j += 1
            out[order[i:j]] = self._run([urls[k] for k in order[i:j]])
            i = j
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls])
        text = np.zeros((len(urls), int(lengths.max(initial=0))), np.uint8)
        for row, u in zip(text, urls, strict=True):
            row[: len(u)] = np.frombuffer(u, np.uint8)
        # a leading * may end no later than at the first /
        ends = np.where((text == ord("/")).any(axis=1), (text == ord("/")).argmax(axis=1), lengths) if text.shape[1] else lengths
        state = np.zeros((len(urls), self.words), np.uint64)
        for k in range(text.shape[1]):
            shifted = state << np.uint64(1)
            shifted[:, 1:] |= state[:, :-1] >> np.uint64(63)
            shifted = (shifted & ~self.start) | (self.start if k == 0 else np.where((k <= ends)[:, None], self.always, np.uint64(0)))
            new = (shifted & self.table[text[:, k]]) | (state & self.loop)
            state = np.where((k < lengths)[:, None], new, state)
        return np.column_stack([(lengths == 0) | f if isinstance(f, bool) else (state[:, f[0]] & f[1]) != 0 for f in self.last])


def canonical(url: str = "url") -> tuple[F.Column, F.Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end."""
    c = F.col(f"`{url}`")
    at = F.locate("://", c)
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    The longest fitting rule wins (by text length, then the earlier rule); without one the rule is
    null and the verdict is `default`. A null URL, or one without ://, has empty host and path and
    fits nothing. An empty path does not start with a rule's path. Repeated rows are
    judged one by one; the work is a map without exchange, so no key can be hot.
    """
    host, path = canonical(url_col)
    automaton = ShiftAnd([g for r in rules for g in r.globs()])
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))

    @F.pandas_udf("int")
    def winner(urls: pd.Series) -> pd.Series:
        hit = automaton.matches([u.encode() for u in urls]).reshape(len(urls), -1, 2).any(axis=2) if len(urls) else np.zeros((0, len(rules)), bool)
        best = np.full(len(urls), -1, np.int32)
        for i in reversed(order):
            best[hit[:, i]] = i
        return pd.Series(best)

    found = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    found = found.withColumn("which", winner(F.concat("host", "path")))
    texts, verdicts = (F.array(*[F.lit(getattr(r, k)) for r in rules]) for k in ("text", "verdict"))
    fits = F.col("which") >= 0
    return found.select("page_id", "host", "path", F.when(fits, F.get(texts, F.col("which"))).alias("rule"), F.when(fits, F.get(verdicts, F.col("which"))).otherwise(default).alias("verdict"))


def op2_url_rules(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
  SELECT a.page_id, a.host, a.path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts a JOIN rules ON (a.host = h OR ends_with(a.host, '.' || h)) AND starts_with(a.path, p) GROUP BY ALL
)
SELECT a.page_id, a.host, a.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts a LEFT JOIN best b ON a.page_id IS NOT DISTINCT FROM b.page_id AND a.host = b.host AND a.path = b.path
"""
