"""URL rules as one bit-parallel wildcard automaton.

Every glob becomes a run of automaton states; `*` matches any bytes but "/", `**` any bytes. The states
of all globs lie side by side in 64-bit words, and one Shift-And step per byte of the URL moves all of
them at once (numpy does the step for a whole batch of URLs). The pattern of states after the last byte
says which globs match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # a host and all its subdomains
    path: str  # prefix of the path

    @property
    def text(self) -> str:
        return self.host + self.path

    def glob(self) -> str:
        """Over canonical URLs "." + host + path: the dot makes `com` fit a.com but not acom."""
        return f"*.{self.host}{self.path}**"


class WildcardAutomaton:
    """Shift-And with self-looping states: D' = ((D << 1 | first) & match[c]) | (D & loop[c]).

    A `*` turns the state before it into one that loops on the bytes it may skip; a leading `*` loops on
    the start state of its glob. Masks take 256 rows of ceil(states / 64) words.
    """

    def __init__(self, globs: list[str]):
        self.start, self.final, width = [], [], 0
        match, loop = [], []  # (state, bytes)
        not_slash = [c for c in range(256) if c != 0x2F]
        for glob in globs:
            raw, i = glob.encode(), 0
            self.start.append(width)
            while i < len(raw):
                if raw[i] == 0x2A:
                    wide = raw[i : i + 2] == b"**"
                    loop.append((width, range(256) if wide else not_slash))
                    i += 1 + wide
                else:
                    width += 1
                    match.append((width, [raw[i]]))
                    i += 1
            self.final.append(width)
            width += 1
        self.words = (width + 63) // 64
        self.match, self.loop = np.zeros((256, self.words), U), np.zeros((256, self.words), U)
        for masks, entries in ((self.match, match), (self.loop, loop)):
            for state, chars in entries:
                masks[list(chars), state // 64] |= U(1 << (state % 64))
        self.first = np.zeros(self.words, U)
        for s in self.start:
            self.first[s // 64] |= U(1 << (s % 64))

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """A boolean row per URL, a column per glob."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.first, (n, 1))
        flat = np.frombuffer(b"".join(urls), np.uint8)
        starts = np.cumsum(lengths) - lengths
        by_length, state_sorted = lengths[order], state
        for t in range(int(by_length[0]) if n else 0):
            live = int(np.searchsorted(-by_length, -t, "left"))  # URLs longer than t come first
            c = flat[starts[order[:live]] + t]
            d = state_sorted[:live]
            moved = d << U(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> U(63)
            state_sorted[:live] = (moved & self.match[c]) | (d & self.loop[c])
        out = np.empty((n, len(self.final)), bool)
        hit = np.stack([(state_sorted[:, f // 64] >> U(f % 64)) & U(1) for f in self.final], 1) if self.final else np.zeros((n, 0))
        out[order] = hit.astype(bool)
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first "://" up to "/", "?", "#" or the end; A-Z lower-cased) and path (then up to "?" or "#")."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    host = rest[:end]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host) if not host.isascii() else host.lower(), tail[:stop]


def judge_urls(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (text of the longest rule that fits, else null), verdict.

    One pass, no shuffle. A null URL or one without "://" has empty host and path and so fits no rule;
    of rules of one length the first listed wins; `default` holds where no rule fits. Rows that repeat
    are judged each; further columns are ignored.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    automaton = WildcardAutomaton([r.glob() for r in ranked])

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hit = automaton.matches([("." + h + p).encode() for h, p in parts])
            best = np.where(hit.any(1), hit.argmax(1), -1) if len(ranked) else np.full(len(parts), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([ranked[i].text if i >= 0 else None for i in best], pa.string()),
                    pa.array([ranked[i].verdict if i >= 0 else default for i in best], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, url_col).mapInArrow(judge, f"{id_col} {kind}, host string, path string, rule string, verdict string")


#: The production rules.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]

SQL = """
WITH cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""
