"""Words, symbols and ids of the word-end byte-pair vocabulary, and counts by merging.

`Vocabulary` reads a tokenizers .json file (NFC, lower case, a splitting pattern, byte symbols, merges
with word ends). White space is dropped by the pattern, so each run of other characters is coded alone
and a cache of runs is exact.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_RUNS = 1_500_000


def byte_symbols() -> dict[int, str]:
    """The usual printable stand-in of each byte: printable Latin-1 keeps its place, the rest follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model = conf["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.table = dict(self.symbols)

    def pieces(self, run: str) -> Iterator[tuple[str, bool]]:
        """(piece, is it special) of a run without white space, in the library's order of steps."""
        parts = self.special_re.split(run) if self.special_re and "<" in run else [run]
        for i, part in enumerate(parts):
            if i % 2:
                yield part, True
            elif part:
                if not part.isascii():
                    part = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                else:
                    part = part.lower()
                for word in self.pattern.findall(part):
                    yield word, False

    def spelled(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)


def merged_count(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """Symbols that remain when the lowest-ranked adjacent pair is merged again and again.

    A heap holds (rank, place) of live pairs; `left` and `right` link the symbols that remain. The
    count is the initial symbols minus the merges; no id is looked up.
    """
    n = len(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    merges = 0
    while heap:
        r, i = heapq.heappop(heap)
        if symbols[i] is None or (j := right[i]) >= n or rank.get((symbols[i], symbols[j])) != r:
            continue  # a pair that an earlier merge has changed
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := rank.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := left[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class Counter:
    """Token counts of runs of non-space bytes; caches are emptied when full, so memory is bounded."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.runs: dict[bytes, int] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= CACHE_RUNS:
                self.words.clear()
            symbols = list(self.v.spelled(word))
            symbols[-1] += self.v.end
            n = self.words[word] = merged_count(symbols, self.v.rank)
        return n

    def run(self, run: bytes) -> int:
        return sum(1 if special else self.word(piece) for piece, special in self.v.pieces(run.decode()))

    def text(self, text: bytes) -> int:
        runs, get, total = self.runs, self.runs.get, 0
        for run in text.split():
            n = get(run)
            if n is None:
                n = self.run(run)
                if len(run) <= 64:
                    if len(runs) >= CACHE_RUNS:
                        runs.clear()
                    runs[run] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One pass, no shuffle. A null or empty text has 0 bytes and 0 tokens; a null id passes through; rows
    that repeat are counted each; further columns are ignored. Each Python worker keeps one counter.
    """

    def count(batches):
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        c = _counters[vocabulary]
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.large_binary())]
            tokens = [c.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(count, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
