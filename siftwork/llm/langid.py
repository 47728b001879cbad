"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes (A-Z folded) up to `order` bytes deep: for every context of
0..order bytes, how often each byte followed it. A byte costs -log2(c / (n + d)) in the longest context
that has seen it (c: its count, n: all counts, d: distinct bytes there) and -log2(d / (n + d)) for each
longer seen context it escapes from; below the empty context it costs 8 bits. Counts are frozen after
training and seen bytes are not excluded, so the code length of a text is a sum over its bytes of values
of the last order + 1 bytes alone, which a lookup gives for whole batches of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import _LOWER, blocks

ORDER = 3
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
HAS_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
SLOT_BITS = 20


def grams(b: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place from n - 1 on, as one number."""
    out = np.zeros(max(0, len(b) - n + 1), np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | b[i : len(b) - n + 1 + i]
    return out


def count_contexts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order 0..ORDER the distinct (context, byte) grams and their counts."""
    folded = [_LOWER.astype(np.uint8)[np.frombuffer(t, np.uint8)] for t in texts if t]
    return [np.unique(np.concatenate([grams(b, k + 1) for b in folded] or [np.zeros(0, np.uint32)]), return_counts=True) for k in range(ORDER + 1)]


@dataclass
class Level:
    keys: np.ndarray  # sorted grams of this order that any language has seen
    cost: np.ndarray  # bits, a column per language, escapes included
    contexts: np.ndarray  # sorted contexts that any language has seen
    escape: np.ndarray  # bits, a column per language; 0 where the language has not seen the context


class Model:
    """Frozen context trees of all languages, as lookup tables from gram to bits."""

    def __init__(self, languages: list[str], trees: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.languages, self.levels = languages, []
        width = len(languages)
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([t[k][0] for t in trees] or [np.zeros(0, np.uint32)]))
            contexts = np.unique(keys >> np.uint32(8))
            cost, escape = np.zeros((len(keys), width), np.float32), np.zeros((len(contexts), width), np.float32)
            seen = np.zeros((len(keys), width), bool)
            for j, tree in enumerate(trees):
                g, c = tree[k]
                if not len(g):
                    continue
                of = np.searchsorted(contexts, g >> np.uint32(8))
                n, d = np.bincount(of, c, len(contexts)), np.bincount(of, minlength=len(contexts))
                at = np.searchsorted(keys, g)
                seen[at, j] = True
                cost[at, j] = np.log2((n + d)[of]) - np.log2(c)
                has = d > 0
                escape[has, j] = np.log2((n + d)[has]) - np.log2(d[has])
            level = Level(keys, cost, contexts, escape)
            self.levels.append(level)
            fallback = self._below(keys, k)
            cost[~seen] = fallback[~seen]
        top = self.levels[-1]
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[self._slot(top.keys)] = np.arange(len(top.keys), dtype=np.int32)

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)

    def _below(self, g: np.ndarray, k: int) -> np.ndarray:
        """Bits of grams of order k that are not coded at order k: the escape plus the next shorter order."""
        level = self.levels[k]
        out = np.zeros((len(g), len(self.languages)), np.float32)
        if len(level.contexts):
            at = np.minimum(np.searchsorted(level.contexts, g >> np.uint32(8)), len(level.contexts) - 1)
            hit = level.contexts[at] == g >> np.uint32(8)
            out[hit] = level.escape[at[hit]]
        return out + (8 if k == 0 else self.bits(g & np.uint32((1 << (8 * k)) - 1), k - 1))

    def bits(self, g: np.ndarray, k: int) -> np.ndarray:
        """Bits of each gram of order k under each language."""
        level = self.levels[k]
        if not len(level.keys):
            return self._below(g, k)
        if k == ORDER:
            at = self.slots[self._slot(g)]
            hit = (at >= 0) & (level.keys[at] == g)
            miss = np.flatnonzero(~hit)
            at[miss] = np.minimum(np.searchsorted(level.keys, g[miss]), len(level.keys) - 1)
        else:
            at = np.minimum(np.searchsorted(level.keys, g), len(level.keys) - 1)
            miss = np.arange(len(g))
        out = level.cost[at]
        wrong = miss[level.keys[at[miss]] != g[miss]]
        if len(wrong):
            distinct, back = np.unique(g[wrong], return_inverse=True)
            out[wrong] = self._below(distinct, k)[back]
        return out

    def lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text of a block, a column per language."""
        total = np.zeros((len(off) - 1, len(self.languages)))
        b, size = _LOWER.astype(np.uint8)[buf], np.diff(off)
        for k in range(ORDER):  # the first bytes of a text have shorter contexts
            some = np.flatnonzero(size > k)
            g = np.zeros(len(some), np.uint32)
            for i in range(k + 1):
                g = (g << np.uint32(8)) | b[off[some] + i]
            total[some] += self.bits(g, k)
        if len(b) > ORDER:
            rows = self.bits(grams(b, ORDER + 1), ORDER)
            sums = np.zeros((len(rows) + 1, len(self.languages)))
            np.cumsum(rows, axis=0, dtype=np.float64, out=sums[1:])
            some = np.flatnonzero(size > ORDER)
            total[some] += sums[off[some + 1] - ORDER] - sums[off[some]]
        return total


PARTS = 16


def train(docs: DataFrame, docs_per_language: int = 400, bytes_per_language: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit one context tree per label on a bounded sample: for each language the `docs_per_language`
    different labelled rows with the smallest hash of their id and text, then as many of these, in that order, as hold
    `bytes_per_language` bytes (a first longer text is cut there). The rows with the smallest hash are
    found in PARTS parts of each language first, so that a hot language is no single task's. Null and empty
    texts and null labels teach nothing; rows that repeat an id and a text teach once, rows of one id or a null id
    with different texts teach each; an empty table, or one without labels, gives a model without languages, for
    which every text is `und`.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    labelled = labelled.select("text", "lang", F.xxhash64("id", "text").alias("row"))
    rows = labelled.groupBy("lang", "row").agg(F.lit(1)).select("lang", "row", F.pmod(F.xxhash64(F.lit("part"), "row"), F.lit(PARTS)).alias("part"))
    for groups in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*groups).orderBy("row"))).where(F.col("k") <= docs_per_language)
    rows = rows.select("lang", "row", "k")  # at most docs_per_language of each label
    chosen = labelled.join(F.broadcast(rows), ["lang", "row"]).dropDuplicates(["lang", "row"])
    size = F.octet_length("text").cast("long")
    before = F.sum(size).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < bytes_per_language).select("lang", "k", "text")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode()[:bytes_per_language] for t in rows.sort_values(["k"])["text"]]
        tree = count_contexts(texts)
        return pd.concat([pd.DataFrame({"lang": rows["lang"].iloc[0], "k": k, "g": g.astype("int64"), "c": c.astype("int64")}) for k, (g, c) in enumerate(tree)])

    # at most (ORDER + 1) * bytes_per_language rows of a language, and far fewer as grams repeat
    got = chosen.groupBy("lang").applyInPandas(fit, "lang string, k int, g long, c long").toPandas()
    languages = sorted(got["lang"].unique())
    trees = []
    for lang in languages:
        rows = got[got["lang"] == lang]
        tree = []
        for k in range(ORDER + 1):
            level = rows[rows["k"] == k].sort_values("g")
            tree.append((level["g"].to_numpy().astype(np.uint32), level["c"].to_numpy()))
        trees.append(tree)
    return Model(languages, trees)


def _predictions(m: Model, column: pa.Array) -> tuple[list[str], list[float], list[float | None]]:
    pred, score, per_byte = [], [], []
    for i, j, buf, off in blocks(column, 1 << 20):
        ascii_letter = np.add.reduceat(np.append(LETTERS[buf], False).astype(np.int64), off[:-1]) * (np.diff(off) > 0) > 0
        bits = m.lengths(buf, off) if m.languages else None
        for r in range(j - i):
            text = None if ascii_letter[r] else column[i + r].as_py()
            if bits is None or not (ascii_letter[r] or text and HAS_LETTER.search(text)):
                pred.append(UNKNOWN)
                score.append(0.0)
                per_byte.append(None)
                continue
            n, own = int(off[r + 1] - off[r]), bits[r]
            best = int(own.argmin())
            pred.append(m.languages[best])
            score.append(float(1 / np.exp2(-(own - own[best]) * min(1, 64 / n)).sum()))
            per_byte.append(float(own[best] / n))
    return pred, score, per_byte


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, bits_per_byte (null without a prediction).

    The prediction is the language with the shortest code (ties: the first by name); score is its weight
    among all languages when code lengths are taken per 64 bytes of text at most, so it stays below 1 for
    close calls. `und` with score 0 where the text is null, empty or without a letter, or nothing was
    learned. Whole texts are scored; rows that repeat are judged each; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            pred, score, per_byte = _predictions(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())], names=[id_col, "lang_pred", "score", "bits_per_byte"])

    return docs.select(id_col, text_col).mapInArrow(judge, f"{id_col} {kind}, lang_pred string, score double, bits_per_byte double")


def accept(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least `least_score`. Null and empty texts and texts
    without letters go; rows that repeat, with null ids too, are judged each; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            pred, score, _ = _predictions(shared.value, batch.column(at))
            yield batch.filter(pa.array([p != UNKNOWN and s >= least_score for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
