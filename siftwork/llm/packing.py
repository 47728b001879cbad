"""Packing of token ids into sequences by shortest-pack-first over the length histogram.

1. One pass codes each text, cuts it at the sequence length and numbers the pieces of each length within
   its task; the piece table (no ids) is saved once.
2. The histogram has at most `capacity` rows, so it goes to the driver, which packs counts.
3. Every piece gets a global rank within its length: ranks of earlier tasks (a running sum over small
   per-task counts) plus its rank in the task. The rank picks pack type, copy and offset. No task sees
   all pieces of a length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved
from .histogram_packing import shortest_pack_first
from .tokens import CACHE_RUNS, Vocabulary


LINES = 1 << 15  # runs that are cut into words together


class Coder:
    """Ids, as little-endian uint32 bytes, through the tokenizers library; runs and words are cached.

    Arrow splits the texts of a batch and finds their distinct runs; Python sees each of these once, and those that are
    in no cache are lowered and cut into words together, one a line.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.v = Vocabulary(path)
        self.model = Tokenizer.from_file(path).model
        self.lines = regex.compile(self.v.pattern.pattern + r"|\n")
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.v.ids.values()) + 1)]
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_RUNS:
                self.words.clear()
            ids = self.words[word] = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(self.v.spelled(word))])
        return ids

    def run(self, run: bytes) -> bytes:
        return b"".join([self.v.special[p].to_bytes(4, "little") if special else self.word(p) for p, special in self.v.pieces(run.decode())])

    def plain(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs without special tokens. Neither NFC nor the pattern joins characters across a line's end, and of
        all characters only the capital sigma is lowered by what stands around it."""
        get, word, found, ids = self.words.get, self.word, [], []
        for at in range(0, len(runs), LINES):
            lines = unicodedata.normalize("NFC", b"".join([r + b"\n" for r in runs[at : at + LINES]]).decode())
            for w in self.lines.findall(lines.replace("Σ", "σ").lower()):
                if w == "\n":
                    found.append(b"".join(ids))
                    ids = []
                else:
                    ids.append(known if (known := get(w)) is not None else word(w))
        return found

    def distinct(self, runs: list[bytes]) -> list[bytes]:
        ids = list(map(self.runs.get, runs))
        new = [i for i, known in enumerate(ids) if known is None]
        plain = [i for i in new if b"<" not in runs[i]]
        for i, found in zip(plain, self.plain([runs[i] for i in plain]), strict=True):
            ids[i] = found
        for i in new:
            if ids[i] is None:
                ids[i] = self.run(runs[i])
            if len(runs[i]) <= 64:
                if len(self.runs) >= CACHE_RUNS:
                    self.runs.clear()
                self.runs[runs[i]] = ids[i]
        return ids

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; a null is an empty text."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        runs = split.values.dictionary_encode()
        distinct = runs.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.distinct(distinct), pa.large_binary()).take(runs.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy() + ids.offset].tolist()
        for start, end in pairwise(ends):
            yield data[start:end].to_pybytes()


_coders: dict[str, Coder] = {}
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows id, start, length, ids_crc32, doc_tokens, part, nth (number among the part's pieces of that length)."""
    kind = df.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        if vocabulary not in _coders:
            _coders[vocabulary] = Coder(vocabulary)
        coder, part, seen = _coders[vocabulary], TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, of = [], []
            for i, ids in enumerate(coder.texts(batch.column(1))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[start * 4 : (start + capacity) * 4]
                    n = len(piece) // 4
                    seen[n] = nth = seen.get(n, -1) + 1
                    of.append(i)
                    rows.append((start, n, zlib.crc32(piece), total, nth))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, pa.int64()) for c in columns], pa.array([part] * len(of), pa.int64())],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "nth", "part"],
            )

    return df.select(id_col, text_col).mapInArrow(cut, f"{id_col} {kind}, {PIECE}, nth long, part long")


def pack(df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every text is coded, `end_id` is appended, and the ids are cut every `capacity`. A null or empty text
    is the single id `end_id`. Rows that repeat are packed each; an empty table gives no pieces; further
    columns are ignored. The pack table depends on the histogram alone, which has `capacity` rows at most.
    """
    table = saved(pieces(df, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    spark = df.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, bases, offsets, first, base = [], [], [], {}, 0
    for count, lengths in shortest_pack_first(histogram, capacity):
        offset = 0
        for n in lengths:
            rank = first.get(n, 0)
            first[n] = rank + count
            keys.append((n << 48) + rank)
            bases.append(base - rank)
            offsets.append(offset)
            offset += n
        base += count
    order = np.argsort(np.array(keys, np.int64))
    slots = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, bases, offsets)))

    of_part = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = of_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = table.join(start, ["length", "part"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        key, base_of, offset_of = slots.value
        for batch in batches:
            n, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, (n << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base_of[at] + rank), pa.array(offset_of[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"{id_col} {kind}, {PIECE}, sequence_id long, offset long")
