"""Alignment of the tokens of two tokenizers by the byte places where both end a token.

1. Units. A text is cut at single spaces between other characters. Both tokenizers cut there as well (A attaches
   a space to what follows, no piece of B has a space after another character), so units are coded and
   aligned alone, and a bounded table of units keeps what was found.
2. Bitsets. Over the bytes of many units, packed 64-bit words mark where tokens of A end and where tokens of B end.
   AND gives the shared cuts. Popcounts of the words before a cut and of its own word up to it rank it among the
   ends of A and of B, which are the token ranges of the groups between cuts.
3. Links. Ranges expand to all pairs of an A and a B token of a group.
4. Counts. How many texts hold an id pair linked is summed in every task, then by pair, and the highest count of
   each A id marks its best pairs. The table of pairs is dealt by hash into blocks of at most BLOCK_PAIRS; each is
   broadcast alone for a pass over the pairs that the first pass has saved for each text, and what the passes found
   is added by text.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import interim, saved
from .tokens import byte_symbols

CUT = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
MOST_UNITS, MOST_PAIRS = 300_000, 6_000_000  # in a worker's table, which is emptied when it has more
BLOCK_CHARS = 1 << 19  # of the texts that are looked at together
BLOCK_PAIRS = 1 << 21  # id pairs of one broadcast block, on average; never twice as many
HELD_PAIRS = 1 << 21  # counts that a task holds before it passes them on
WIDE = 1 << 12  # links of a group from which its ids are counted instead of its tokens
SHIFT = 32  # pair = A id << 32 | B id


class ByteTokens:
    """A byte-level vocabulary (.json): ids of units with a space before them, and the bytes of each id.

    Units of ASCII letters and the like go through the same merges in their faster form: ids are ranks."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are plain text
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        back = {c: b for b, c in byte_symbols().items()}
        special = {t["content"] for t in conf["added_tokens"]}
        vocab = {t: i for t, i in conf["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in conf["model"]["merges"]]
        merged = [vocab["".join(m)] for m in merges]
        ranked = merged == sorted(merged) and conf["pre_tokenizer"]["type"] == "ByteLevel" and conf["normalizer"] is None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level splitting
        self.ranks = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={}) if ranked else None

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of space + unit for each unit."""
        if self.ranks is None:
            return [e.ids for e in self.library.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        plain = self.ranks.encode_ordinary
        out = [plain(" " + u) if u.isascii() else None for u in units]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.library.encode_batch_fast([" " + units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class PieceTokens:
    """A piece vocabulary (.model): ids of units, to which it adds a space, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.library.encode(units, num_threads=1)


def packed(places: np.ndarray, n_words: int) -> np.ndarray:
    """A bitset of 64-bit words with these bits."""
    flags = np.zeros(n_words * 64, bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def ranks(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits lie at each place or before."""
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    word = places >> 6
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (places & 63)).astype(np.uint64)
    return before[word] + np.bitwise_count(bits[word] & upto)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where tokens of both end (place: the last byte), and how many tokens of A and of B have ended there."""
    n_words = n_bytes // 64 + 1
    a, b = packed(a_ends, n_words), packed(b_ends, n_words)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return cuts, ranks(a, cuts), ranks(b, cuts)


def _counted(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def links(a_ids: np.ndarray, b_ids: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups that end at these token numbers: group, id pair and how often it is linked there. The ids of wide groups
    are counted first, so that a long text without shared cuts does not expand to all pairs of its tokens."""
    a_from, b_from = np.append(0, a_to[:-1]), np.append(0, b_to[:-1])
    na, nb = a_to - a_from, b_to - b_from
    narrow = np.flatnonzero(na * nb < WIDE)
    many = (na * nb)[narrow]
    of, k = np.repeat(narrow, many), _counted(many)
    pair = (a_ids[a_from[of] + k // np.maximum(nb[of], 1)] << SHIFT) | b_ids[b_from[of] + k % np.maximum(nb[of], 1)]
    out = [(of, pair, np.ones(len(of), np.int64))]
    for g in np.flatnonzero(na * nb >= WIDE).tolist():
        a, a_n = np.unique(a_ids[a_from[g] : a_to[g]], return_counts=True)
        b, b_n = np.unique(b_ids[b_from[g] : b_to[g]], return_counts=True)
        pair = ((a << SHIFT)[:, None] | b).ravel()
        out.append((np.full(len(pair), g), pair, (a_n[:, None] * b_n).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Aligner:
    """Units and what is known of each: tokens of A and B, groups, links, its groups as text, its id pairs."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # each id with the sign that follows it: within a side, between sides, after a group
        self.signs = [[f"{i}{s}" for i in range(max(len(self.a.bytes), len(self.b.bytes)))] for s in ",|;"]
        self.width = len(self.signs[0])
        self.signs = [x for part in self.signs for x in part]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []  # with the last sign
        self.stats = [np.zeros((0, 5), np.int64)]  # tokens of A, of B, groups, links, 1 if the unit has tokens
        self.starts = [np.zeros(1, np.int64)]  # of a unit's pairs
        self.pairs, self.times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def units(self, text: str) -> list[str]:
        if not self.b.cuts_at_spaces:
            return [text]
        return text.split(" ") if not ODD_SPACE.search(text) else CUT.split(text)

    def learn(self, units: list[str]) -> None:
        """Code and align units that the table lacks."""
        raw = [b" " + u.encode() for u in units]
        a_ids, b_ids = self.a.encode(units), self.b.encode(units)
        a_bytes, b_bytes = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        ok = np.array([b"".join(map(a_bytes, x)) == r and b"".join(map(b_bytes, y)) == r for x, y, r in zip(a_ids, b_ids, raw, strict=True)], bool)
        none: list[int] = []
        a_ids, b_ids = ([x if good else none for x, good in zip(ids, ok.tolist(), strict=True)] for ids in (a_ids, b_ids))
        na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a_flat, b_flat = (np.array([i for x in ids for i in x], np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_len[a_flat]), np.cumsum(self.b_len[b_flat])
        cuts, a_to, b_to = shared_cuts(a_end - 1, b_end - 1, int(a_end[-1]) if len(a_end) else 0)
        of_group = np.searchsorted(np.cumsum(np.where(ok, [len(r) for r in raw], 0)), cuts, "right")
        group, pair, times = links(a_flat, b_flat, a_to, b_to)
        unit = of_group[group]
        if len(group) and (group[1:] < group[:-1]).any():
            order = np.argsort(unit, kind="stable")
            unit, pair, times = unit[order], pair[order], times[order]
        n = len(units)
        self.stats.append(np.stack([na, nb, np.bincount(of_group, minlength=n), np.bincount(unit, times, minlength=n).astype(np.int64), ok], axis=1).astype(np.int64))
        self.starts.append(self.starts[-1][-1:] + np.cumsum(np.bincount(unit, minlength=n)))
        self.pairs.append(pair)
        self.times.append(times)
        # ids in order, A before B in each group, with their signs
        b_from, a_in = np.append(0, b_to[:-1])[: len(b_to)], np.diff(np.append(0, a_to))
        row = np.empty(len(a_flat) + len(b_flat), np.int64)
        a_at = np.arange(len(a_flat)) + np.repeat(b_from, a_in)
        b_at = np.arange(len(b_flat)) + np.repeat(a_to, np.diff(np.append(0, b_to)))
        row[a_at], row[b_at] = a_flat, b_flat
        row[a_at[a_to - 1]] += self.width
        row[b_at[b_to - 1]] += 2 * self.width
        signed = list(map(self.signs.__getitem__, row.tolist()))
        end = np.cumsum(na + nb).tolist()
        self.groups += ["".join(signed[s:e]) for s, e in zip([0, *end[:-1]], end, strict=True)]
        for u in units:
            self.index[u] = len(self.index)

    def look_up(self, texts: list[str | None]):
        """Per text: stats (n x 5, the last whether it has tokens), groups as text; and of all texts together: text, id pair,
        how often it is linked, each pair of a text once, sorted."""
        if len(self.index) > MOST_UNITS or self.starts[-1][-1] > MOST_PAIRS:
            self.clear()
        split = [self.units(t) if t else [] for t in texts]
        index = self.index
        if new := list(dict.fromkeys([u for units in split for u in units if u not in index])):
            self.learn(new)
        self.stats, self.starts, self.pairs, self.times = ([np.concatenate(x)] for x in (self.stats, self.starts, self.pairs, self.times))
        at = np.array([index[u] for units in split for u in units], np.int64)
        size = np.array([len(units) for units in split], np.int64)
        doc = np.repeat(np.arange(len(texts)), size)
        stats = np.zeros((len(texts), 5), np.int64)
        np.add.at(stats, doc, self.stats[0][at])
        fits = (stats[:, 4] == size) & (size > 0)
        stats[~fits] = 0
        stats[:, 4] = fits
        ends = np.cumsum(size).tolist()
        groups = ["".join(map(self.groups.__getitem__, at[e - n : e].tolist()))[:-1] if good else "" for n, e, good in zip(size.tolist(), ends, fits.tolist(), strict=True)]
        at, doc = at[fits[doc]], doc[fits[doc]]
        begin, end = self.starts[0][at], self.starts[0][at + 1]
        place = np.repeat(begin, end - begin) + _counted(end - begin)
        of, pair, times = np.repeat(doc, end - begin), self.pairs[0][place], self.times[0][place]
        order = np.lexsort((pair, of))
        of, pair, times = of[order], pair[order], times[order]
        edge = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1]))[: len(of)])
        return stats, groups, of[edge], pair[edge], np.add.reduceat(times, edge) if len(edge) else times


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _some(texts: list[str | None]):
    """Bounds of runs of texts of about BLOCK_CHARS."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held >= BLOCK_CHARS:
            yield begin, i
            begin, held = i, 0
        held += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


STATS = "n_a long, n_b long, n_groups long, n_links long"


def _aligned(a_path: str, b_path: str, keep_groups: bool, batches):
    """Rows (id, text) -> rows (id, row: a number of its own, stats, groups, groups_sha256, pairs, times)."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for begin, end in _some(texts):
            stats, groups, of, pair, times = _aligner(a_path, b_path).look_up(texts[begin:end])
            n = end - begin
            edge = np.searchsorted(of, np.arange(n + 1))
            # pairs as steps of one sorted list, which pack well
            step = np.diff(pair, prepend=0)
            first = edge[:-1][edge[:-1] < edge[1:]]
            step[first] = pair[first]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            lists = lambda x: pa.LargeListArray.from_arrays(pa.array(edge), pa.array(x)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, n), pa.array((part << 40) + seen + np.arange(n)), *[pa.array(stats[:, i]) for i in range(4)], pa.array(groups if keep_groups else [None] * n, pa.string()), pa.array(digests), lists(step), lists(times)],
                names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "steps", "times"],
            )
            seen += n


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each entry and the entries, of a batch's list column."""
    size = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy()


def _pairs(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and id pair of each entry of the steps."""
    row, step = _flat(column)
    total = np.cumsum(step)
    edge = np.append(True, row[1:] != row[:-1])[: len(row)]
    begin = np.flatnonzero(edge)
    return row, total - np.repeat((total - step)[begin], np.diff(np.append(begin, len(row))))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pair, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(pair)).astype(np.int64)


def _counts(batches):
    """Rows (steps) -> rows (pair, n): in how many texts it is, those of a task added up."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        pair = _pairs(batch.column(0))[1]
        parts.append(np.unique(pair, return_counts=True))
        held += len(parts[-1][0])
        if held > HELD_PAIRS:
            parts = [_summed(parts)]
            held = len(parts[0][0])
            if held > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["pair", "n"])
                parts, held = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(parts)], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per id pair: n, how many texts hold it linked, and best: n is the highest of its A id."""
    counted = saved(aligned.select("steps").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", SHIFT)
    highest = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary at most
    return saved(counted.join(highest, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best")


def _scored(table, first: bool, batches):
    """Rows (id, row, stats, groups, groups_sha256, steps, times) -> the same without lists, with n_best and count_sum over
    the pairs of a block; all but the row number are null after the first block."""
    for batch in batches:
        pairs, n, best = table.value
        row, pair = _pairs(batch.column(batch.num_columns - 2))
        times = batch.column(batch.num_columns - 1).flatten().to_numpy()
        at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
        row, times, at = row[hit], times[hit], at[hit]
        sums = []
        for weight in (times * best[at], times * n[at]):
            out = np.zeros(batch.num_rows, np.int64)
            np.add.at(out, row, weight)
            sums.append(pa.array(out))
        kept = [c if first or name == "row" else pa.nulls(len(c), c.type) for name, c in zip(batch.schema.names[:-2], batch.columns[:-2], strict=True)]
        yield pa.RecordBatch.from_arrays([*kept, *sums], names=[*batch.schema.names[:-2], "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with keep_groups the groups themselves
    (`a1,a2|b1;a3|b2,b3`: ids of A and of B, group by group).

    A codes space + text, B the text, to which it adds a space; special strings in texts are plain text. Null and empty
    texts, and those whose tokens' bytes are not space + text, have no tokens: zeros and empty strings. An id pair
    counts once for each row that holds it linked, so rows that repeat count each. n_best are links whose pair is
    as frequent as the most frequent one of its A id, count_sum adds the counts of the pairs of all links. An
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row long, {STATS}, groups string, groups_sha256 string, steps array<long>, times array<long>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with interim(spark):
        aligned = saved(rows.mapInArrow(partial(_aligned, a_path, b_path, keep_groups), schema), "aligned", batch_rows=500, lasting=True)
        table = pair_counts(aligned)
        n_blocks = max(1, -(-table.count() // BLOCK_PAIRS))
        dealt = saved(table.withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(n_blocks))).repartition("block"), "dealt") if n_blocks > 1 else table.withColumn("block", F.lit(0))
        parts = []
        for block in range(n_blocks):
            got = dealt.where(F.col("block") == block).select("pair", "n", "best").limit(2 * BLOCK_PAIRS).toArrow().sort_by("pair")
            if got.num_rows == 2 * BLOCK_PAIRS:
                raise ValueError("a block of id pairs has twice its average size")
            found = spark.sparkContext.broadcast(tuple(got[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")))
            parts.append(saved(aligned.mapInArrow(partial(_scored, found, block == 0), f"id {kind}, row long, {STATS}, groups string, groups_sha256 string, n_best long, count_sum long"), f"scored-{block}", lasting=True))
            found.unpersist()
    every = parts[0]
    for more in parts[1:]:
        every = every.unionAll(more)
    stats = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]
    added = every.groupBy("row").agg(*[F.max(c).alias(c) for c in stats], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return added.select(*out, *["groups"] * keep_groups)
