"""Removal of repeated word windows by relative Lempel-Ziv parsing, whole corpus, exact.

A word goes if it lies in a window of `window` words whose sequence also starts anywhere else, in the same
text or another one, judged on the input. The first occurrence goes like all others.

1. Runs. Each window is given to the smallest hash of the k-word strings in it, so equal windows have equal
   anchors. Neighbouring windows of one anchor place form a run, a stretch of under 2 * `window` words.
   Every window start lies in exactly one run.
2. Copies. Runs with equal anchors and words fold, in every task first: such a run is one factor from end
   to end, so all its windows are repeats.
3. Reference blocks. The different runs of an anchor are fetched from their texts. The runs of whole
   anchors, up to BLOCK_BYTES, form a reference block, indexed by the ranks of its suffixes. All of the
   block's runs are parsed against it at once: a factor is the longest prefix of the rest of a run that
   also begins at another place of the block. Factors of `window` words or more hold repeats.
4. Factor boundaries. A factor and its next word occur nowhere else, so a repeat that is not inside a factor
   can only cross one boundary and lie in the two factors beside it. These windows are looked up one by one.
5. The ranges of repeats are united per text and their words cut.
Equal windows have the same anchor, hence the same block, so a text meets every reference block that can
hold its words and no other. Anchors with more than HOT_RUNS different runs do not form a block: their
windows are counted one by one, which folds in every task, so no task holds all runs of an anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _M_INV, NOT_SPACE, U, blocks, mix, powers, range_hashes, windows, words
from ._spark import interim, saved

WINDOW, K = 35, 8
HOT_RUNS = 4096  # different runs of one anchor beyond which its windows are counted one by one
BLOCK_BYTES = 1 << 21  # of the runs of one reference block
FOLD_RUNS = 1_000_000  # runs of a task that are held and folded together
PIECE_WORDS = 1 << 22  # of a block that are looked at together
PLACE_BITS = 24
LO = 1 << 8  # place = first window start << 8 | windows
RANGE, RUN = 0, 1  # roles of rows


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i : i + w] for each i."""
    n = len(v)
    padded = np.append(v, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(after[: n - w + 1], before[w - 1 :])


def runs(h: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int, k: int):
    """Of each run among words with hashes h of texts doc (`first`: the first word of each text): anchor hash, hash of
    its words, text, first window start in its text, windows."""
    out = []
    for at in range(0, max(len(h) - window + 1, 0), PIECE_WORDS):  # pieces overlap by a window less one word
        x, d = h[at : at + PIECE_WORDS + window - 1], doc[at : at + PIECE_WORDS + window - 1]
        grams = windows(x, k)
        low = U((1 << PLACE_BITS) - 1)
        smallest = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - k + 1)
        start = np.flatnonzero(d[: len(smallest)] == d[window - 1 :])
        if not len(start):
            continue
        anchor = (smallest[start] & low).astype(np.int64)
        edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        lo, n = start[edge], np.diff(np.append(edge, len(start)))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(_M_INV, len(x)), out=sums[1:])
        out.append((mix(grams[anchor[edge]]), range_hashes(sums, lo, lo + n + window - 1), d[lo], lo + at - first[d[lo]], n))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def united(rows: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (first window start, windows) of each row, neighbours joined."""
    order = np.lexsort((lo, rows))
    rows, lo, n = rows[order], lo[order], n[order]
    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (lo[1:] != lo[:-1] + n[:-1]))[: len(rows)])
    return rows[at], lo[at], np.add.reduceat(n, at) if len(at) else n


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


FOLDED = "role int, h long, c long, copies long, row long, place long"


def _folded_runs(window: int, k: int):
    """Rows of runs (role RUN), equal ones of a task as one with its copies; and the ranges of those that have copies in
    their own task (role RANGE: row, place = first start << 8 not limited, copies = windows)."""
    names = ["role", "h", "c", "copies", "row", "place"]

    def fold(parts) -> list[pa.RecordBatch]:
        h, c, row, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lo, row, c, h))
        h, c, row, lo, n = h[order], c[order], row[order], lo[order], n[order]
        edge = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))[: len(h)])
        copies = np.diff(np.append(edge, len(h)))
        again = np.repeat(copies, copies) > 1
        r, a, m = united(row[again], lo[again], n[again])
        return [
            _batch(names, np.full(len(edge), RUN, np.int32), h[edge], c[edge], copies, row[edge], lo[edge] * LO + n[edge]),
            # ranges are dealt by their own hash
            _batch(names, np.full(len(r), RANGE, np.int32), mix(r.view(np.uint64) + a.astype(np.uint64)).view(np.int64), np.zeros(len(r), np.int64), m, r, a),
        ]

    def work(batches):
        parts, held = [], 0
        for batch in batches:
            row = batch.column(0).to_numpy()
            for at, _, buf, off in blocks(batch.column(1)):
                h, _, _, doc = words(buf, off, NOT_SPACE, lower=False)
                found = runs(h, doc, np.searchsorted(doc, np.arange(len(off) - 1)), window, k)
                parts.append((found[0].view(np.int64), found[1].view(np.int64), row[found[2] + at], found[3], found[4]))
                held += len(found[0])
                if held >= FOLD_RUNS:
                    yield from fold(parts)
                    parts, held = [], 0
        if parts:
            yield from fold(parts)

    return work


MET = "role int, h long, row long, place long, n long, copied boolean"


def _met(batches):
    """From rows FOLDED sorted by (h, c), at most a few of one run for each task: ranges of repeats (role RANGE: row, place the
    first start, n) and one row for each different run (role RUN: h, row, place, copied: it has copies)."""
    names = ["role", "h", "row", "place", "n", "copied"]
    held: list[np.ndarray] | None = None
    for batch in _and_none(batches):
        columns = [batch.column(i).to_numpy() for i in range(6)] if batch is not None else [np.zeros(0, np.int64)] * 6
        if held is not None:
            columns = [np.append(a, b) for a, b in zip(held, columns, strict=True)]
        role, h, c, copies, row, place = columns
        if not len(h):
            continue
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (role[1:] != role[:-1]))
        edge = np.flatnonzero(new)
        cut = len(h) if batch is None else int(edge[-1])  # the last group may go on
        held = [x[cut:] for x in columns] if batch is not None else None
        edge = edge[edge < cut]
        if not len(edge):
            continue
        role, h, copies, row, place = (x[:cut] for x in (role, h, copies, row, place))
        size = np.diff(np.append(edge, cut))
        total = np.add.reduceat(copies, edge)
        run = role[edge] == RUN
        known = role == RANGE
        single = (role == RUN) & (copies == 1) & np.repeat(total > 1, size)  # copied, but not in its own task
        first = edge[run]
        rows = np.concatenate([row[known], row[single], row[first]])
        k = len(rows) - len(first)
        yield _batch(
            names,
            np.append(np.full(k, RANGE, np.int32), np.full(len(first), RUN, np.int32)),
            np.append(np.zeros(k, np.int64), h[first]),
            rows,
            np.concatenate([place[known], place[single] // LO, place[first]]),
            np.concatenate([copies[known], place[single] % LO, np.zeros(len(first), np.int64)]),
            np.append(np.ones(k, bool), total[run] > 1),
        )


def _and_none(batches):
    yield from batches
    yield None


FETCHED = "h long, row long, place long, copied boolean, hot boolean, words binary"


def _fetched(window: int):
    """From rows (row, text, asked runs): rows FETCHED, the words of a run joined by one space."""
    names = ["h", "row", "place", "copied", "hot", "words"]

    def work(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = text.as_buffer().to_pybytes().split() if isinstance(text, pa.BinaryScalar) else text.as_py().encode().split()
                out += [(a["h"], row, a["place"], a["copied"], a["hot"], b" ".join(found[a["place"] // LO : a["place"] // LO + a["place"] % LO + window - 1])) for a in asked]
                if len(out) >= 4096:
                    yield _columns(out, names)
                    out = []
            yield _columns(out, names)

    return work


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class Reference:
    """Index of a reference block: the ranks of its suffixes, by word strings of 1, 2, 4, ... words, and their order.
    `bounds` are the ends of the stretches that matches never cross."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, depth: int):
        n = len(ids) + len(bounds)
        # each stretch ends in a symbol of its own
        text = np.empty(n, np.int64)
        ends = bounds + np.arange(len(bounds))
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = ids
        text[ends] = int(ids.max(initial=0)) + 1 + np.arange(len(bounds))
        self.starts = np.append(0, ends[:-1] + 1)
        self.ends = ends
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.ranks, step = [rank], 1
        while step < depth:
            after = np.append(rank[step:], np.full(min(step, n), -1))[:n] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.size = n

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at p and q."""
        out = np.zeros(len(p), np.int64)
        p, q = p.copy(), q.copy()
        for j in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[j]
            fits = (p < self.size) & (q < self.size)
            same = np.zeros(len(p), bool)
            same[fits] = rank[p[fits]] == rank[q[fits]]
            for x in (out, p, q):
                x[same] += 1 << j
        return out

    def longest(self, p: np.ndarray) -> np.ndarray:
        """Length of the longest prefix of each suffix that also begins at another place: one of its neighbours in the
        order of suffixes shares most."""
        at = self.place[p]
        left = self.common(p, self.order[np.maximum(at - 1, 0)])
        right = self.common(p, self.order[np.minimum(at + 1, self.size - 1)])
        return np.maximum(np.where(at > 0, left, 0), np.where(at + 1 < self.size, right, 0))


def repeated_starts(ids: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, first word in it) of the windows that begin at two places or more of a block of stretches: all stretches are
    parsed side by side, factor by factor."""
    if not len(bounds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = int(np.diff(np.append(0, bounds)).max())
    reference = Reference(ids, bounds, max(depth, 2))
    at, end, which = reference.starts.copy(), reference.ends, np.arange(len(bounds))
    before = at.copy()  # the last factor's start; at is its end
    of, found = [], []
    while True:
        go = at + (window - 1) < end + (at - before)  # a window that begins in the last factor or later still fits
        at, before, end, which = at[go], before[go], end[go], which[go]
        if not len(at):
            break
        length = reference.longest(at)
        inside = np.maximum(length - window + 1, 0)
        of.append(np.repeat(which, inside))
        found.append(np.repeat(at, inside) + _counted(inside))
        # windows that cross the boundary and lie in both factors
        low = np.maximum(before + 1, at - window + 1)
        many = np.maximum(np.minimum(at - 1, at + length - window) - low + 1, 0)
        tried = np.repeat(low, many) + _counted(many)
        hit = reference.longest(tried) >= window
        of.append(np.repeat(which, many)[hit])
        found.append(tried[hit])
        # a word that occurs nowhere else is a factor that nothing can cross
        before = np.where(length > 0, at, at + 1)
        at = at + np.maximum(length, 1)
    of, found = np.concatenate(of), np.concatenate(found)
    return of, found - reference.starts[of]


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... of each count."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


RANGES = "row long, lo long, n long"


def _parsed(rows: list[tuple[int, int, bool, bytes]], window: int) -> pa.RecordBatch:
    """Ranges of repeats of the runs (row, place, copied, words) of one reference block; copied runs are known already."""
    rows = sorted({(r, p): (c, w) for r, p, c, w in rows}.items())
    texts = pa.array([w for _, (_, w) in rows], pa.binary()).cast(pa.string())
    hashes, count = [], []
    for _, _, buf, off in blocks(texts):
        h, _, _, doc = words(buf, off, NOT_SPACE, lower=False)
        hashes.append(h)
        count.append(np.bincount(doc, minlength=len(off) - 1))
    ids = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int64)
    of, start = repeated_starts(ids, np.cumsum(np.concatenate(count)), window)
    fresh = np.array([not c for _, (c, _) in rows])[of]
    of, start = of[fresh], start[fresh]
    row, place = (np.array([k[i] for k, _ in rows], np.int64) for i in range(2))
    return _batch(["row", "lo", "n"], *united(row[of], place[of] // LO + start, np.ones(len(of), np.int64)))


def _in_blocks(window: int):
    """From rows (h, row, place, copied, words) sorted by h: ranges of repeats, by reference blocks of whole anchors."""

    def work(batches):
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for h, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if h != last and size >= BLOCK_BYTES:
                    yield _parsed(rows, window)
                    rows, size = [], 0
                last = h
                rows.append(tuple(rest))
                size += len(rest[-1])
        if rows:
            yield _parsed(rows, window)

    return work


def _single_windows(window: int):
    """From rows (row, place, copied, words): rows (a, b, row, lo, weight) of their windows, a and b a digest of the words."""

    def work(batches):
        for batch in batches:
            out = []
            for row, place, copied, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = text.split()
                for i in range(place % LO):
                    d = hashlib.blake2b(b" ".join(found[i : i + window]), digest_size=16).digest()
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), row, place // LO + i, 2 if copied else 1))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "row", "lo", "weight"])

    return work


def _hot_ranges(hot: DataFrame, window: int) -> DataFrame:
    """Ranges of repeats among the runs of anchors that have very many: a window is one unless it is counted once. Counts fold
    in every task, and windows find their verdict by their own place, so no task meets all runs of an anchor."""
    single = saved(hot.select("row", "place", "copied", "words").mapInArrow(_single_windows(window), "a long, b long, row long, lo long, weight long"), "windows")
    counted = single.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.min(F.struct("row", "lo")).alias("first"))
    once = counted.where("weight = 1").select("first.row", "first.lo")
    return single.where("weight = 1").select("row", "lo").join(once, ["row", "lo"], "left_anti").select("row", "lo", F.lit(1).cast("long").alias("n"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Ranges (row, lo, n) of starts of repeated windows, of rows (row, text)."""
    folded = docs.mapInArrow(_folded_runs(window, k), FOLDED)
    met = saved(folded.repartition("h", "c").sortWithinPartitions("h", "c").mapInArrow(_met, MET), "met")
    found = met.where(F.col("role") == RUN).select("h", "row", "place", "copied")
    # an anchor with one run, or whose runs are all known, asks for nothing
    anchors = found.groupBy("h").agg(F.count("*").alias("m"), F.min("copied").alias("done")).where("m > 1 and not done").select("h", (F.col("m") > HOT_RUNS).alias("hot"))
    asked = found.join(anchors, "h").groupBy("row").agg(F.collect_list(F.struct("h", "place", "copied", "hot")).alias("asked"))  # a text has fewer runs than words
    fetched = saved(docs.where("text is not null").join(asked, "row").select("row", "text", "asked").mapInArrow(_fetched(window), FETCHED), "fetched", batch_rows=1000)
    parsed = fetched.where("not hot").select("h", "row", "place", "copied", "words").repartition("h").sortWithinPartitions("h").mapInArrow(_in_blocks(window), RANGES)
    known = met.where(F.col("role") == RANGE).select("row", F.col("place").alias("lo"), "n")
    return known.unionAll(parsed).unionAll(_hot_ranges(fetched.where("hot"), window))


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, spans (removed ranges of words), text (the words that are left, joined by one space),
    kept_sha256 (of that text in UTF-8).

    Words are the stretches of bytes other than white space of the whole text, taken as they are. Null and empty texts,
    and those of white space, have none; texts of fewer than `window` words keep all. Every row is a text of its
    own, so rows that repeat lose all windows, null ids or not. An empty table gives an empty result; further columns
    are ignored, whatever their names. Words are compared by 64-bit hashes.
    """
    k = k or max(1, min(K, window // 3))
    if not 1 <= k <= window <= 255:  # a run's number of windows has 8 bits of its place
        raise ValueError("window must lie between k and 255")
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.length(id_col), F.lit(-1)), F.col(text_col)).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    with interim(docs.sparkSession):
        ranges = saved(repeated_ranges(keyed.select("row", "text"), window, k).groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("ranges")), "ranges", lasting=True)
    joined = keyed.join(ranges, "row", "left").select("id", "text", "ranges")

    def cut(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                found = (text.as_py() or "").encode().split()
                spans: list[list[int]] = []
                if ranges.is_valid:
                    lo, n = (ranges.values.field(i).to_numpy() for i in range(2))
                    order = np.argsort(lo, kind="stable")
                    for a, b in zip(lo[order].tolist(), (lo + n + window - 1)[order].tolist(), strict=True):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept += found[at:a]
                    at = b
                kept += found[at:]
                left = b" ".join(kept)
                out.append((len(found), len(found) - len(kept), [{"start": a, "end": b} for a, b in spans], left.decode(), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.list_(span), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["id", "n_words", "n_removed", "spans", "text", "kept_sha256"])

    done = joined.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, text string, kept_sha256 string")
    return done.withColumnRenamed("id", id_col)
