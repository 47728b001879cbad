"""Removal of repeated byte strings with suffix arrays, whole corpus, exact.

A byte goes if it lies in a `depth`-byte string that also starts earlier (smaller id, or the same text
further left), judged on the input.

1. Anchors. Each window of `depth` bytes is given to the smallest hash of the k-byte strings in it, so
   equal windows have equal anchors, and neighbouring windows mostly share one. Windows of one anchor
   place form a run; a run is known by its anchor and by a hash of all bytes that its windows cover.
2. Equal runs. Runs meet by anchor hash. Of runs with equal bytes all but the earliest are repeats,
   window by window; equal runs of one task are folded before the shuffle.
3. Suffix arrays. Anchors with different runs (edits, ends of shared passages) need a finer look: the
   places of these runs go to their texts, and their bytes to the anchor's task, where the runs of many
   anchors form one block. Its suffixes are sorted in two stages; adjacent suffixes whose common prefix
   reaches `depth` are equal windows, and all but the earliest are repeats.
4. The byte ranges of repeats are united per text and cut out.
Runs of anchors with very many different ones do not meet by anchor: where their bytes are read, they are
dealt by the bytes that a few neighbouring windows have in common. Of these rows equal ones fold before any
are gathered, and a key with very many different ones left is dealt window by window, where the earliest of
each decides, so no task must hold a key's rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._bytes import BLOCK_BYTES, U, blocks, mix, powers, prefix_sums, range_hashes
from ._spark import interim, joined_in_parts, saved

DEPTH, K = 100, 24
HOT_RUNS = 4096  # different runs of one anchor beyond which it is dealt out again
HOT_STEP = 8  # window starts per row then
BLOCK_RUNS_BYTES = 1 << 19  # of one suffix array, which takes about 100 times as much while it is made
ROWS = 512  # texts that Python takes apart at once
FOLD_RUNS = 2_000_000  # runs of a task that are held and folded together, 32 bytes each
PLACE_BITS = 24
#: place = tag (24 bits of the text's hash) << 39 | first window start << 8 | windows
TAG, LO = 1 << 39, 1 << 8
NULL_ID = -(1 << 63)
REPEAT, MARK, LOOK = 0, 1, 2  # roles of rows


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i : i + w] for each i."""
    n = len(v)
    padded = np.append(v, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(after[: n - w + 1], before[w - 1 :])


def runs(buf: np.ndarray, off: np.ndarray, depth: int, k: int):
    """Of each run of a block: anchor hash, bytes hash, text number, first start in the text and number of windows."""
    none = np.zeros(0, np.int64)
    if len(buf) < depth:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    s = prefix_sums(buf)
    grams = mix((s[k:] - s[:-k]) * powers(0x9E3779B97F4A7C15, len(s))[: len(s) - k])
    low = U((1 << PLACE_BITS) - 1)
    smallest = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), depth - k + 1)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(smallest)]
    start = np.flatnonzero(np.arange(len(smallest)) + depth <= off[doc + 1])
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = (smallest[start] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])))
    lo, n = start[first], np.diff(np.append(first, len(start)))
    return mix(grams[anchor[first]]), range_hashes(s, lo, lo + n + depth - 1), doc[lo], lo - off[doc[lo]], n


def _pieces(column: pa.Array, depth: int):
    """Yield (first row, bytes, offsets, place of the first byte in its text): blocks, and pieces of longer texts that
    overlap by depth - 1 bytes, so that each window is in one piece."""
    for first, _, buf, off in blocks(column):
        if len(buf) <= 2 * BLOCK_BYTES:
            yield first, buf, off, 0
        else:
            for at in range(0, len(buf), BLOCK_BYTES):
                piece = buf[at : at + BLOCK_BYTES + depth - 1]
                yield first, piece, np.array([0, len(piece)], np.int64), at


def _batch_runs(batch: pa.RecordBatch, depth: int, k: int):
    """Yield per piece: anchor, bytes hash, id and place of each run."""
    ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    for first, buf, off, base in _pieces(batch.column(1), depth):
        h, c, doc, lo, n = runs(buf, off, depth, k)
        row = doc + first
        yield h.view(np.int64), c.view(np.int64), ids[row], tags[row] * TAG + (lo + base) * LO + n


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(
        *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).bitwiseAND(F.lit((1 << 24) - 1)).alias("tag"),
    )


ROW = "h long, c long, id long, place long"


def _first_runs(depth: int, k: int):
    """Rows (h, c, id, place) of runs. Of FOLD_RUNS runs of a task, those that repeat an earlier one of them come as ranges
    of repeats at once: place - 2**63, with the number of windows in c and their id's hash in h."""

    def fold(parts) -> pa.RecordBatch:
        h, c, ids, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, ids, c, h))
        h, c, ids, place = h[order], c[order], ids[order], place[order]
        again = np.append(False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]))[: len(h)]
        # identical rows of one document are one document
        same = np.append(False, (ids[1:] == ids[:-1]) & (place[1:] == place[:-1]))[: len(h)] & again
        sure = again & ~same
        a, b, n = _united(ids[sure], place[sure] - place[sure] % LO, place[sure] % LO)
        first = ~again
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(h[first], mix(a.view(np.uint64)).view(np.int64))),
                pa.array(np.append(c[first], n)),
                pa.array(np.append(ids[first], a)),
                pa.array(np.append(place[first], b + NULL_ID)),
            ],
            names=["h", "c", "id", "place"],
        )

    def work(batches):
        parts, held = [], 0
        for batch in batches:
            for x in _batch_runs(batch, depth, k):
                parts.append(x)
                held += len(x[0])
                if held >= FOLD_RUNS:
                    yield fold(parts)
                    parts, held = [], 0
        if parts:
            yield fold(parts)

    return work


def _united(ids: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of window starts (place without its count, n) of each text, neighbours joined."""
    order = np.lexsort((place, ids))
    ids, place, n = ids[order], place[order], n[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (place[1:] != place[:-1] + n[:-1] * LO))[: len(ids)]
    at = np.flatnonzero(new)
    return ids[at], place[at], np.add.reduceat(n, at) if len(at) else n


def _repeats(batches):
    """From rows sorted by (h, c, id, place): ranges of repeated runs (role REPEAT), one row for each different run of an
    anchor that has more than one (role LOOK), and a mark for each anchor with more than HOT_RUNS of these
    (role MARK, sorting before all rows of its anchor). One row is held back, so an anchor may have any number of rows."""
    last = None  # the last row
    held = None  # h, id, place, has a match: the last first-of-its-bytes row
    count = 0  # different runs of the last anchor so far
    for batch in batches:
        h, c, ids, place = (batch.column(i).to_numpy() for i in range(4))
        ready = place < 0
        out = [(np.zeros(ready.sum(), np.int64), ids[ready], place[ready] - NULL_ID, c[ready], np.zeros(ready.sum(), np.int32))]
        h, c, ids, place = h[~ready], c[~ready], ids[~ready], place[~ready]
        if len(h):  # rows of one document that repeats are one row
            fresh = np.append(last is None or (h[0], c[0], ids[0], place[0]) != last, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1]))
            h, c, ids, place = h[fresh], c[fresh], ids[fresh], place[fresh]
        if len(h):
            again = np.append(last is not None and h[0] == last[0] and c[0] == last[1], (h[1:] == h[:-1]) & (c[1:] == c[:-1]))
            last = (h[-1], c[-1], ids[-1], place[-1])
            out.append((np.zeros(again.sum(), np.int64), ids[again], place[again] - place[again] % LO, place[again] % LO, np.zeros(again.sum(), np.int32)))
            h, ids, place = h[~again], ids[~again], place[~again]
            if len(h):
                edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                before = np.zeros(len(edge), np.int64)
                before[0] = count if held is not None and held[0] == h[0] else 0
                total = before + np.diff(np.append(edge, len(h)))
                count = int(total[-1])
                many = h[edge][(before <= HOT_RUNS) & (total > HOT_RUNS)]
                out.append((many, np.full(len(many), NULL_ID), np.full(len(many), -1), np.zeros(len(many), np.int64), np.full(len(many), MARK, np.int32)))
                if held is not None:
                    h, ids, place = np.append(held[0], h), np.append(held[1], ids), np.append(held[2], place)
                same = np.append(False, h[1:] == h[:-1])
                if held is not None:
                    same[0] = held[3]
                matched = same.copy()
                matched[:-1] |= h[1:] == h[:-1]
                held = (h[-1], ids[-1], place[-1], bool(same[-1]))
                some = np.flatnonzero(matched[:-1])
                out.append((h[some], ids[some], place[some], np.zeros(len(some), np.int64), np.full(len(some), LOOK, np.int32)))
        yield _role_batch(out)
    if held is not None and held[3]:
        yield _role_batch([(np.array([held[0]]), np.array([held[1]]), np.array([held[2]]), np.zeros(1, np.int64), np.full(1, LOOK, np.int32))])


def _role_batch(parts) -> pa.RecordBatch:
    h, ids, place, n, role = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(place), pa.array(n.astype(np.int64)), pa.array(role.astype(np.int32))], names=["h", "id", "place", "n", "role"])


def _dealt_again(key: int, i: int, p: int, data: bytes, depth: int, k: int):
    """A run of a hot anchor as rows of at most HOT_STEP window starts, keyed by the bytes that these windows share."""
    n = p % LO
    # equal windows lie equally far before their anchor, so runs are cut by that distance
    s = prefix_sums(np.frombuffer(data[:depth], np.uint8))
    grams = mix((s[k:] - s[:-k]) * powers(0x9E3779B97F4A7C15, len(s))[: len(s) - k]) >> U(PLACE_BITS)
    reach = int(grams.argmin())
    bucket = (reach - np.arange(n)) // HOT_STEP
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), n]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        j = int(bucket[s])
        begin = reach - j * HOT_STEP
        core = data[begin : begin - HOT_STEP + 1 + depth]
        digest = hashlib.blake2b(core + key.to_bytes(8, "little", signed=True) + bytes([j]), digest_size=8).digest()
        yield int.from_bytes(digest, "little", signed=True), i, p - n + s * LO + (e - s), data[s : e + depth - 1], True


RUN = "h long, id long, place long, bytes binary, dealt boolean"
RUN_ROWS = 4096  # in an Arrow batch, as rows have bytes


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _run_bytes(depth: int, k: int):
    """From rows (id, text, asked: places with their anchor and whether it is hot): rows (h, id, place, bytes, dealt) of these
    runs, those of hot anchors dealt again."""

    def work(batches):
        rows: list[tuple] = []
        for batch in _slices(batches):
            for i, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for a in asked:
                    h, p = a["h"], a["place"]
                    lo, n = p >> 8 & (1 << 31) - 1, p % LO
                    data = raw[lo : lo + n + depth - 1]
                    rows += _dealt_again(h, i, p, data, depth, k) if a["hot"] else [(h, i, p, data, False)]
                    if len(rows) >= RUN_ROWS:
                        yield _run_batch(rows)
                        rows = []
        yield _run_batch(rows)

    return work


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["h", "id", "place", "bytes", "dealt"])


FINE = "id long, place long, n long"
WINDOW = "a long, b long, id long, place long"


def _single_windows(depth: int):
    """Rows (id, place, bytes) as rows (a, b, id, place) of their windows, a and b a digest of the window."""

    def work(batches):
        for batch in batches:
            ids, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = place % LO
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            digests = b"".join(hashlib.blake2b(d[s : s + depth], digest_size=16).digest() for d, m in zip(batch.column(2).to_pylist(), n.tolist(), strict=True) for s in range(m))
            a, b = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, np.repeat(ids, n), np.repeat(place - n, n) + at * LO + 1)], names=["a", "b", "id", "place"])

    return work


def _hot_ranges(dealt: DataFrame, depth: int) -> DataFrame:
    """Ranges (id, place, n) of repeated windows among dealt rows (key, id, place, bytes), each (id, place) once.

    Of rows with equal bytes all but the earliest are repeats; they fold in every task and the others are found by
    their own (id, place), so no task meets all rows of a key. Keys with more than HOT_RUNS different rows go by
    single windows in the same way (there are few such keys, as each has many rows), all others to suffix arrays.
    """
    folded = saved(dealt.groupBy("key", "bytes").agg(F.min(F.struct("id", "place")).alias("first")).select("key", "first.id", "first.place", "bytes"), "folded")
    equal = dealt.select("id", "place").join(folded.select("id", "place"), ["id", "place"], "left_anti")
    large = saved(folded.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT_RUNS).select("key"), "large")  # small: Spark broadcasts it
    few = folded.join(large, "key", "left_anti").select("key", "id", "place", "bytes").repartition("key").sortWithinPartitions("key", "id", "place")
    single = saved(folded.join(large, "key", "left_semi").select("id", "place", "bytes").mapInArrow(_single_windows(depth), WINDOW), "windows")
    earliest = single.groupBy("a", "b").agg(F.min(F.struct("id", "place")).alias("first")).select("first.id", "first.place")
    again = equal.unionAll(single.select("id", "place").join(earliest, ["id", "place"], "left_anti"))
    return few.mapInArrow(_suffix_arrays(depth), FINE).unionAll(again.select("id", "place", F.col("place").bitwiseAND(F.lit(LO - 1)).alias("n")))


def _solved(rows: list[tuple[int, int, bytes]], depth: int) -> pa.RecordBatch:
    """Ranges of repeated windows among runs (id, place, bytes), by one suffix array over them."""
    from .suffix_sort import repeated_windows

    runs_of = sorted({(i, p): d for i, p, d in rows}.items())
    at = repeated_windows([d for _, d in runs_of], depth)
    begin = np.cumsum([0, *[len(d) + 1 for _, d in runs_of]])
    row = np.searchsorted(begin, at, "right") - 1
    ids = np.array([k[0] for k, _ in runs_of], np.int64)[row]
    place = np.array([k[1] - k[1] % LO for k, _ in runs_of], np.int64)[row] + (at - begin[row]) * LO
    ids, place, n = _united(ids, place, np.ones(len(ids), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), pa.array(n)], names=["id", "place", "n"])


def _suffix_arrays(depth: int):
    """From rows (key, id, place, bytes) sorted by the first three: ranges of repeated windows (id, place, n), from one
    suffix array for each block of whole keys."""

    def work(batches):
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for key, i, p, d in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != last and size >= BLOCK_RUNS_BYTES:
                    yield _solved(rows, depth)
                    rows, size = [], 0
                last = key
                rows.append((i, p, d))
                size += len(d)
        if rows:
            yield _solved(rows, depth)

    return work


def repeated_ranges(docs: DataFrame, depth: int = DEPTH, k: int = K) -> DataFrame:
    """Ranges of repeated window starts: id, tag, lo, n, of rows (id, text, tag)."""
    firsts = docs.mapInArrow(_first_runs(depth, k), ROW)
    met = saved(firsts.repartition("h").sortWithinPartitions("h", "c", "id", "place").mapInArrow(_repeats, "h long, id long, place long, n long, role int"), "runs")
    hot = saved(met.where(F.col("role") == MARK).select("h", F.lit(True).alias("hot")), "hot")
    asked = joined_in_parts(met.where(F.col("role") == LOOK).select("h", "id", "place"), hot, "h", "id", how="left")
    asked = asked.select("id", F.shiftright("place", 39).alias("tag"), F.struct("h", "place", F.coalesce("hot", F.lit(False)).alias("hot")).alias("a"))
    # each text once, as its rows may repeat; a text has fewer asked runs than bytes
    texts = docs.where("text is not null").join(asked.groupBy("id", "tag").agg(F.collect_list("a").alias("asked")), ["id", "tag"]).dropDuplicates(["id", "tag"])
    found = saved(texts.select("id", "text", "asked").mapInArrow(_run_bytes(depth, k), RUN), "bytes")
    few = found.where("not dealt").select("h", "id", "place", "bytes").repartition("h").sortWithinPartitions("h", "id", "place")
    fine = few.mapInArrow(_suffix_arrays(depth), FINE)
    ranges = met.where(F.col("role") == REPEAT).select("id", "place", "n").unionAll(fine).unionAll(_hot_ranges(found.where("dealt").select(F.col("h").alias("key"), "id", "place", "bytes"), depth))
    return ranges.select("id", F.shiftright("place", 39).alias("tag"), F.shiftright("place", 8).bitwiseAND(F.lit((1 << 31) - 1)).alias("lo"), "n")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), spans, kept (remaining bytes), kept_sha256, text
    (the remaining bytes as text, without bytes of characters that a cut parts), and the columns in `carry`.

    Texts are UTF-8 bytes; null and empty texts have none; texts shorter than `depth` keep all. Matches
    never cross texts. Rows that repeat one id and one text count as one document and get equal results;
    rows with one id and different texts are ordered by a hash of the text. A null id comes before all
    others. An empty table gives an empty result; further columns are ignored.
    """
    k = k or max(1, min(K, depth // 4))
    if not k <= depth <= 255:  # a run's number of windows has 8 bits of its place
        raise ValueError("depth must lie between k and 255")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _keyed(docs, id_col, text_col)
    whole = _keyed(docs, id_col, text_col, carry)
    with interim(docs.sparkSession):
        of_text = saved(repeated_ranges(rows, depth, k).groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("ranges")), "ranges", lasting=True)
    joined = whole.join(of_text, ["id", "tag"], "left").select("id", "text", "ranges", *["carried"] * bool(carry))

    def cut(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in _slices(batches):
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                spans: list[list[int]] = []
                if ranges.is_valid:
                    flat = ranges.values
                    lo, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    order = np.argsort(lo, kind="stable")
                    for a, b in zip(lo[order].tolist(), (lo + n + depth - 1)[order].tolist(), strict=True):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(spans), [{"start": a, "end": b} for a, b in spans], left, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], *batch.columns[3:]], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256", "text", *["carried"] * bool(carry)])

    kinds = StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string, text string")
    done = joined.mapInArrow(cut, StructType([*kinds.fields, *([whole.schema["carried"]] if carry else [])]))
    return done.select(F.when(F.col("id") != NULL_ID, F.col("id")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256", "text", *[F.col(f"carried.{c}").alias(c) for c in carry])
