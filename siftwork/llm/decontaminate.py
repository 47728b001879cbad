"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every word sequence of every item. Training words are streamed through it; at each
word it knows the longest sequence ending there that some item has. Once that length reaches the window,
the words of the window are hit, and the automaton's state knows which items hold it.

Words of a text that no item has reset the automaton, and a run of item words shorter than the shortest
window cannot hold one; such runs are found with numpy and not streamed.

Automata are built on executors, one for each part of the items of at most about MAX_ITEM_WORDS words, and
kept in plain arrays of less than 200 bytes a word. They are broadcast one after the other, with a pass over
the texts for each, so a worker holds one at a time however many items there are.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._bytes import ALNUM, blocks, words
from ._spark import interim, joined_in_parts, saved

#: Words of one automaton, about; further items go to further automata.
MAX_ITEM_WORDS = 1_500_000
WIDE = 12  # edges of a state from which on they are found by a dictionary while it is built


class SuffixAutomaton:
    """A generalised suffix automaton over words 0 .. n_words - 1, built item by item. Edges lie in lists per state."""

    def __init__(self, n_words: int):
        self.link, self.len, self.head = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.source, self.word, self.to, self.after = array("i"), array("i"), array("i"), array("i")
        self.root = array("i", [-1]) * n_words  # the first state's edges, by word
        self.wide: dict[int, dict[int, int]] = {}
        self.own_state, self.own_item = array("i"), array("i")  # states of the items' prefixes

    def _edge(self, state: int, w: int) -> int:
        """The edge of a state for a word, or -1; the first state's edges are in `root`."""
        if state == 0:
            return self.root[w]
        if (many := self.wide.get(state)) is not None:
            return many.get(w, -1)
        e, steps = self.head[state], 0
        while e >= 0 and self.word[e] != w:
            e = self.after[e]
            steps += 1
        if steps > WIDE:
            many, x = {}, self.head[state]
            while x >= 0:
                many[self.word[x]] = x
                x = self.after[x]
            self.wide[state] = many
        return e

    def _add_edge(self, state: int, w: int, to: int) -> None:
        e = len(self.to)
        self.source.append(state)
        self.word.append(w)
        self.to.append(to)
        self.after.append(self.head[state])
        self.head[state] = e
        if state == 0:
            self.root[w] = e
        elif (many := self.wide.get(state)) is not None:
            many[w] = e

    def _state(self, length: int, link: int) -> int:
        self.len.append(length)
        self.link.append(link)
        self.head.append(-1)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q])
        e = self.head[q]
        while e >= 0:
            self._add_edge(clone, self.word[e], self.to[e])
            e = self.after[e]
        self.link[q] = clone
        while p >= 0 and (e := self._edge(p, w)) >= 0 and self.to[e] == q:
            self.to[e] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, w: int) -> int:
        e = self._edge(last, w)
        if e >= 0:
            q = self.to[e]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.len[last] + 1, 0), last
        while p >= 0 and (e := self._edge(p, w)) < 0:
            self._add_edge(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.to[e]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def add(self, item: int, sequence: list[int]) -> None:
        last = 0
        for w in sequence:
            last = self.extend(last, w)
            self.own_state.append(last)
            self.own_item.append(item)

    def walk(self, sequence: list[int]) -> int:
        state = 0
        for w in sequence:
            state = self.to[self._edge(state, w)]
        return state


@dataclass
class Matcher:
    """Frozen automaton over the items' words; all but `names` and `whole` are arrays.

    Edges of state s are word[first[s] : first[s + 1]], sorted, and to[...]. Items that hold the sequences of
    s are item[low[s] : high[s]]: states are numbered along the suffix tree, so those below s are neighbours.
    """

    window: int
    shortest: int
    names: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    first: np.ndarray
    word: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    item: np.ndarray
    low: np.ndarray
    high: np.ndarray
    short: np.ndarray  # per state the nearest on its suffix path that is a whole item shorter than the window, or -1
    whole: dict[int, list[tuple[int, int]]]  # such states: (item, words)

    @classmethod
    def build(cls, items: list[tuple[str, np.ndarray]], window: int) -> Matcher:
        vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        names = sorted({n for n, _ in items})
        place = {n: i for i, n in enumerate(names)}
        a = SuffixAutomaton(len(vocabulary))
        for n, h in items:
            a.add(place[n], np.searchsorted(vocabulary, h).tolist())
        whole: dict[int, list[tuple[int, int]]] = {}
        for n, h in items:  # walked when all are in, as later items may split a state
            if 0 < len(h) < window:
                whole.setdefault(a.walk(np.searchsorted(vocabulary, h).tolist()), []).append((place[n], len(h)))
        link, length, source, word, to = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (a.link, a.len, a.source, a.word, a.to))
        order = np.lexsort((word, source))
        first = np.searchsorted(source[order], np.arange(len(link) + 1)).astype(np.int32)
        own_state = np.frombuffer(a.own_state, np.int32) if len(a.own_state) else np.zeros(0, np.int32)
        # numbers of states along the suffix tree: sizes from the longest up, then each below its parent in turn
        by_length = np.argsort(length, kind="stable")
        size, after = array("i", [1]) * len(link), array("i", [0]) * len(link)
        for s in reversed(by_length.tolist()):
            if s:
                size[link[s]] += size[s]
        number = array("i", [0]) * len(link)
        short = array("i", [-1]) * len(link)
        for s in by_length.tolist():
            up = link[s]
            if s:
                number[s] = number[up] + 1 + after[up]
                after[up] += size[s]
                short[s] = s if s in whole else short[up]
        number, size = np.frombuffer(number, np.int32), np.frombuffer(size, np.int32)
        at = np.argsort(number[own_state], kind="stable")
        numbers = number[own_state][at]
        return cls(
            window,
            min((min(len(h), window) for _, h in items if len(h)), default=0),
            names,
            vocabulary,
            first,
            word[order],
            to[order],
            link.copy(),
            length.copy(),
            (np.frombuffer(a.own_item, np.int32) if len(at) else np.zeros(0, np.int32))[at],
            np.searchsorted(numbers, number).astype(np.int32),
            np.searchsorted(numbers, number + size).astype(np.int32),
            np.frombuffer(short, np.int32).copy(),
            whole,
        )

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def stream(self, ids: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Run item words ids (text words at, at + 1, ...) from the start state; mark hits and items."""
        first, word, to, links, lens, short = (memoryview(x) for x in (self.first, self.word, self.to, self.link, self.length, self.short))
        window = self.window
        state, length, met = 0, 0, set()
        for i, w in enumerate(ids):
            while True:
                end = first[state + 1]
                e = bisect_left(word, w, first[state], end)
                if e < end and word[e] == w:
                    state, length = to[e], length + 1
                    break
                if state == 0:
                    length = 0
                    break
                state = links[state]
                length = lens[state]
            if length >= window:
                hit[at + i - window + 1 : at + i + 1] = True
                s = state
                while lens[links[s]] >= window:
                    s = links[s]
                if s not in met:
                    met.add(s)
                    found.update(np.unique(self.item[self.low[s] : self.high[s]]).tolist())
            s = short[state]
            while s > 0:
                for item, n in self.whole[s]:
                    if n <= length:
                        hit[at + i - n + 1 : at + i + 1] = True
                        found.add(item)
                s = short[links[s]]

    def mark(self, h: np.ndarray, doc: np.ndarray, hit: np.ndarray, found: dict[int, set[str]]) -> None:
        """Mark the hit words of a block (h: word hashes, doc: text numbers) and add the items found in each text."""
        if not len(h) or not len(self.vocabulary):
            return
        ids = np.searchsorted(self.vocabulary, h)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == h
        # runs of known words within one text
        edge = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0) | np.append(np.append(0, np.diff(doc) != 0), 0))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if known[s] and e - s >= self.shortest:
                items: set[int] = set()
                self.stream(ids[s:e].tolist(), hit, s, items)
                if items:
                    found.setdefault(int(doc[s]), set()).update(self.names[x] for x in items)


def judged(matcher: Matcher, column: pa.Array, before: list[tuple[list[int], list[str]]] | None = None) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]], list[int]]]:
    """Per text: words, hit words, sorted names of the items found, hit byte spans, and the same as word ranges (flat).
    before: word ranges and names that other automata have found in each text."""
    row = 0
    for _, _, buf, off in blocks(column):
        h, a, b, doc = words(buf, off, ALNUM, lower=True)
        n_docs = len(off) - 1
        count = np.bincount(doc, minlength=n_docs)
        start = np.cumsum(count) - count
        hit, found = np.zeros(len(h), bool), {}
        matcher.mark(h, doc, hit, found)
        if before is not None:
            for i, (ranges, names) in enumerate(before[row : row + n_docs]):
                for s, e in zip(ranges[::2], ranges[1::2], strict=True):
                    hit[start[i] + s : start[i] + e] = True
                if names:
                    found.setdefault(i, set()).update(names)
        row += n_docs
        hits = np.bincount(doc[hit], minlength=n_docs)
        for i in range(n_docs):
            spans: list[tuple[int, int]] = []
            flat: list[int] = []
            if hits[i]:
                lo = int(start[i])
                own = np.flatnonzero(hit[lo : lo + count[i]]) + lo
                cut = np.flatnonzero(np.diff(own) > 1)
                for s, e in zip(own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)], strict=True):
                    spans.append((int(a[s] - off[i]), int(b[e] - off[i])))
                    flat += [int(s) - lo, int(e) + 1 - lo]
            yield int(count[i]), int(hits[i]), sorted(found.get(i, ())), spans, flat


def matchers(items: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[Matcher]:
    """Matchers over the items, one at a time, built on executors. Null texts and items without words match nothing."""
    texts = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    most = MAX_ITEM_WORDS
    size = texts.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # no text has more words
    parts = max(1, -(-2 * int(size) // most))
    piece = max(window, most // 16)  # an item of more words is cut, so that each window lies in one piece

    def cut(batches):
        for batch in batches:
            names, pieces = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                column = pa.array([text.as_py()], pa.string())
                h = np.concatenate([words(buf, off, ALNUM, lower=True)[0] for _, _, buf, off in blocks(column)] or [np.zeros(0, np.uint64)])
                for at in range(0, max(1, len(h) - window + 1) if len(h) > piece else min(1, len(h)), piece - window + 1):
                    names.append(name)
                    pieces.append(h[at : at + piece].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary())], names=["name", "words"])

    def build(table: pa.Table) -> pa.Table:
        found = [(n, np.frombuffer(w, np.uint64)) for n, w in zip(table["name"].to_pylist(), table["words"].to_pylist(), strict=True)]
        # blobs in pieces, as a row should not be too long
        blob = pickle.dumps(Matcher.build(found, window), protocol=5)
        chunks = [blob[i : i + (16 << 20)] for i in range(0, len(blob), 16 << 20)]
        return pa.table({"part": pa.array([table["part"][0].as_py()] * len(chunks), pa.int64()), "chunk": pa.array(range(len(chunks)), pa.int64()), "blob": pa.array(chunks, pa.binary())})

    pieces = texts.mapInArrow(cut, "name string, words binary").withColumn("part", F.pmod(F.xxhash64("name", "words"), F.lit(parts)))
    built = saved(pieces.groupBy("part").applyInArrow(build, "part long, chunk long, blob binary"), "automata")
    some = False
    for part in range(parts):
        chunks = built.where(F.col("part") == part).orderBy("chunk").select("blob").toArrow()["blob"].to_pylist()
        if chunks:
            some = True
            yield pickle.loads(b"".join(chunks))
    if not some:
        yield Matcher.build([], window)


def _passes(docs: DataFrame, text_col: str, id_col: str | None, found: Iterator[Matcher], finish, schema: StructType) -> DataFrame:
    """docs through all matchers, one pass for each; finish(batch of docs, judged rows) makes a batch.

    With one matcher no row moves. With more, each of the others leaves the marks of the texts that it hits, known by
    their SHA-256, and the last pass joins these with docs: as many bytes as marks are written, and no text, and docs are
    shuffled at most once, where the marks are too many to be broadcast. Copies of one text are dealt by id_col."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    n_columns = len(docs.columns)

    def marks_of(shared):
        def run(batches):
            for batch in batches:
                rows = list(judged(shared.value, batch.column(1)))
                hit = [i for i, r in enumerate(rows) if r[1]]
                columns = [batch.column(0).take(pa.array(hit, pa.int64())), pa.array([rows[i][4] for i in hit], pa.list_(pa.int64())), pa.array([rows[i][2] for i in hit], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ranges", "names"])

        return run

    def last(shared):
        def run(batches):
            for batch in batches:
                before = None
                if batch.num_columns > n_columns:
                    before = [(r or [], x or []) for r, x in zip(*(batch.column(n_columns + i).to_pylist() for i in (0, 1)), strict=True)]
                own = pa.RecordBatch.from_arrays(batch.columns[:n_columns], schema=pa.schema(list(batch.schema)[:n_columns]))
                yield finish(own, list(judged(shared.value, batch.column(at), before)))

        return run

    key = F.sha2(F.col(f"`{text_col}`"), 256)
    marks: list[DataFrame] = []
    matcher = next(found)
    for after in found:
        shared = spark.sparkContext.broadcast(matcher)
        hits = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null").mapInArrow(marks_of(shared), "key string, ranges array<long>, names array<string>")
        # copies of a text have the same marks: any of them stands for all
        marks.append(saved(hits.groupBy("key").agg(F.first("ranges").alias("ranges"), F.first("names").alias("names")), "marks", lasting=True))
        shared.destroy()
        matcher = after
    if marks:
        every = marks[0]
        for more in marks[1:]:
            every = every.unionByName(more)
        # a text has one row for each matcher at most
        every = every.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
        # rows move as one struct, so their columns may have any name
        salt = F.xxhash64(F.col(f"`{id_col}`")) if id_col in docs.columns else F.lit(0)
        rows = docs.select(F.struct("*").alias("row"), key.alias("key"), salt.alias("salt"))
        joined = joined_in_parts(rows, every, "key", "salt", how="left")
        docs = joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "ranges", "names")
    return docs.mapInArrow(last(spark.sparkContext.broadcast(matcher)), schema)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_hit, items (sorted names of items with occurring windows), spans (byte ranges to remove).

    Words are lower-cased runs of ASCII letters, digits and all bytes above 127. A window is `window`
    consecutive words of an item, or a whole shorter item. Null texts have no words; rows that repeat are
    judged each; a null item id is the empty name, and items of one name are one item; empty tables on either
    side give no hits; further columns are ignored. Items beyond about MAX_ITEM_WORDS words go to further
    automata, each of which takes one more pass over the texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows_of(batch, rows):
        n, hit, names, spans, _ = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=[id_col, "n_words", "n_hit", "items", "spans"],
        )

    schema = StructType.fromDDL(f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")
    with interim(docs.sparkSession):
        return _passes(docs.select(id_col, text_col), text_col, id_col, matchers(items, window, item_col, item_text_col), rows_of, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with hit spans cut from the text; rows of which more than `most_coverage` of the
    words are hit go altogether. What stood around a cut is joined by one space. Null and empty texts, and texts
    without words, stay as they are; rows that repeat, also those of a null id, are cut alike; an empty table of
    docs or of items gives the rows of docs."""
    at = docs.columns.index(text_col)

    def clean(batch, rows):
        texts, keep = batch.column(at).to_pylist(), []
        for i, (n, hit, _, spans, _) in enumerate(rows):
            keep.append(hit <= most_coverage * n)
            if spans:
                raw, parts, last = texts[i].encode(), [], 0
                for s, e in spans:
                    parts.append(raw[last:s].rstrip())
                    last = e
                texts[i] = b" ".join([*parts, raw[last:].lstrip()]).decode().strip()
        columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    with interim(docs.sparkSession):
        return _passes(docs, text_col, id_col, matchers(items, window, item_col, item_text_col), clean, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The operator's rows with the items folded to a count and a SHA-256."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
