"""Exact n-gram Jaccard self-join with size-banded tiles and hashed bitmap signatures.

1. Sets. A text becomes its set of word n-gram hashes. Texts with equal sets are one node from here on.
2. Bands. Sizes are cut into geometric bands. Linked sets of sizes a, b differ in at most
   (a + b)(1 - t)/(1 + t) = d members, so if more than d parts of the hash range have members of a set, one
   of these parts at least holds the same members in its partner. Each node sends one key per part with
   members, of its own band and of the larger bands that a partner may lie in. A set with d such parts or
   fewer sends keys of further cuts by other hashes until one has more; a partner with which it shares no
   key of one cut has as few parts there, so it sends those of the next as well. Only nodes that share a key
   can be linked, and sets without common members share none.
3. Stars. Of each key the smallest node is the centre. Every node is compared with the centre that it
   shares most keys with, and equal results are joined into components. This settles most groups of near
   copies with one comparison for each node. Then, MORE_STARS times, of each key whose nodes are still in
   different components a node of its main component, the one with most of its nodes, is the centre, and the
   nodes of the others are compared with it.
4. Tiles. Keys whose nodes are still in different components are compared in full: the nodes of the main
   component and those of the others are cut into blocks, and each pair of blocks but for two of the main
   component is a tile, so a large group costs its stragglers times its nodes, not its nodes squared. Bitmaps
   of hashed members bound the overlap of each pair from above: |A & B| <= |A| - bits(A & ~B). A first pass
   with short bitmaps only
   marks nodes that may have a partner. Then, with long ones, each node proposes its best partner of
   another component, the proposals are intersected exactly, as sorted arrays, and components grow; after
   ROUNDS of these, all pairs of different components that the bitmaps leave are intersected.
5. Components. Links join nodes; a component is named by its smallest document id.
Pairs are skipped only if both nodes are already connected, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, U, blocks, mix, windows, words
from ._spark import IdFilter, components, interim, joined_by_share, joined_in_parts, saved

GROWTH = 1.7  # of band bounds
BLOCK = 512  # nodes of a block, on average; a tile has two blocks
MOST_BITS = 1 << 16  # of a bitmap
SHORT, LONG = 2, 4  # bits of a bitmap for each member, rounded up to a power of two
ROUNDS = 3
MORE_STARS = 1


@dataclass(frozen=True)
class Bands:
    """Size bands for linking at 100 * |A & B| >= percent * |A | B|."""

    percent: int

    def bounds(self, most: int) -> np.ndarray:
        """Lower bounds of the bands, past `most`."""
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
        return np.array(out, np.int64)

    def parts(self, upper: int) -> int:
        """Parts of the hash range for the band whose largest size is `upper`, some more than its sets may differ in, as
        some have no members; 0: only equal sets link."""
        differ = 2 * upper * (100 - self.percent) // (100 + self.percent)
        return differ + differ // 50 + 2 if differ else 0


def shingle_sets(texts: pa.Array, n: int):
    """Yield (first row, sorted distinct hashes, offsets) for blocks of texts: lower-cased word n-grams, or the
    whole sequence of a text with fewer words."""
    for first, _, buf, off in blocks(texts):
        h, _, _, doc = words(buf, off, NOT_SPACE, lower=True)
        n_docs = len(off) - 1
        count = np.bincount(doc, minlength=n_docs)
        w = windows(h, n)
        inside = doc[: len(w)] == doc[n - 1 :] if len(w) else np.zeros(0, bool)
        values, of = w[inside], doc[: len(w)][inside]
        start = np.cumsum(count) - count
        for c in range(1, n):
            few = np.flatnonzero(count == c)
            if len(few):
                whole = np.full(len(few), c, np.uint64)
                for i in range(c):
                    whole += h[start[few] + i] * U(0x9E3779B97F4A7C15 + 2 * i)
                values, of = np.concatenate([values, mix(whole)]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
        edges = np.searchsorted(of, np.arange(n_docs + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[fresh], of[fresh]
        yield first, values, np.searchsorted(of, np.arange(n_docs + 1))


def node_ids(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit id per set that depends on its members alone (0 for the empty set)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    size = np.diff(edges)
    return np.where(size > 0, mix(sums[edges[1:]] - sums[edges[:-1]] + size.astype(np.uint64)), U(0)).view(np.int64)


CUTS = 8  # of one set, until more parts have members than a partner may differ in


def part_keys(values: np.ndarray, edges: np.ndarray, nodes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the parts with members of the given sets in all bands that they may share with a partner."""
    size = np.diff(edges)
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = bands.bounds(int(size.max() * 100 // bands.percent) + 1)
    own = np.searchsorted(bounds, size, "right") - 1
    last = np.searchsorted(bounds, size * 100 // bands.percent, "right") - 1
    plan = np.array([bands.parts(int(b) - 1) for b in bounds[1:]] + [0], np.int64)
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in range(int((last - own).max()) + 1):
        sets = np.flatnonzero((size > 0) & (own + step <= last))
        band = own[sets] + step
        most = np.minimum(bounds[np.minimum(band + 1, len(bounds) - 1)] - 1, size[sets] * 100 // bands.percent)  # of a partner's members
        differ = (size[sets] + most) * (100 - bands.percent) // (100 + bands.percent)
        some = (plan[band] > 0) & (differ > 0)  # else only equal sets link
        sets, band, differ = sets[some], band[some], differ[some]
        for cut in range(CUTS):
            if not len(sets):
                break
            lengths = size[sets]
            member = np.repeat(edges[sets] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            which, v = np.repeat(np.arange(len(sets)), lengths), values[member]
            if cut:  # another order of the members
                v = mix(v ^ U(0x9E3779B97F4A7C15 * cut % (1 << 64)))
                order = np.lexsort((v, which))
                v = v[order]
            part = ((v >> U(32)) * plan[band][which].astype(np.uint64)) >> U(32)
            begin = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (part[1:] != part[:-1])))
            content = np.add.reduceat(mix(v + U(0xA0761D6478BD642F)), begin)
            place = part[begin] * U(0xE7037ED1A0B428DB) + band[which[begin]].astype(np.uint64) * U(0x8EBC6AF09C88C6E3) + U(cut)
            keys.append(mix(content + mix(place)))
            of.append(nodes[sets[which[begin]]])
            few = np.bincount(which[begin], minlength=len(sets)) <= differ
            sets, band, differ = sets[few], band[few], differ[few]
        # hardly ever (tiny sets whose members lie in one part of every cut): one key for all of a band's
        keys.append(mix(mix(band.astype(np.uint64) * U(0x8EBC6AF09C88C6E3))))
        of.append(nodes[sets])
    return np.concatenate(keys).view(np.int64), np.concatenate(of)


def shared_keys(batches):
    """From rows (key, node) sorted by both: rows (key, node, centre) of keys with two nodes or more, each once.
    Streams with one row held back, so a key may have any number of rows."""
    held = None  # key, node, centre, does it have a match
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            key, node = np.append(held[0], key), np.append(held[1], node)
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node = key[fresh], node[fresh]
        first = np.append(True, key[1:] != key[:-1])
        centre = node[np.flatnonzero(first)][np.cumsum(first) - 1]
        matched = ~first
        matched[:-1] |= ~first[1:]
        before = ~first
        if held is not None:
            same = key == held[0]
            centre = np.where(same, held[2], centre)
            matched[0] |= held[3]
            before[0] |= held[3]
        held = (key[-1], node[-1], centre[-1], bool(before[-1]))
        out = np.flatnonzero(matched[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, node, centre)], names=["key", "node", "centre"])
    if held is not None and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:3]], names=["key", "node", "centre"])


def bitmap(values: np.ndarray, per_member: int) -> bytes:
    """Bits of hashed members; as many as per_member for each, rounded up to a power of two."""
    bits = min(MOST_BITS, max(64, 1 << int(per_member * len(values) - 1).bit_length()))
    at = mix(values + U(0x2545F4914F6CDD1D)) & U(bits - 1)
    table = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(table, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return table.tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one tile at their smallest width: the upper half of a wider one is or-ed onto the lower."""
    width = min(map(len, maps)) // 8
    out = np.zeros((len(maps), width), np.uint64)
    for i, m in enumerate(maps):
        t = np.frombuffer(m, np.uint64)
        out[i] = np.bitwise_or.reduce(t.reshape(-1, width), axis=0)
    return out


def tile_pairs(side: np.ndarray, label: np.ndarray, size: np.ndarray, maps: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (i, js, bounds on their Jaccard similarity) of the pairs of a tile that the bitmaps can't rule out and
    that no component joins yet. side 0 and 1 are the blocks, 2 a block against itself."""
    left = np.flatnonzero(side != 1)
    right = left if (side == 2).any() else np.flatnonzero(side == 1)
    for k, i in enumerate(left):
        js = right[k + 1 :] if right is left else right
        js = js[(label[js] != label[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
        if not len(js):
            continue
        a, b = maps[i], maps[js]
        most = np.minimum(size[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), size[js] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        union = size[i] + size[js] - most
        ok = 100 * most >= percent * union
        if ok.any():
            yield int(i), js[ok], most[ok] / union[ok]


def _marked(own: pa.Table, percent: int) -> list[np.ndarray]:
    """(key, node) of the rows of a tile that are in any pair."""
    label, n, side = (own[c].to_numpy() for c in ("label", "n", "side"))
    hit = np.zeros(len(n), bool)
    for i, js, _ in tile_pairs(side, label, n, folded(own["bits"].to_pylist()), percent):
        hit[i] = True
        hit[js] = True
    return [own["key"].to_numpy()[hit], own["node"].to_numpy()[hit]]


def _proposed(own: pa.Table, percent: int) -> list[np.ndarray]:
    """(key, node, its partner with the highest bound, that bound) of the rows of a tile that have one."""
    node, label, n, side = (own[c].to_numpy() for c in ("node", "label", "n", "side"))
    best, bound = np.full(len(n), -1), np.zeros(len(n))
    for i, js, bounds in tile_pairs(side, label, n, folded(own["bits"].to_pylist()), percent):
        k = int(bounds.argmax())
        if bounds[k] > bound[i]:
            best[i], bound[i] = js[k], bounds[k]
        up = bounds > bound[js]
        best[js[up]], bound[js[up]] = i, bounds[up]
    has = best >= 0
    return [own["key"].to_numpy()[has], node[has], node[best[has]], bound[has]]


def _remaining(own: pa.Table, percent: int) -> list[np.ndarray]:
    """(a, b) of all pairs of a tile."""
    node, label, n, side = (own[c].to_numpy() for c in ("node", "label", "n", "side"))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, js, _ in tile_pairs(side, label, n, folded(own["bits"].to_pylist()), percent):
        a.append(np.minimum(node[i], node[js]))
        b.append(np.maximum(node[i], node[js]))
    return [np.concatenate(a), np.concatenate(b)]


def _tiles(percent: int, judge, names: tuple[str, ...]):
    """Rows (tile, side, key, node, label, n, bits) sorted by tile -> what judge finds in each. A tile has about 2 * BLOCK rows."""

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in _and_none(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            tile = table["tile"].to_numpy()
            cut = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            ends = np.append(cut[1:], len(tile))
            done = len(cut) if batch is None else len(cut) - 1
            found = [judge(table.slice(s, e - s), percent) for s, e in zip(cut[:done].tolist(), ends[:done].tolist(), strict=True) if e - s > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=list(names))
            held = table.slice(int(cut[done])).to_batches() if done < len(cut) else []

    return compare


def _and_none(batches):
    yield from batches
    yield None


def _bounded(percent: int):
    """Rows (a, b, a_n, b_n, a_bits, b_bits) -> (a, b) of pairs that size and bitmaps can't rule out."""

    def work(batches):
        for batch in batches:
            a, b, a_n, b_n, a_bits, b_bits = (c.to_pylist() for c in batch.columns)
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                maps = folded([a_bits[i], b_bits[i]])
                label, size = np.array([0, 1]), np.array([a_n[i], b_n[i]])
                keep[i] = any(True for _ in tile_pairs(np.array([2, 2]), label, size, maps, percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    return work


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b), a saved table, that are linked, by exact intersection of their sorted arrays. Only texts that a bit filter
    of the pairs' nodes lets through are shuffled; the joins behind it decide."""
    some = {x: IdFilter(pairs.select(x), x).keep(texts.select("node", "text"), "node", lambda batches: batches, "node long, text string") for x in "ab"}
    a, b = (some[x].select(F.col("node").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")

    def intersect(batches):
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, first = np.unique(np.append(x, y), return_index=True)
            both = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first))
            members = [values[s:e] for _, values, edges in shingle_sets(both, n) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            keep = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(np.searchsorted(nodes, x), np.searchsorted(nodes, y), strict=True)):
                p, q = members[p], members[q]
                if len(p) and len(q):
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    shared = int((q[at] == p).sum())
                    keep[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    full = joined_by_share(joined_by_share(pairs, b, "b", "a"), a, "a", "b", counted=pairs).select("a", "b", "a_text", "b_text")
    return saved(full.mapInArrow(intersect, "a long, b long"), name, batch_rows=1000)


def _mixed(keyed: DataFrame, labels: DataFrame, signed: DataFrame, turn: int = 0) -> DataFrame:
    """Rows (key, node, label, main, centre, mains, rests) of the keys (key, node) that lie in more than one component:
    main is the component with most nodes of the key, mains are its nodes there, rests the others, centre is one of
    its nodes, another one each turn. Keys of the same nodes get one new key, a hash of the nodes (two of one hash
    would only make larger tiles).

    What is to know of a key is aggregated in every task first and joined back in SALTS parts, so that no task has
    all rows of a key.
    """
    known = signed.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    placed = keyed.join(known, "node")  # a node has no more keys than members
    # a node is counted once for each key
    by_label = placed.groupBy("key", "label").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("pick"))
    keys = by_label.groupBy("key").agg(F.max(F.struct("c", "label", F.col("pick.node").alias("centre"))).alias("most"), F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.count("*").alias("labels"))
    keys = keys.where("labels > 1").select("key", F.xxhash64("c", "x").alias("group"), F.col("most.label").alias("main"), F.col("most.centre").alias("centre"), F.col("most.c").alias("mains"), (F.col("c") - F.col("most.c")).alias("rests"))
    mixed = joined_in_parts(placed, keys, "key", "node", how="inner")
    return mixed.select(F.col("group").alias("key"), "node", "label", "main", "centre", "mains", "rests")


def _in_tiles(keyed: DataFrame, labels: DataFrame, signed: DataFrame, bits: str) -> DataFrame:
    """Rows (tile, side, key, node, label, n, bits), dealt and sorted by tile, of the keys that lie in more than one
    component. Nodes are dealt to blocks by hash: blocks of the others are numbered first, those of the main component
    behind them, and these meet the others' blocks only. A key of up to BLOCK nodes is one tile."""
    small = F.col("mains") + F.col("rests") <= BLOCK
    counted = _mixed(keyed, labels, signed).select(
        "key",
        "node",
        "label",
        (~small & (F.col("label") == F.col("main"))).alias("is_main"),
        F.when(small, 1).otherwise(F.ceil(F.col("rests") / BLOCK)).cast("int").alias("rest_blocks"),
        F.when(small, 0).otherwise(F.ceil(F.col("mains") / BLOCK)).cast("int").alias("main_blocks"),
    )
    dealt = lambda blocks: F.pmod(F.xxhash64("node", "key"), F.greatest(blocks, F.lit(1))).cast("int")
    own = F.when(F.col("is_main"), F.col("rest_blocks") + dealt(F.col("main_blocks"))).otherwise(dealt(F.col("rest_blocks")))
    last = F.col("rest_blocks") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("main_blocks"))
    sides = counted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "key",
        "node",
        "label",
    )
    # one row of a node in a tile, dealt as the join needs them
    sides = sides.repartition("node").distinct()
    rows = sides.join(signed.select("node", "n", F.col(bits).alias("bits")), "node").select("tile", "side", "key", "node", "label", "n", "bits")
    return rows.repartition("tile").sortWithinPartitions("tile")


def _largest_keys(keyed: DataFrame) -> DataFrame:
    """Of the rows (key, node) one for each node, that of its key with most nodes. The nodes of a large group share many keys
    and mostly choose the same one."""
    counted = joined_in_parts(keyed, keyed.groupBy("key").agg(F.count("*").alias("c")), "key", "node", how="inner")
    return counted.groupBy("node").agg(F.max(F.struct("c", "key")).alias("most")).select("most.key", "node")


def _best_centres(candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node b and the centre a that it shares most keys with, of rows (node, centre)."""
    counted = candidates.groupBy("node", "centre").agg(F.count("*").alias("c"))
    return counted.groupBy("node").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b"))


def _star_links(pairs: DataFrame, signed: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b), a saved table, that are linked: short bitmaps first, then exact intersection."""
    both = pairs
    for x, y in ("ab", "ba"):
        both = joined_by_share(both, signed.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("short").alias(f"{x}_bits")), x, y, counted=pairs)
    pairs = both.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(_bounded(percent), "a long, b long")
    return _verified(saved(pairs, f"{name}-pairs"), texts, n, percent, f"{name}-links")


def _joined(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after more links: components of the labels that these join."""
    lifted = links
    for x in "ab":
        at = labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
        lifted = joined_in_parts(lifted, at, x, "b" if x == "a" else "a", how="left").withColumn(f"{x}_to", F.coalesce(f"{x}_label", x)).drop(f"{x}_label")
    top = components(lifted.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")), name).select(F.col("node").alias("label"), F.col("label").alias("top"))
    # nodes that had no label yet are their own
    known = labels.unionByName(top.select(F.col("label").alias("node"), "label").join(labels, "node", "left_anti"))
    return saved(joined_in_parts(known, top, "label", "node", how="left").select("node", F.coalesce("top", "label").alias("label")), f"{name}-labels")


def join_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two rows link if 100 * |A & B| >= percent * |A | B| of their sets of lower-cased word n-grams. Null and
    empty texts, and those without words, have the empty set and link with nothing. Equal texts always
    link; rows that repeat are rows of one component. A null id is never a component's name unless all
    of its ids are null. An empty table gives an empty result; further columns are ignored. Sets are
    compared by 64-bit hashes of n-grams and known by a 64-bit hash of their members. With `text_hash` the
    rows also have the hash of their text (xxhash64), so that rows of one id can be told apart.
    """
    with interim(docs.sparkSession):
        found = saved(_join_components(docs, n, percent, id_col, text_col), "components", lasting=True)
    return found if text_hash else found.drop("text_hash")


def _join_components(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    bands = Bands(percent)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = rows.select("id", "text", F.xxhash64("text").alias("text_hash"))

    def sets(batches):
        for batch in batches:
            ids = [np.zeros(0, np.int64)]
            sizes = [np.zeros(0, np.int64)]
            for _, values, edges in shingle_sets(batch.column(1), n):
                ids.append(node_ids(values, edges))
                sizes.append(np.diff(edges))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), batch.column(2)], names=["id", "node", "n", "text_hash"])

    def keys(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, values, edges in shingle_sets(batch.column(1), n):
                nodes = node_ids(values, edges)
                size = np.diff(edges)
                fresh = np.zeros(len(nodes), bool)
                for i, node in enumerate(nodes.tolist()):
                    if size[i] and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                keep = np.repeat(fresh, size)
                key, node = part_keys(values[keep], np.append(0, np.cumsum(size[fresh])), nodes[fresh], bands)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    def named(batches):
        for batch in batches:
            nodes = np.concatenate([np.zeros(0, np.int64), *[node_ids(values, edges) for _, values, edges in shingle_sets(batch.column(0), n)]])
            at = np.unique(nodes, return_index=True)[1]
            at = at[nodes[at] != 0]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), batch.column(0).take(pa.array(at))], names=["node", "text"])

    def signatures(batches):
        for batch in batches:
            for first, values, edges in shingle_sets(batch.column(1), n):
                sets_of = [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets_of)), pa.array([len(v) for v in sets_of], pa.int64()), *[pa.array([bitmap(v, bits) for v in sets_of], pa.binary()) for bits in (SHORT, LONG)]],
                    names=["node", "n", "short", "long"],
                )

    table = saved(hashed.mapInArrow(sets, f"id {kind}, node long, n long, text_hash long"), "sets")
    groups = saved(rows.mapInArrow(keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared_keys, "key long, node long, centre long"), "groups")
    stars = saved(_best_centres(groups.where("node <> centre")), "stars")
    involved = groups.select("node").distinct()
    heads = saved(table.where("n > 0").groupBy("node").agg(F.min("id").alias("head")).join(involved, "node", "left_semi"), "heads")
    # only texts of ids that head a node sharing a key move from here on; as rows of one id may have other texts, each text's node is made again
    near = IdFilter(heads, "head").keep(rows.select("text", "id"), "id", named, "node long, text string")
    texts = saved(near.repartition("node").dropDuplicates(["node"]), "texts")
    signed = saved(texts.mapInArrow(signatures, "node long, n long, short binary, long binary"), "signatures")

    labels = components(_star_links(stars, signed, texts, n, percent, "star"), "stars")
    keyed = groups.select("key", "node")
    for turn in range(MORE_STARS):
        mixed = saved(_mixed(keyed, labels, signed, turn).distinct(), f"mixed-{turn}")
        keyed = mixed.select("key", "node")  # the others never get a partner, as components only grow
        stars = saved(_best_centres(mixed.where("label <> main").select("node", "centre")), f"stars-{turn}")
        if not stars.take(1):
            break
        linked = _star_links(stars, signed, texts, n, percent, f"star-{turn}")
        if linked.take(1):
            labels = _joined(labels, linked, f"star-joined-{turn}")

    marked = _in_tiles(keyed, labels, signed, "short").mapInArrow(_tiles(percent, _marked, ("key", "node")), "key long, node long")
    keyed = saved(marked.distinct(), "marked")
    turn = 0
    while turn <= ROUNDS:
        # the first round looks at each node's largest key alone: a group's nodes meet once, not in every key that they share
        tiles = _in_tiles(saved(_largest_keys(keyed), "largest") if turn == 0 < ROUNDS else keyed, labels, signed, "long")
        if turn < ROUNDS:
            each = saved(tiles.mapInArrow(_tiles(percent, _proposed, ("key", "a", "b", "bound")), "key long, a long, b long, bound double"), f"proposals-{turn}")
            if turn:
                keyed = each.select("key", F.col("a").alias("node")).distinct()  # the others never get a partner, as components only grow
            pairs = each.groupBy("a").agg(F.max_by("b", F.struct("bound", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = tiles.mapInArrow(_tiles(percent, _remaining, ("a", "b")), "a long, b long").distinct()
        pairs = saved(pairs, f"pairs-{turn}")
        some = bool(pairs.take(1))
        if not some and turn:
            break
        linked = _verified(pairs, texts, n, percent, f"links-{turn}") if some else pairs
        if some and linked.take(1):
            labels = _joined(labels, linked, f"joined-{turn}")
            turn += 1
        elif turn == 0:  # other keys may have more
            turn = 1
        else:  # the same partners would be proposed again: all remaining pairs are next
            turn = max(ROUNDS, turn + 1)

    # components get their names node by node, so that rows of a hot text or group meet them in parts
    tops = labels.select("node", F.col("label").alias("top"))
    least = table.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("c"))
    topped = least.join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    names = topped.groupBy("top").agg(F.min("least").alias("name"), F.sum("c").alias("rows")).where("rows > 1").drop("rows")
    named_nodes = saved(joined_in_parts(topped.select("node", "top"), names, "top", "node", how="inner").select("node", "name"), "names")
    full = joined_in_parts(table, named_nodes, "node", "id", how="left")
    return full.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"), "text_hash")
