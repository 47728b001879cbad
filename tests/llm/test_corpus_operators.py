"""Operators that compare documents or pages with each other, and the pipeline."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import components, decontaminated, repeats
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwork.llm import html_extract, ngram_join, suffix_dedup, suffix_sort, url_filter
from siftwork.llm._spark import BATCH_BYTES, joined_by_share, saved
from siftwork.llm._spark import components as spark_components
from siftwork.llm.packing import pack
from siftwork.llm.queries import op2_html_extraction, vocabulary


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def near_copies(rng):
    docs = []
    for _ in range(8):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.choice([3, 8, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 40))):
                x[rng.randrange(len(x))] = rng.choice("QRSTUV") + str(rng.randint(0, 99))
            docs.append((len(docs) * 3, " ".join(x)))
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (None, "one"), docs[0], docs[0]]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("rounds,block", [(3, 512), (0, 3)])
def test_join_components(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = near_copies(random.Random(3 + rounds))
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, node string, n int").repartition(5)
    assert sorted(map(tuple, ngram_join.join_components(df).collect()), key=str) == sorted(components(docs), key=str)


def test_join_of_ids_with_several_texts(spark):
    """Rows of a null id and of one id with different texts keep the links of their own texts."""
    rng = random.Random(11)
    docs = []
    for i in range(12):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(60)]
        copy = [*base[:30], "changed", *base[31:]]
        docs += [(None if i % 2 else 7, " ".join(base)), (None if i % 3 else 7, " ".join(copy)), (100 + i, " ".join([*base, "more"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.join_components(df).collect()), key=str) == sorted(components(docs), key=str)
    near = spark.createDataFrame([d for d in docs if d[0] is None or d[0] == 7], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.join_components(near).collect()), key=str) == sorted(components([d for d in docs if d[0] is None or d[0] == 7]), key=str)


def test_tiles_meet_all_components(spark, monkeypatch):
    """Every pair of nodes of different components of a key meets in a tile; a large component's nodes meet the others only."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    labels = {node: 0 if node < 600 else node for node in range(640)}  # one large component and 40 single nodes
    signed = spark.createDataFrame([(node, 5, b"\0" * 8) for node in labels], "node long, n long, short binary")
    keyed = spark.createDataFrame([(7, node) for node in labels] + [(8, node) for node in range(20)] + [(9, node) for node in range(590, 610)], "key long, node long")
    known = spark.createDataFrame([x for x in labels.items() if x[1] == 0], "node long, label long")
    rows = ngram_join._in_tiles(keyed, known, signed, "short").collect()
    tiles: dict[int, list] = {}
    for r in rows:
        tiles.setdefault(r["tile"], []).append(r)
    met = set()
    for tile in tiles.values():
        assert len(tile) <= 4 * 32
        left = [r for r in tile if r["side"] != 1]
        right = left if any(r["side"] == 2 for r in tile) else [r for r in tile if r["side"] == 1]
        met |= {(min(a["node"], b["node"]), max(a["node"], b["node"])) for a in left for b in right}
    assert all((a, b) in met for a in labels for b in range(max(a + 1, 600), 640))
    # 600 nodes meet 2 blocks, 40 meet 2 + 19, and the key 9 is one tile; all of 20 blocks would be 12,800 rows
    assert len(rows) == 600 * 2 + 40 * 21 + 20
    assert len({r["key"] for r in rows}) == 2


@pytest.mark.parametrize("rows", [5, 512])
def test_join_by_share(spark, rows):
    many = spark.createDataFrame([(0, i) for i in range(40)] + [(i % 7 + 1, i) for i in range(20)], "k long, s long")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k long, v string")
    for counted in (None, many):
        got = joined_by_share(many, one, "k", "s", counted=counted, rows=rows).select("k", "s", "v").collect()
        assert sorted(map(tuple, got)) == sorted((k, s, f"v{k}") for k, s in map(tuple, many.collect()) if k < 6)


def test_join_of_nothing(spark):
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cuts", [8, 1])
def test_part_keys_meet_for_every_link(monkeypatch, cuts):
    """Sets at the threshold share a key, over all sizes, further cuts included."""
    monkeypatch.setattr(ngram_join, "CUTS", cuts)
    rng = np.random.default_rng(1)
    bands = ngram_join.Bands(85)
    met = 0
    for size in [*range(6, 30), 47, 100, 333, 900]:
        for _ in range(60):
            drop = int(rng.integers(0, size // 6 + 1))
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1))
            b = np.unique(np.append(a[rng.permutation(size)[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, size // 7 + 1)), dtype=np.uint64)))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter) and len(a) + len(b) > 2 * inter:
                keys, nodes = ngram_join.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.array([1, 2]), bands)
                assert len(np.intersect1d(keys[nodes == 1], keys[nodes == 2]))
                met += 1
    assert met > 400


def test_unrelated_sets_share_no_keys():
    """Key pairs of sets without common members stay at none when the number of sets doubles."""
    rng = np.random.default_rng(4)
    bands = ngram_join.Bands(85)
    for n_sets in (2000, 4000):
        size = np.append(rng.integers(60, 1500, n_sets // 2), rng.integers(1, 60, n_sets // 2))
        edges = np.append(0, np.cumsum(size))
        values = rng.integers(0, 1 << 63, edges[-1], dtype=np.uint64) << np.uint64(1)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            values[a:b].sort()
        keys, nodes = ngram_join.part_keys(values, edges, np.arange(n_sets), bands)
        pairs = np.unique(np.stack([keys, nodes]), axis=1)
        assert len(np.unique(pairs[0])) == pairs.shape[1]
        assert len(keys) < 0.5 * len(values)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, int(rng.integers(1, 60)), dtype=np.uint64)) for _ in range(2))
        inter = len(np.intersect1d(a, b))
        maps = ngram_join.folded([ngram_join.bitmap(a, 1), ngram_join.bitmap(b, 8)])
        found = list(ngram_join.tile_pairs(np.array([2, 2]), np.array([0, 1]), np.array([len(a), len(b)]), maps, 50))
        if 100 * inter >= 50 * (len(a) + len(b) - inter):
            assert found and found[0][2][0] >= inter / (len(a) + len(b) - inter) - 1e-9


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.randint(0, rng.choice([1, 2, 3, 256])) for _ in range(rng.randint(1, 60))] + [0], np.int16)
        sa = suffix_sort.suffix_array(t, 100).tolist()
        padded = [t.tolist()[i:] + [0] * 100 for i in range(len(t))]
        assert sorted(sa) == list(range(len(t)))
        assert all(padded[a][:100] <= padded[b][:100] for a, b in zip(sa, sa[1:], strict=False))


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(150):
        depth = rng.choice([3, 5, 8])
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        seen, want, base = set(), [], 0
        for s in strings:
            for i in range(len(s) - depth + 1):
                if s[i : i + depth] in seen:
                    want.append(base + i)
                seen.add(s[i : i + depth])
            base += len(s) + 1
        assert suffix_sort.repeated_windows(strings, depth).tolist() == want


@pytest.mark.parametrize("depth,hot", [(100, 4096), (30, 2), (20, 2)])
def test_remove_repeats(spark, monkeypatch, depth, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rng = random.Random(depth)
    line = "".join(rng.choice("abcdef ü") for _ in range(int(depth * 1.5)))
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(depth - 2, 3 * depth))) for _ in range(6)]
    docs = []
    for i in range(50):
        parts = [rng.choice([*passages, line, line, line, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, depth))), "a" * rng.randint(0, 2 * depth)]) for _ in range(rng.randint(0, 6))]
        docs.append((i * 2, "".join(parts)))
    docs += [(500 + i, docs[i][1]) for i in range(20)] + [(900, None), (901, ""), (None, "abc"), docs[3], docs[3]]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, text string, tag string, n int").repartition(6)
    got = suffix_dedup.remove_repeats(df, depth=depth, carry=("tag",)).collect()
    want = repeats(docs, depth)
    texts = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id, texts[r.doc_id] or "")]
        assert r.tag == "clash"


@pytest.mark.parametrize("length", [100, 150])
def test_no_task_holds_a_common_passage(spark, monkeypatch, length):
    """A passage inside more texts than HOT_RUNS, each with other surroundings."""
    most, arrays = suffix_dedup.HOT_RUNS, suffix_dedup._suffix_arrays

    def counted(depth):
        def work(batches):
            held = {}

            def watched():
                for batch in batches:
                    for key in batch.column(0).to_pylist():
                        held[key] = held.get(key, 0) + 1
                        assert held[key] <= most, "one task holds all rows of a key"
                    yield batch

            yield from arrays(depth)(watched())

        return work

    monkeypatch.setattr(suffix_dedup, "_suffix_arrays", counted)
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = word(length)
    docs = [(i, word(80) + passage + word(80)) for i in range(most + 400)] + [(None, "x" + passage), (9999, passage[:100] + passage[-100:])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    want, texts = repeats(docs, 100), dict(docs)
    assert len(got) == len(docs)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id, texts[r.doc_id])] for r in got)


def test_windows_of_dealt_rows(spark, monkeypatch):
    """Few and many different rows of a key, equal ones among them, give what a plain scan gives."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 3)
    rng = random.Random(5)
    rows = []
    for key, size in ((1, 2), (2, 3), (3, 40)):
        for i in range(size):
            n = rng.randint(1, 8)
            rows.append((key, rng.randint(-3, 30), (len(rows) << 8) * 16 + n, bytes(rng.choice([2 * key, 2 * key + 1]) for _ in range(n + 9))))
    seen, want = set(), set()
    for key, i, p, d in sorted(rows, key=lambda r: r[1:3]):
        for s in range(p % 256):
            if d[s : s + 10] in seen:
                want.add((i, (p >> 8) + s))
            seen.add(d[s : s + 10])
    df = spark.createDataFrame([(k, i, p, bytearray(d)) for k, i, p, d in rows], "key long, id long, place long, bytes binary").repartition(3)
    got = [(r.id, (r.place >> 8) + s) for r in suffix_dedup._hot_ranges(df, 10).collect() for s in range(r.n)]
    assert set(got) == want


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_cut_without_loss():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    pieces = list(suffix_dedup._pieces(pa.array([text, "b" * 150]), 100))
    assert len(pieces) > 3
    starts = np.concatenate([np.concatenate([np.arange(lo + base, lo + base + n) for lo, n in zip(*suffix_dedup.runs(buf, off, 100, 24)[3:5], strict=True)]) for first, buf, off, base in pieces if first == 0 and len(off) == 2])
    assert np.array_equal(np.sort(starts), np.arange(3_000_000 - 99))


def test_templates_find_unnamed_articles(spark):
    rows = []
    for i in range(12):
        article = "".join(f"<p>Paragraph {i} {j} with some text about topic {i * j} and more words follow here.</p>" for j in range(4))
        rows.append((i, f"http://a.x/{i}", f'<html><body><div class="top"><a href=1>Home</a></div><div class="x1"><h1>T{i}</h1><div class="share">Share {i}</div>{article}<div class="notice">Read our terms.</div><div class="box">From our own desk.</div></div><div class="comments"><p>user {i}: great</p></div><div class="right">Other {i}</div></body></html>'))
    rows += [
        (100, None, None),
        (101, "http://b/", "<p>only<p>one &amp; two&nbsp;x"),
        (102, "b", ""),
        (103, "http://c.d", '<article>x <script>var a="</p>";</script>z<!-- c --> w<'),
        (104, "http://a.x/zz", "<html><body><article>Different &lt;b&gt; page<ul><li>one<li>two</ul></article><form>f</form></body></html>"),
        (104, "http://a.x/zz", "<html><body><article>Different &lt;b&gt; page<ul><li>one<li>two</ul></article><form>f</form></body></html>"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i in range(12):
        # what is equal on all pages of a host stays inside the article, unless its name tells it
        assert got[i].split("\n") == [f"T{i}", *[f"Paragraph {i} {j} with some text about topic {i * j} and more words follow here." for j in range(4)], "From our own desk."]
    assert (got[100], got[101], got[102], got[103], got[104]) == ("", "only\none & two x", "", "x z w<", "Different <b> page\none\ntwo")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_articles_in_sibling_blocks(spark):
    """Heading and lead beside the body, and an article in two blocks, are read whole."""
    words = lambda i, j, n: " ".join(f"w{i}x{j}x{k}" for k in range(n))
    top = '<div class="top"><a href=1>Home</a></div><div class="x9">'
    rows, want = [], {}
    for i in range(12):
        parts = [words(i, 0, 3), words(i, 1, 10), words(i, 2, 80)]
        rows.append((i, f"http://lead.x/{i}", f'<html><body>{top}<div class="post"><h1 class="t">{parts[0]}</h1><div class="lead">{parts[1]}</div><div class="body"><p>{parts[2]}</p></div></div></div></body></html>'))
        want[i] = "\n".join(parts)
        parts = [words(i, 3, 60), words(i, 4, 40)]
        rows.append((100 + i, f"http://split.x/{i}", f'<html><body>{top}<div class="one">{parts[0]}</div><div class="two">{parts[1]}</div></div></body></html>'))
        want[100 + i] = "\n".join(parts)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def built_page(rng, words, n_parts, equal):
    """A page and its article's text: heading, byline, parts and a section line between a menu and a footer. `equal`: the
    lines that are the same on all pages of the host."""
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))
    title, parts = sentence(), [sentence() for _ in range(n_parts)]
    byline, section = equal
    body = "".join(f"<p>{x}</p>" for x in parts)
    html = (
        f'<html><body><div class="bar"><ul><li><a href="/a">Start</a></li><li><a href="/b">World</a></li></ul></div><div class="page"><article><h1>{title}</h1><div class="byline">{byline}</div>'
        f'<div class="body">{body}</div><div class="where">{section}</div></article></div><div class="foot">All rights with the house, {rng.randint(0, 1)}</div></body></html>'
    )
    return html, "\n".join([title, byline, *parts, section])


@pytest.mark.parametrize("n_pages", [3, 4, 5, 8, 12, 40])
def test_texts_of_built_sites(spark, n_pages):
    """Texts are those that the pages were built from, lines that are equal on all pages of a host included, however many it has."""
    rng = random.Random(n_pages)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, want = [], {}
    for host, equal in (("one", ("By Jane Roe", "World news section")), ("two", ("Our own writer in the north of the country, for this house", "Licence: free for all to use, as long as the name stays with it"))):
        for i in range(n_pages):
            html, text = built_page(rng, words, rng.randint(1, 6), equal)
            rows.append((len(rows), f"http://{host}.example/{i}", html))
            want[rows[-1][0]] = text
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_hosts_of_identical_pages(spark):
    """Copies of one article under different URLs keep their text; a notice on varying pages goes, and what never varies around the article."""
    article = " ".join(f"word{k}" for k in range(90))
    rows = [(i, f"http://same.x/{i}", f'<html><body><article class="a"><p>{article}</p></article></body></html>') for i in range(9)]
    rows += [(100 + i, f"http://slot.x/{i}", f'<html><body><div class="content"><p>{article}</p></div><div class="right">Seen {i}</div></body></html>') for i in range(12)]
    rows += [(200 + i, f"http://vary.x/{i}", f'<html><body><article class="a"><p>{i} {article}</p><div class="notice">Read our terms.</div></article><div class="box">Seen by all.</div></body></html>') for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == article for i in range(9))
    assert all(article in got[100 + i] for i in range(12))
    assert all(got[200 + i] == f"{i} {article}" for i in range(12))


def article_of(source, tag="article"):
    import html
    import re

    inner = re.search(f"<{tag}[^>]*>(.*?)</{tag}>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op2_html_extraction(spark, sf_dir).collect():
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


def without_names(spark, sf_dir):
    """The table's pages with all telling tags made divs and class names that differ from host to host, some hosts without."""
    import re

    out = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        host, source = url_filter.split_url(r.url)[0], r.html
        for i, part in enumerate(("nav", '(?:div class="ad")', "article", "footer")):
            label = f' class="{"".join(random.Random(host + part).choices("bcdfgkmz", k=6))}"' if len(host) % 3 else ""
            source = re.sub(f"<{part}>", f"<div{label} data-part={i}>", source)
        out.append((r.page_id, r.url, re.sub("</(nav|article|footer)>", "</div>", source), article_of(r.html)))
    return out


def test_template_decides_without_names(spark, sf_dir):
    """Without telling tags and names the classes find the article; without a template all of the page is read."""
    rows = without_names(spark, sf_dir)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = {r[0]: r[3] for r in rows}
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    many = {h for h, n in Counter(url_filter.split_url(r[1])[0] for r in rows).items() if n >= 3}
    compared = {r[0] for r in rows if url_filter.split_url(r[1])[0] in many}
    assert len(compared) >= 10 and all(got[i] == want[i] for i in compared)
    assert all(html_extract.read_slots(r[2], None) != want[r[0]] for r in rows)


def plain_templates(pages):
    """Content tokens of a host by real occurrence vectors, read with the library's parser: chains of (tag, class)."""
    from html.parser import HTMLParser

    counts, texts = defaultdict(lambda: [0] * len(pages)), defaultdict(lambda: [""] * len(pages))
    linked = Counter()

    class Reader(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.page, self.open = page, [()]
            counts[()][page] += 1

        def handle_starttag(self, tag, attrs):
            token = (*self.open[-1], (tag, dict(attrs).get("class", "")))
            counts[token][self.page] += 1
            self.open.append(token)

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            for i in range(len(self.open[-1]) + 1):
                texts[self.open[-1][:i]][self.page] += data
                linked[self.open[-1][:i]] += len(data) * any(t == "a" for t, _ in self.open[-1])

    for i, source in enumerate(pages):
        Reader(i).feed(source)
    frequent = {t: tuple(v) for t, v in counts.items() if 2 * sum(map(bool, v)) >= len(pages)}
    place = lambda t: next((t[:i] for i in range(len(t) - 1, -1, -1) if frequent[t[:i]] != frequent[t]), None)
    parts = Counter((v, place(t)) for t, v in frequent.items())
    valid = [t for t, v in frequent.items() if parts[v, place(t)] > 1 and max(v) == 1 and (not t or t[-1][0] in ("html", "body", "div"))]
    fixed = {t for t, v in frequent.items() if t and max(v) == 1 and sum(v) >= 0.8 * len(pages) and len({x for x, n in zip(texts[t], v, strict=True) if n}) == 1}
    varying = lambda t: sum(map(len, texts[t])) - linked[t] - sum(sum(map(len, texts[f])) for f in fixed if f[: len(t)] == t and not any(f[:i] in fixed for i in range(len(f))))
    headed = {t[:i] for t in frequent if t and t[-1][0] == "h1" for i in range(len(t))}
    return max((t for t in valid if varying(t) >= (0.7 if t in headed else 0.9) * varying(()) and 2 * linked[t] <= sum(map(len, texts[t]))), key=lambda t: (t in headed and len(t) > 2, len(t), varying(t)))


def test_templates_equal_plain_classes(spark):
    """Vectors kept as sums give the content slot that real vectors give, on random nested layouts."""
    for seed in range(25):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))  # noqa: E731, B023
        name = [word() for _ in range(12)]
        depth, where = rng.randint(0, 3), rng.randint(0, 1)
        pages = []
        for i in range(rng.randint(8, 20)):
            menu = f'<div class="{name[0]}">' + "".join(f'<div class="{name[1]}"><a href="x">{word()}</a></div>' for _ in range(rng.randint(1, 4))) + "</div>"
            note = f'<div class="{name[2]}">Read our terms of use.</div>' if rng.random() < 0.97 or i < 4 else ""
            body = "".join(f"<p>{' '.join(word() for _ in range(30))}</p>" for _ in range(rng.randint(1, 5)))
            inner = f'<div class="{name[3]}"><h1>{word()}</h1>{note * where}{body}</div>'
            for d in range(depth):
                inner = f'<div class="{name[4 + d]}">{inner}</div>'
            pages.append(f'<html><body>{menu}{note * (1 - where)}{inner}<div class="{name[10]}">{word()}</div></body></html>')
        want = plain_templates(pages)
        sums: dict = {}
        for i, p in enumerate(pages):
            for t in html_extract.page_tokens(p, weight=rng.getrandbits(38)):
                sums.setdefault(t.token, []).append(t)
        merged = [ts[0]._replace(pages=len(ts), **{f: sum(getattr(t, f) for t in ts) for f in ("total", "text", "links", "plain")}, vector=sum(t.vector for t in ts) % (1 << 38), low=min(t.low for t in ts), high=max(t.high for t in ts), texts=-1) for ts in sums.values()]
        frequent = [t for t in merged if 2 * t.pages >= len(pages)]
        content = html_extract.deduce(frequent).content
        by_id = {t.token: t for t in frequent}
        chain, at = [], by_id[next(iter(content))]
        while at.token != html_extract.ROOT:
            tag, _, label = at.label.partition(".")
            chain.insert(0, (tag, label))
            at = by_id[at.parent]
        assert len(content) == 1 and tuple(chain) == want, seed


def test_equal_pages_keep_their_text(spark):
    """However many copies of a page a host has, and whatever the element is called."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = []
    for copies in (1, 2, 4, 5, 6, 40):
        for kind in ("<article>|</article>", '<div class="content">|</div>', '<div class="qxz">|</div>'):
            page = kind.replace("|", f"<p>{text}</p>")
            rows += [(f"http://h{copies}{len(kind)}.x/{i}", f"<html><body>{page}</body></html>") for i in range(copies)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {text}


def test_names_and_broken_markup():
    """Names tell other parts only as a whole; quotes are read as HTML does; slashes in names do no harm."""
    keep = ['<div class="share price">T</div>', '<div class="ad-hoc">T</div>', '<h2 class="related">T</h2>', '<section id="comments-on-law">T</section>', '<div class="w-1/2">T</div>', "<p title=it's>T</p>", '<p title="a>b">T</p>', "<p title='a>b' x=\"'\">T</p>", "<p\ntitle = 'x'>T</p>"]
    drop = ['<div class="share">T</div>', '<div class="comment-list">T</div>', '<div id="comments">T</div>', "<div class=adSlot>T</div>", '<aside>T</aside>', "<form>T</form>", '<div role="navigation">T</div>', "<script>T</script x>", "<style>T</style>", "<!-- > T -->", "<svg><text>T</text></svg>"]
    for part in keep:
        assert html_extract.main_text(f"<html><body><article><h1>Head</h1><p>{'word ' * 40}</p>{part}</article></body></html>", ()).endswith("\nT"), part
    for part in drop:
        assert html_extract.main_text(f"<html><body><article><h1>Head</h1><p>{'word ' * 40}</p>{part}</article></body></html>", ()).endswith("word"), part
    assert html_extract.main_text('<p title="x>Hello</p>', ()) == "Hello"
    assert html_extract.main_text("<a href=it's>Hello</a>", ()) == "Hello"
    assert html_extract.main_text("<p>a<!-->b<!--->c</p><svg/>d<svg>e</svg>f", ()) == "abc\ndf"


def test_long_and_deep_pages():
    deep = "<div>" * 30_000 + "text" + "</div>" * 30_000
    assert html_extract.main_text(deep, ()) == "text"
    assert html_extract.main_text("<b>" * 30_000 + "text", ()) == "text"
    many = "".join(f'<p class="c{i}">paragraph number {i}</p>' for i in range(60_000))
    assert html_extract.main_text(f"<body><div>{many}</div></body>", ()).count("\n") == 59_999


def test_pipeline_stages(spark, sf_dir):
    """Each stage against brute force over what it was given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).toArrow())
        rows = kept.collect()
        if name == "language":
            assert kept.columns == docs.columns and {r.doc_id for r in rows} == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _, c in components(sorted(before.items()), n=5, percent=80) if d == c)
        elif name == "repeated_passages":
            removed = repeats(list(before.items()), 100)
            for r in rows:
                n_bytes, gone, _, _ = removed[(r.doc_id, before[r.doc_id])]
                assert 0 <= n_bytes - gone - len(r.text.encode()) <= 6 * (gone > 0) * (gone + 1)
            assert {d for d, t in before.items() if removed[(d, t)][1] == 0} <= {r.doc_id for r in rows}
        elif name == "benchmark_passages":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            want = decontaminated(list(before.items()), items, 10, 0.5)
            assert {r.doc_id: r.text for r in rows} == want and any(want.get(d) != t for d, t in before.items())
        else:
            library = Tokenizer.from_file(vocabulary())
            pieces = defaultdict(list)
            for r in rows:
                pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
            assert set(pieces) == set(before)
            for d, text in before.items():
                ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
                for start, length, crc in sorted(pieces[d]):
                    assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
                    at += length
                assert at == len(ids)


def test_one_id_with_several_texts_in_the_pipeline(spark, sf_dir):
    """A row stays by its own component: the second text of an id does not bring back its first."""
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (None, b + " more"), (7, a + " more"), (9, None), (9, ""), (None, "other " + " ".join(map(str, range(60))))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (5, b), (9, None), (9, ""), rows[-1]], key=str)


def test_pipeline_stages_with_further_columns(spark, sf_dir):
    """Further columns stay with their rows whatever their names; null ids and an empty table pass."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["id", "tag", "n_removed", "spans", "kept", "others", "carried", "row", "_key", "_again", "a b"]
    first = docs.collect()[0]
    docs = docs.unionAll(spark.createDataFrame([(None, first.text + " and some other words at its end", first.lang, first.source, 1), (None, first.text, first.lang, first.source, 2)], docs.schema))
    wide = docs.select(*[F.concat_ws("|", F.lit(n), F.col("text").substr(1, 5)).alias(n) for n in names[:5]], "*", *[F.struct(F.lit(n).alias("x y"), F.col("lang")).alias(n) for n in names[5:]])
    got = []
    for table in (docs, wide, wide.limit(0)):
        kept = table = spark.createDataFrame(table.toArrow(), table.schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = spark.createDataFrame(stage(spark, kept, sf_dir).toArrow(), table.schema)
            assert kept.columns == table.columns, name
        got.append(kept.collect())
        assert (pack(kept, vocabulary()).count() > 0) == bool(got[-1])
    plain, rows, none = ([(r.doc_id, r.text, r.n_chars) for r in x] for x in got)
    assert plain and sorted(plain, key=str) == sorted(rows, key=str) and none == []
    assert all(r[n] == (n, r.lang) for r in got[1] for n in names[5:]) and all(r[n].split("|")[0] == n for r in got[1] for n in names[:5])


def test_first_proposals_are_one_a_node(spark, monkeypatch):
    """Near copies that share many keys propose within one of them; the chain of small changes is one component all the same."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    docs = []
    for i in range(40):
        for at in rng.sample(range(200), 3):
            words[at] = f"w{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    sizes, real = {}, ngram_join.saved

    def counted(df, name, *args, **more):
        out = real(df, name, *args, **more)
        if name == "proposals-0":
            sizes["first"] = (out.count(), out.select("a").distinct().count())
        return out

    monkeypatch.setattr(ngram_join, "saved", counted)
    found = ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string"), n=5, percent=80).collect()
    rows, nodes = sizes["first"]
    assert nodes and rows == nodes
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in docs]
    top = list(range(40))
    for i in range(40):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(top))


def test_saved_tables_bound_arrow_batches(spark):
    rows = spark.range(0, 12000, 1, 1).select("id", F.repeat(F.lit("x"), 2000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = saved(rows.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in got) == 12000
    assert max(r["size"] for r in got) < 1.1 * BATCH_BYTES
    assert spark.conf.get(key) == before
    narrow = saved(rows.select("id").mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert max(r.n for r in narrow) == int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_suffix_arrays_hold_little(spark):
    rng = np.random.default_rng(3)
    rows = [(key, key * 3 + i, (5 << 39) + 81, rng.bytes(180)) for key in range(4000) for i in range(3)]  # 2.2 MB
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "id", "place", "bytes"])
    tracemalloc.start()
    found = sum(b.num_rows for b in suffix_dedup._suffix_arrays(100)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found
    assert peak < 100e6
