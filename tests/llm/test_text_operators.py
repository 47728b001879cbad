"""Row-level operators: counts, quality, URLs, languages, contamination."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import archives, base_counts, contamination

from siftwork.llm import decontaminate, langid, packing, quality, queries, tokens, url_filter, warc
from siftwork.llm.histogram_packing import shortest_pack_first

ODD = [None, "", " \n\t", "a", "Ünïcode ÀÉ 漢字 x", "<|endoftext|>Hi<|startoftext|>'s don't 12 3a", "A" * 5000, "x\x1cy \x85 z　q", "İ ΑΣ ² Ⅷ", "#*$ |<> \n l \n l \n\n", "the " * 300]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 1) for i, t in enumerate(ODD)] + [(1, "twice", None, None, None, None), (1, "twice", None, None, None, None), (None, "no id", "en", "s", None, 2)], "doc_id long, text string, lang string, source string, key string, n long")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_counts_equal_the_library(spark):
    t, docs = library(), odd_docs(spark)
    texts = [r.text or "" for r in docs.collect()]
    got = tokens.count_tokens(docs, queries.vocabulary(), 100).collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 100) for x in texts]
    assert tokens.count_tokens(docs.limit(0), queries.vocabulary(), 1).count() == 0


def test_merging_counts_by_rank():
    rank = {("a", "b"): 0, ("ab", "ab"): 2, ("b", "a"): 1}
    assert tokens.merged_count(list("abab"), rank) == 1
    assert tokens.merged_count(list("bab"), rank) == 2
    assert tokens.merged_count(list("ccc"), rank) == 3


def test_counts_on_table(spark, sf_dir):
    t = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.n_tokens == len(t.encode(docs[r.doc_id], add_special_tokens=False).ids) for r in queries.op6_token_counts(spark, sf_dir).collect())


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_covers_every_id_once(spark, capacity):
    t, docs = library(), odd_docs(spark).repartition(3)
    got = packing.pack(docs, queries.vocabulary(), capacity, 2).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    crc = Counter((d, s, len(x[s : s + capacity]), zlib.crc32(x[s : s + capacity].tobytes()), len(x)) for d, xs in ids.items() for x in xs for s in range(0, len(x), capacity))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == crc
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert packing.pack(docs.limit(0), queries.vocabulary(), capacity, 2).count() == 0


def test_coding_sees_each_run_of_a_batch_once():
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return super().get(key, default)

    rng, t = random.Random(3), library()
    signs = [*"aZ9'.<|é\u0301\u0307ΑΣςİIK\u212a\u1100\u1161漢😀²\x00\x1c\x85\xa0\u3000", *" \n\t\v\f\r", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll"]
    texts = [*ODD, *["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(2000)], " ".join(["w" * 100, "ΣΑΣ", "x"] * 5000)]
    coder = packing.Coder(queries.vocabulary())
    coder.runs = Counted()
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts(pa.array(texts))] == want
    runs = {r for x in texts for r in (x or "").encode().split()}
    assert Counted.looked <= 2 * (len(runs) + 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts(pa.array(texts).slice(3, 500))] == want[3:503]
    assert list(coder.texts(pa.array([], pa.string()))) == [] and list(coder.texts(pa.array([None], pa.string()))) == [b""]


def test_histogram_packing():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.randint(5, 60)
        h = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        packs = shortest_pack_first(h, capacity)
        assert all(sum(p) <= capacity for _, p in packs)
        assert Counter({n: c for n, c in h.items() if c}) == sum((Counter({n: k * c for n, k in Counter(p).items()}) for c, p in packs), Counter())
    with pytest.raises(ValueError):
        shortest_pack_first({9: 1}, 8)


def test_base_counts(spark, sf_dir):
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "key")
    for got, text in zip(quality.judge_quality(docs).orderBy("n_words", "word_chars").collect(), sorted((r.text for r in docs.collect()), key=lambda x: base_counts(x)[:2]), strict=True):
        assert tuple(got)[1:3] == base_counts(text)[:2]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_quality_rules(spark, sf_dir).collect():
        counts = base_counts(texts[r.doc_id])
        assert tuple(r)[1:6] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = verdicts(docs, quality.Rules())
    assert {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, sf_dir).collect() if not r.base_failed} == want


def test_sketches_merge_and_bound_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.lognormvariate(0, 2) if rng.random() < 0.9 else 0.0) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    from pyspark.sql import functions as F

    parts = [quality.sketch(df.where(F.col("x") * 1000 % 2 < 1), ["g"], ["x"]), quality.sketch(df.where(F.col("x") * 1000 % 2 >= 1), ["g"], ["x"])]
    merged = parts[0].unionAll(parts[1]).groupBy("g", "measure", "bucket").agg(F.sum("n").alias("n"))
    for r in quality.quantiles(merged, ["g"], [0.5, 0.95]).collect():
        xs = sorted(x for g, x in rows if g == r.g)
        for q, got in ((0.5, r.q0), (0.95, r.q1)):
            want = xs[math.ceil(q * len(xs)) - 1]
            assert abs(got - want) <= 0.011 * want + 1e-9


def verdicts(rows, rules):
    """kept of each (id, text, lang, source) by exact counts in the same buckets, and the thresholds of each group."""
    counts = {i: (*base_counts(t), (t or "").count("\n") + 1 if t is not None else 0) for i, t, _, _ in rows}
    parts = {"symbol_ratio": (2, 0), "dup_line_ratio": (3, 5), "repeat_ratio": (4, 0), "word_length": (1, 0)}
    good = [r for r in rows if counts[r[0]][0] >= rules.min_words and 100 * counts[r[0]][4] <= rules.max_repeat_percent * counts[r[0]][0]]
    limits, ends = {}, {}
    for name, more in rules.ratios:
        a, b = parts[name]
        for group in {r[2:] for r in good}:
            found = []
            for same in (lambda r: r[2:] == group, lambda r: r[2] == group[0], lambda r: True):  # noqa: B023
                xs = sorted((counts[r[0]][a] + more) / max(counts[r[0]][b] + more, 1) for r in good if same(r))
                edges = [math.ceil(math.log(x) / math.log(quality.GAMMA)) if x > 0 else None for x in xs]
                found.append((len(xs), *(0.0 if e is None else quality.GAMMA**e * 2 / (1 + quality.GAMMA) for e in (edges[math.ceil(q * len(xs)) - 1] for q in rules.quantiles))))
            low, high = found[2][1:]
            for n, q0, q1 in (found[1], found[0]):
                low, high = ((n * q + rules.prior * x) / (n + rules.prior) for q, x in ((q0, low), (q1, high)))
            ends[group, name] = low, high, found[0][0]
    bucket = lambda x: quality.GAMMA ** math.ceil(math.log(x) / math.log(quality.GAMMA)) * 2 / (1 + quality.GAMMA) if x > 0 else 0.0
    for (group, name), (low, high, _) in ends.items():
        spreads = sorted(bucket(h - x) for (_, m), (x, h, n) in ends.items() if m == name for _ in range(n))
        limits[group, name] = high * (1 + quality.GAMMA) / 2 + rules.reach * max(high - low, spreads[math.ceil(0.5 * len(spreads)) - 1])
    fails = lambda r: any(counts[r[0]][parts[n][0]] / max(counts[r[0]][parts[n][1]], 1) > limits[r[2:], n] * (1 + 1e-6) for n, _ in rules.ratios)
    return {r[0]: not fails(r) for r in good}, limits


def quality_rows():
    """Two sources of one language, one writing with symbols and one without, one of another language, and small ones."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, n)))
    rows = []
    for source, lang, n, symbols in (("plain", "en", 60, 0.0), ("code", "en", 60, 0.3), ("plain", "de", 40, 0.05), ("few", "en", 4, 0.0), (None, None, 5, 0.0), ("lone", "xx", 3, 0.5)):
        for i in range(n):
            rate = symbols * rng.uniform(0.5, 1.5) if i % 12 else 1.2 * (i % 24 > 0)
            words = [word(14 if lang == "de" else 9) + "$" * (rng.random() < rate) for _ in range(rng.randint(60, 300))]
            lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
            rows.append((len(rows), "\n".join(lines + lines[:1] * (i % 5 == 0) * 8), lang, source))
    return rows + [(9000, None, "en", "plain"), (9001, "", "en", "code"), (9002, "short text", None, None)]


def test_thresholds_come_from_the_groups(spark):
    """Groups differ in their thresholds, and the verdicts are those of exact quantiles."""
    rows, rules = quality_rows(), quality.Rules()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, symbol_ratio string").repartition(5)
    got = {r.doc_id: r for r in quality.judge_quality(df, rules).collect()}
    want, limits = verdicts(rows, rules)
    assert len(got) == len(rows) and {i for i, r in got.items() if not r.base_failed} == set(want)
    assert {i: got[i].kept for i in want} == want and 0 < sum(want.values()) < len(want)
    for name, _ in rules.ratios:
        assert len({round(limits[g, name], 6) for g in (("en", "plain"), ("en", "code"), ("de", "plain"))}) >= 2 + (name == "symbol_ratio")
    # a rate that is usual in one source is none in the other
    high = [r for r in rows if r[3] == "code" and got[r[0]].kept and got[r[0]].n_symbols / got[r[0]].n_words > limits[("en", "plain"), "symbol_ratio"]]
    assert high
    moved = [(i, t, "en", "plain") if (i, t, g, s) in high[:2] else (i, t, g, s) for i, t, g, s in rows]
    again = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(moved, "doc_id long, text string, lang string, source string"), rules).collect()}
    assert not any(again[r[0]] for r in high[:2])


def test_verdicts_do_not_jump_with_the_size_of_a_group(spark):
    """Ordinary texts of equal length stay in groups of any size, and one with symbols goes in each."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6)))
    rows = []
    for n in (1, 5, 19, 20, 21, 60):
        for i in range(n):
            rows.append((len(rows), " ".join(word() for _ in range(120)), "fr", f"s{n}"))
        rows.append((10_000 + n, " ".join(word() + "$" * (k % 2) for k in range(120)), "fr", f"s{n}"))
    got = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept == (i < 10_000) for i, kept in got.items())


def test_quality_of_nothing_and_of_equal_texts(spark):
    df = spark.createDataFrame([(i, "word another " * 3 + " ".join(f"w{k}" for k in range(60)), "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string")
    assert quality.judge_quality(df.limit(0)).count() == 0
    assert {r.kept for r in quality.judge_quality(df).collect()} == {True}
    assert {r.kept for r in quality.judge_quality(df.limit(1)).collect()} == {True}


def test_url_automaton_equals_rules(spark):
    hosts = ["a.example.com", "example.com", "COM", "xcom", "net", "b.net", "example.net", "q.org", "", "e.org.x"]
    paths = ["/en/7", "/en/", "/en", "/de/8x", "/de/9", "/es/", "", "/x/en/7", "/en/7.com/en/"]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#f")] + [None, "", "no scheme", "http://", "://x.com/en/", "a://b://com/en/", "http://ü.com/en/" + "z" * 5000, "http://é\udcff".encode("utf-8", "ignore").decode()]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in url_filter.judge_urls(df, url_filter.RULES).collect():
        host, path = url_filter.split_url(urls[r.page_id])
        fits = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.text, best.verdict if best else "allow")


def test_urls_of_nothing(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_automaton_over_many_words():
    globs = [f"p{i}*x{i}**" for i in range(40)]
    a = url_filter.WildcardAutomaton(globs)
    assert a.words > 2
    got = a.matches([b"p7abcx7/rest", b"p7a/x7", b"p39x39", b"", b"p1x1p2x2"])
    assert [np.flatnonzero(r).tolist() for r in got] == [[7], [], [3, 39], [], [1]]


def ppm_bits(text, training):
    counts = defaultdict(Counter)
    for x in training:
        for k in range(langid.ORDER + 1):
            for i in range(k, len(x)):
                counts[x[i - k : i]][x[i]] += 1
    total = 0.0
    for i, b in enumerate(text):
        for k in range(min(langid.ORDER, i), -1, -1):
            seen = counts.get(text[i - k : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if b in seen:
                    total += math.log2((n + d) / seen[b])
                    break
                total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    training = {"a": [b"abracadabra alakazam", b"abba"], "b": [b"bonjour le monde", "été".encode()]}
    m = langid.Model(["a", "b"], [langid.count_contexts(x) for x in training.values()])
    texts = [b"abracadabra", b"x", b"", b"bonjour abba zz", b"qqq!", "été à".encode()]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [[ppm_bits(t, x) for x in training.values()] for t in texts]
    assert np.allclose(m.lengths(buf, off), want, rtol=1e-4)


def test_languages_held_out(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_languages_of_odd_texts(spark):
    docs = odd_docs(spark)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs.where("doc_id <> 1"), model).collect()}
    for i, t in enumerate(ODD):
        if i != 1:
            none = t is None or not any(c.isalpha() for c in t)
            assert (got[i].lang_pred == "und") == none and 0 <= got[i].score <= 1
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.accept(docs, model).columns == docs.columns


def test_languages_learn_from_rows(spark):
    """Rows of one id, of a null id and rows that repeat teach as rows of different ids do, each text once."""
    texts = [(f"le chat {i} dort sur la chaise rouge", "fr") for i in range(30)] + [(f"the cat {i} sleeps on the red chair", "en") for i in range(30)]
    test = spark.createDataFrame([(1, "la chaise du chat"), (2, "a chair for the cat")], "doc_id long, text string")
    made = lambda rows: langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    for rows in ([(7, t, g) for t, g in texts], [(None, t, g) for t, g in texts], [(i, t, g) for i, (t, g) in enumerate(texts)]):
        once, again = made(rows), made(rows * 4)
        assert [r.lang_pred for r in langid.identify(test, once).orderBy("doc_id").collect()] == ["fr", "en"]
        assert langid.identify(test, once).collect() == langid.identify(test, again).collect()
    few = langid.train(spark.createDataFrame([(i % 2, t, g) for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string"), docs_per_language=5)
    assert few.languages == ["en", "fr"]


def test_one_payload_on_many_pages(spark):
    """Copies of one payload, null ids among them, all refer to the largest id."""
    rows = [(i, f"http://a/{i}", "<p>gone</p>") for i in range(3000)] + [(None, "http://a/x", "<p>gone</p>"), (5000, None, None), (5001, "http://b", "")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), least_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(archives(rows), key=str)


def test_contamination(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abC") for _ in range(n))
    for sizes in ([3, 4, 6, 9], [0, 1, 2, 5, 12]):
        items = [(i, words(rng.choice(sizes))) for i in range(7)] + [(None, "x y z"), (99, None)]
        docs = [(i, words(rng.randint(0, 40))) for i in range(30)] + [(77, None), (78, "x,Y;z é")]
        found = decontaminate.find_contamination(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, items int"), spark.createDataFrame(items, "item_id long, text string"), 5)
        assert sorted(map(tuple, decontaminate.digest(found).collect())) == sorted(contamination(docs, items, 5))
    none = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in none.collect()} == {0}


@pytest.mark.parametrize("most", [24, 80])
def test_contamination_in_several_automata(spark, monkeypatch, most):
    """Parts of the items, and items cut in pieces, give what one automaton gives."""
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", most)
    rng = random.Random(most)
    words = lambda n: " ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(n))
    items = [(i, f"w{i} b c d{i} e") for i in range(5)] + [(10 + i, words(rng.randint(1, 30))) for i in range(6)]
    docs = [(1, "x w3 b c d3 e w1 b"), (2, "q w0 b c d0 e"), (3, None), (4, "")] + [(10 + i, words(60) + " " + rng.choice(items)[1] + " " + words(9)) for i in range(20)]
    df, tests = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _names int"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(df, tests, 3)
    assert sorted(map(tuple, decontaminate.digest(found).collect())) == sorted(contamination(docs, items, 3))
    parts = decontaminate.decontaminate(df, tests, 3, 0.9).collect()
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 10**6)
    assert sorted(parts) == sorted(decontaminate.decontaminate(df, tests, 3, 0.9).collect())


def test_automaton_of_many_words_is_small():
    """MAX_ITEM_WORDS words take under 300 MB, as random words and as repeated ones; wide states are right."""
    rng = np.random.default_rng(1)
    for vocabulary, n in ((10**6, 40_000), (30, 40_000), (2, 5_000)):
        pool = rng.integers(0, 1 << 63, vocabulary, dtype=np.uint64)
        items = [(f"i{k:03}", pool[rng.integers(0, vocabulary, n // 40)]) for k in range(40)]
        m = decontaminate.Matcher.build(items, 10)
        assert m.nbytes() * decontaminate.MAX_ITEM_WORDS / n < 300e6
        text = np.concatenate([pool[rng.integers(0, vocabulary, 500)], items[7][1][20:60], items[30][1][5:16], pool[rng.integers(0, vocabulary, 5)]])
        windows = defaultdict(set)
        for name, h in items:
            for k in range(len(h) - 9):
                windows[h[k : k + 10].tobytes()].add(name)
        want, names = np.zeros(len(text), bool), set()
        for k in range(len(text) - 9):
            if got := windows.get(text[k : k + 10].tobytes()):
                want[k : k + 10] = True
                names |= got
        hit, found = np.zeros(len(text), bool), {}
        m.mark(text, np.zeros(len(text), np.int64), hit, found)
        assert np.array_equal(hit, want) and found.get(0, set()) == names


def test_decontaminate_cuts_and_drops(spark):
    docs = spark.createDataFrame([(1, "keep this one two three four five and that with more words here"), (2, "one two three four five"), (3, None), (4, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two, three four five")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, 5).collect()}
    assert got == {1: "keep this and that with more words here", 3: None, 4: "clean"}


def test_archive_round_trip(spark):
    rows = [(1, "u", "a"), (2, "v", "a"), (3, None, None), (4, "x", ""), (5, "y", "ü\r\n\r\nz"), (5, "y", "ü\r\n\r\nz"), (None, "z", "a"), (9, "a b\r\nEvil: 1", "q" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(archives(rows), key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    few = warc.round_trip(df, least_revisit_bytes=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in few} == {"response"}


def test_bundles_seek(spark, tmp_path):
    import pyarrow.fs as fs
    import zstandard

    path = str(tmp_path / "b.warc.zst")
    w = warc.BundleWriter(open(path, "wb"), frame_bytes=300)
    records = [warc.record(i, f"http://h/{i}", b"x" * i, warc.digest_text(b"x" * i), None, "2024-01-01T00:00:00Z") for i in range(20)]
    places = [w.add(r) for r in records]
    w.close()
    r = warc.BundleReader(fs.LocalFileSystem().open_input_file(path))
    assert len(r.frames) > 2
    for i in (19, 0, 7):
        head, http, payload = r.record(*places[i])
        assert head["WARC-Record-ID"] == f"<urn:page:{i}>" and payload == b"x" * i
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)
