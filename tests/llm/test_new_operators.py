"""Substring dedup, embedding whitening and cross-tokenizer alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwork.llm import alignment, relative_lz
from siftwork.llm.queries import vocabulary
from siftwork.llm.whitening import fit, whiten


def plain_repeats(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rng, window, n=60):
    """Texts that share passages, edited copies, rotating words, and edge cases."""
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 60))
    shared = [[word() for _ in range(rng.randint(window, 3 * window))] for _ in range(4)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 5, window, 4 * window]))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(shared))
            a = rng.randint(0, len(p) // 2)
            p = p[a : a + rng.randint(window // 2, len(p))]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited" + str(i)
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(900, None), (901, ""), (902, " \n  "), (903, "ab " * 3 * window), (904, "x y " * window), (None, docs[3][1]), (None, docs[4][1]), docs[5], docs[5], (906, "é 日本 " * window)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("window,hot,fold,block", [(6, 4096, 1 << 20, 1 << 21), (6, 2, 50, 200), (35, 3, 1 << 20, 2000), (2, 4096, 64, 100)])
def test_relative_parsing(spark, monkeypatch, window, hot, fold, block):
    monkeypatch.setattr(relative_lz, "HOT_RUNS", hot)
    monkeypatch.setattr(relative_lz, "FOLD_RUNS", fold)
    monkeypatch.setattr(relative_lz, "BLOCK_BYTES", block)
    docs = passages(random.Random(window + hot), window)
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, row string, n int").repartition(5)
    got = relative_lz.remove_repeated_words(df, window=window)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == plain_repeats(docs, window)
    for r in got.collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(relative_lz, "PIECE_WORDS", 64)
    docs = passages(random.Random(8), 10, n=30)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = relative_lz.remove_repeated_words(df, window=10).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_repeats(docs, 10)


def test_factors_equal_plain_windows():
    rng = np.random.default_rng(4)
    for _ in range(40):
        stretches = [rng.integers(0, 3, rng.integers(1, 40)) for _ in range(rng.integers(1, 12))]
        w = int(rng.integers(1, 9))
        of, start = relative_lz.repeated_starts(np.concatenate(stretches), np.cumsum([len(s) for s in stretches]), w)
        seen = Counter(tuple(s[i : i + w]) for s in stretches for i in range(len(s) - w + 1))
        want = {(k, i) for k, s in enumerate(stretches) for i in range(len(s) - w + 1) if seen[tuple(s[i : i + w])] > 1}
        assert set(zip(of.tolist(), start.tolist(), strict=True)) == want


def test_nothing_repeats(spark):
    assert relative_lz.remove_repeated_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_whitening(rows, components=32):
    """Rows that count, exact deviations, values and components by a full decomposition."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    return kept, n, deviation, y, e[::-1][:components], u[:, ::-1][:, :components]


@pytest.mark.parametrize("shape", ["flat", "steep", "low"])
def test_whitening(spark, shape):
    rng = np.random.default_rng(6)
    d = 50
    x = rng.standard_normal((400, d)).astype(np.float32)
    if shape == "steep":  # a few strong directions: the range finder's basis is enough
        x = (rng.standard_normal((400, 5)) * [90, 70, 50, 40, 30] @ rng.standard_normal((5, d))).astype(np.float32)
    if shape == "low":
        x[:, 20:] = 0.5
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    rows += [(None, rows[0][1]), rows[1], (900, None), (901, [None, *rows[2][1][1:]]), (902, [float("nan")] * d), (903, [*rows[3][1][1:], float("inf")])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, component string").repartition(5)
    kept, n, deviation, y, e, u = plain_whitening(rows)
    real = e > e[0] * 1e-12
    got = defaultdict(list)
    found = whiten(df).collect()
    for r in found:
        got[r.vec_id].append(r)
    m = int(real.sum())
    assert len(found) == len(kept) * m
    want_dev = defaultdict(list)
    for (i, _), v in zip(kept, deviation, strict=True):
        want_dev[i] += [v] * m
    assert {i: sorted(v) for i, v in want_dev.items()} == {i: sorted(r.deviation for r in v) for i, v in got.items()}
    trace = float((y * y).sum() / n)
    # values of 10 magnitudes are as exact as doubles allow
    assert all(r.n == n and r.identity_error < (1e-4 if shape == "steep" else 1e-8) for r in found)
    for c in range(m):
        assert [r.explained for r in found if r.component == c + 1] == pytest.approx([e[c] / trace] * len(kept), rel=1e-4 if shape == "steep" else 1e-9)
    # one sign for all rows of a component; values of unlike size only, as equal ones have no direction of their own
    of = {i: k for k, (i, _) in enumerate(kept)}
    for c in range(m if shape == "flat" else min(m, 5)):
        w = {r.vec_id: r.whitened for r in found if r.component == c + 1}
        want = y @ u[:, c] / math.sqrt(e[c])
        plus = max(abs(w[i] - want[of[i]]) for i in of if i is not None)
        minus = max(abs(w[i] + want[of[i]]) for i in of if i is not None)
        assert min(plus, minus) < 1e-6


def test_whitening_expands_if_residuals_fail(spark):
    rng = np.random.default_rng(1)
    flat = spark.createDataFrame([(i, [float(c) for c in rng.standard_normal(50)]) for i in range(200)], "vec_id long, embedding array<float>")
    assert fit(flat, components=8).expanded
    strong = rng.standard_normal((200, 3)) * [50, 40, 30] @ rng.standard_normal((3, 50))
    low = spark.createDataFrame([(i, [float(round(c)) for c in r]) for i, r in enumerate(strong)], "vec_id long, embedding array<float>")
    assert fit(low, components=50, oversampling=0).values[0] > 0


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).count() == 0  # no variance
    got = whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0, 1.0])], schema)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1)}
    big = whiten(spark.createDataFrame([(1, [1e9, 1.0]), (2, [-1e9, 0.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in big} == {1, 2} and {r.deviation for r in big} == {None}


def plain_alignment(docs):
    """The contract word for word: token bytes, shared ends, all pairs of a group, counts over all rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in keep} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in keep)}
    a_bytes = lambda i: bytes(back[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    every = []
    for d, t in docs:
        groups = []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            if b"".join(map(a_bytes, x)) == b"".join(map(b_bytes, y)) == (" " + t).encode():
                ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, x), (b_bytes, y))]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cuts]
                for side, ids in enumerate((x, y)):
                    for i, e in zip(ids, ends[side], strict=True):
                        groups[next(k for k, c in enumerate(cuts) if e <= c)][side].append(i)
        every.append((d, groups))
    count = Counter(p for _, groups in every for p in {(i, j) for xs, ys in groups for i in xs for j in ys})
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for d, groups in every:
        pairs = [(i, j) for xs, ys in groups for i in xs for j in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), digest))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "one two", "one  two", "  one\ttwo \n three  ", "line\n\nnext line\n", "▁", "x ▁ y", "<s> </s> <unk> <0x41> <|endoftext|>",
    "don't we'll  I'm 'S", "12345 67,89.0%", "naïve café 日本語 русский", "\U0001f600\U0001f601 ok‍️", "a b c 　d", "\x00\x01 \x7f\x85 z", "é ﬁn", "zzzzzzzzzzzzzzzzzzzzzzzz " * 9,
    " " * 300, "\n" * 90 + "end", "q" * 700, "राम " * 20, "\r\n a\r\nb", "A\x1cB \x1d C", "tab\t tab", "᠎ x᠎ y ᠎z", "ǅ ẞ Ⅰ ²½",
]


def alignment_docs(rng):
    word = lambda: "".join(rng.choice("theronsaliub") for _ in range(rng.randint(1, 9)))
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    docs += [(100 + i, rng.choice([" ", "  ", "\n", ". "]).join(word() for _ in range(rng.randint(1, 80)))) for i in range(60)]
    docs += [(None, "one two"), (7, "one two"), docs[-1], docs[-1]]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("wide,block,held,units", [(1 << 12, 1 << 21, 1 << 21, 300_000), (4, 300, 40, 20)])
def test_alignment(spark, monkeypatch, wide, block, held, units):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    monkeypatch.setattr(alignment, "MOST_UNITS", units)
    docs = alignment_docs(random.Random(wide))
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, row string, pair int").repartition(4)
    got = alignment.align(df, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == plain_alignment(docs)
    for r in got.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_blocks_of_workers(monkeypatch):
    """A table that is emptied again and again, and coding by either library, give the same."""
    docs = alignment_docs(random.Random(9))
    texts = [t for _, t in docs]
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    whole, other = alignment.Aligner(*paths), alignment.Aligner(*paths)
    assert whole.a.ranks is not None
    other.a.ranks = None
    stats, groups, *_ = whole.look_up(texts)
    monkeypatch.setattr(alignment, "MOST_UNITS", 5)
    for i, t in enumerate(texts):
        s, g, *_ = other.look_up([t])
        assert g[0] == groups[i] and s[0].tolist() == stats[i].tolist()


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 0
