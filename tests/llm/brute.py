"""Plain versions of the operators for small inputs."""

import base64
import collections
import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, n=4):
    w = SPACE_WORD.findall(lower(t or ""))
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(docs, n=4, percent=85):
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        names.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(docs)]


def contamination(docs, items, size):
    windows = collections.defaultdict(set)
    for name, t in items:
        w = ALNUM_WORD.findall(lower(t or ""))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if name is None else str(name))
    out = []
    for d, t in docs:
        w = ALNUM_WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def decontaminated(docs, items, size, most):
    """id -> text without hit words, for those of which at most `most` of the words are hit."""
    windows = set()
    for _, t in items:
        w = ALNUM_WORD.findall(lower(t or ""))
        n = min(size, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    out = {}
    for d, t in docs:
        found = list(ALNUM_WORD.finditer(lower(t or "")))
        w = [m[0] for m in found]
        hit = {k + i for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for i in range(n)}
        if len(hit) > most * len(w):
            continue
        if hit:
            parts, at = [], 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    end = k
                    while end + 1 in hit:
                        end += 1
                    parts.append(t[at : found[k].start()].encode().rstrip())
                    at = found[end].end()
            t = b" ".join([*parts, t[at:].encode().lstrip()]).decode().strip()
        out[d] = t
    return out


def archives(rows):
    payloads = [(h or "").encode() for _, _, h in rows]
    ids = collections.defaultdict(list)
    for (i, _, _), p in zip(rows, payloads, strict=True):
        ids[p].append(i)
    out = []
    for (i, _, _), p in zip(rows, payloads, strict=True):
        known = [x for x in ids[p] if x is not None]
        head = max(known) if known and len(ids[p]) > 1 else None
        revisit = head is not None and i is not None and head != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return out


def base_counts(t):
    t = t or ""
    w = SPACE_WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def repeats(docs, depth):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each (id, text), null ids first."""
    seen, out = set(), {}
    for has, d, t in sorted({(d is not None, d or 0, t or "") for d, t in docs}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i : i + depth]
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(d if has else None, t)] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
