"""Main-text extraction by equivalence-class template deduction.

1. Tokens. A page is cut into elements; a token is an element's chain of tag names, classes and ids, and of
   the ordinal among its like where a division has neither. Its occurrence vector is its count on every page of the host. A vector is kept as its support (pages),
   its total and a sum of count * hash(page): these merge by addition, so a hot host is aggregated in
   every task first, and equal vectors have equal sums.
2. Classes. Frequent tokens of a host with one vector form an equivalence class. Classes nest: the place
   of a token is its nearest ancestor of another class, and tokens of one class at different places play
   different roles, so a class is divided by place. A part of two tokens or more is valid; the valid parts
   and the page itself are the template.
3. Slots. What lies in a template token and in no nested one is its slot. Text that is the same on all
   pages of the host has its element's vector and belongs to the template, not to a slot. The content slot is
   the deepest once-a-page token whose slots hold a varying heading and most of the varying text outside links,
   or else nearly all of that text. If the article's heading lies outside of it, it grows to the token that
   holds both, or the heading's own slot joins it.
4. Extraction. The text of the content slot is read from each page, block by block, without menus. Where the slot
   has grown around the one that was found, tokens of the template go there; inside the slot that was found,
   lines that are equal on all pages (a byline, a section's name) are the article's. Names tell only what vectors
   cannot: which parts inside the content slot are adverts, notices, forms or reader comments.
Hosts of few pages have no vectors to compare: their pages use the template of all pages together. Pages that
lack its content slot, or their own host's, and templates whose only slot is the whole page leave it to the
classes of the page alone.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import split_url

FREQUENT, MOST, NEARLY_ALL, MENU, COPIES = 0.5, 0.7, 0.9, 0.9, 0.1
DISTINCT_PAGES = 5  # different page texts that must agree before a text counts as the template's
FINGERPRINT_BITS = 38  # sums of 2**24 of them stay in a long
SALTS = 16  # parts of a hot host in joins
ROOT = 0  # the token of the page itself

ATTRIBUTES = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*+"""
TAG = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>script|style|textarea|title|iframe)(?=[\s/>]){ATTRIBUTES}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRIBUTES})>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag that ends an open element of these names, up to the given barrier.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that may be a slot of their own.
CONTAINERS = frozenset("address article aside center details div dl fieldset figure footer header main menu nav ol section table td ul".split())
#: Elements that are told apart by their place among their like if they have no class and no id.
NUMBERED = frozenset(["div", "section"])
HEADINGS = frozenset(["h1", "h2", "h3"])
NOT_TEXT = frozenset("nav footer aside form head select button menu dialog noscript template svg".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id names that tell parts other than the article, and words that go with them. A name tells
#: such a part only if it has a word of the first kind and none beside the two: "comment-list" does, "share price" doesn't.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar share sharing social comment comments respond discussion disqus replies reply related recommended newsletter subscribe subscription signup login search pagination pager".split()
)
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons center clearfix column container content default entry fixed flex form group header hidden holder icon icons inner item items layout left link links list main mobile module outer page panel post posts primary reader readers right row secondary section side site slot small sticky stories story strip text thread title top unit user users widget widgets wrap wrapper".split()
)
NAME_WORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+")
SPACE_RUN = re.compile(r"\s+")


def _other_name(name: str) -> bool | None:
    """Does one class or id name tell a part other than the article? None: it has words that say nothing on this."""
    found = {w.lower() for w in NAME_WORD.findall(name)}
    found = {w for w in found if len(w) > 2 or w in OTHER_WORDS}
    if not found <= OTHER_WORDS | PLAIN_WORDS:
        return None
    return bool(found & OTHER_WORDS)


@lru_cache(maxsize=4096)
def _element(name: str, attrs: str) -> tuple[bytes, bool]:
    """Label of an element (digits in names are per-page numbers more often than not), and whether it is named as another part."""
    classes, ids, role = [], [], ""
    if "=" in attrs:
        for k, v in ATTRIBUTE.findall(attrs):
            k = k.lower()
            if k in ("class", "id", "role"):
                v = html_lib.unescape(v.strip("\"'") if v[:1] in ("'", '"') else v)
                if k == "class":
                    classes = classes or v.split()
                elif k == "id":
                    ids = ids or v.split()
                else:
                    role = role or v.lower()
    label = "".join([name, *(f".{re.sub('[0-9]+', '0', x)}" for x in [*classes, *ids])])
    other = name in NOT_TEXT or role in ROLES
    if not other and name not in ("html", "body", "article", "main") and not (len(name) == 2 and name[0] == "h"):
        told = [_other_name(x) for x in classes]
        other = any(_other_name(x) for x in ids) or (any(told) and None not in told)
    return label.encode(), other


class Node(NamedTuple):
    name: str
    token: int
    parent: int
    label: bytes
    depth: int
    other: bool  # in a part other than the article, by name
    link: bool  # in a link
    article: bool  # in an element that articles are made of, whose header is no page header
    lineage: frozenset[int]  # wanted tokens (see events) that it is or lies in


def _node(name: str, attrs: str, parent: Node | None, wanted: frozenset[int], like: Counter[str]) -> Node:
    label, other = _element(name, attrs)
    if name in NUMBERED and len(label) == len(name):
        like[name] += 1
        label += b":%d" % like[name]
    up = parent.token if parent else ROOT
    token = xxhash.xxh64_intdigest(label, up & (2**64 - 1))
    token = (token - (token >> 63 << 64)) or 1
    inside = parent is not None and parent.article
    other = other or (parent is not None and parent.other) or (name == "header" and not inside)
    lineage = parent.lineage if parent else frozenset()
    if token in wanted:
        lineage = lineage | {token}
    return Node(name, token, up, label, parent.depth + 1 if parent else 1, other, name == "a" or (parent is not None and parent.link), inside or name in ("article", "main", "section"), lineage)


def events(source: str, wanted: frozenset[int] = frozenset()) -> Iterator[tuple[str, Node | None, str]]:
    """("open", node, "") for each element, ("text", innermost node, text), ("block", node, "") at block edges.

    Attributes are read as HTML does: a quote inside an unquoted value is a character. A value whose quote
    is never closed ends at the tag's first ">", so that the rest of the page is not lost.
    """
    stack: list[Node] = []
    likes: list[Counter[str]] = [Counter()]  # numbered children of the page and of each open element
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.name] -= 1
        del stack[i:]
        del likes[i + 1 :]

    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            yield "text", stack[-1] if stack else None, source[at : m.start()]
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if opened[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                close(i)
            if name in BLOCK:
                yield "block", stack[-1] if stack else None, ""
            continue
        names, barrier = IMPLIED.get(name, (frozenset(), frozenset()))
        if name in CLOSES_P:
            names, barrier = names | {"p"}, barrier | {"table", "td", "button"}
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in names:
                    close(i)
                    break
                if stack[i].name in barrier:
                    break
        if name in BLOCK:
            yield "block", stack[-1] if stack else None, ""
        if name in VOID:
            continue
        node = _node(name, m["attrs"], stack[-1] if stack else None, wanted, likes[-1])
        yield "open", node, ""
        if not (name == "svg" and m["attrs"].endswith("/")):
            stack.append(node)
            likes.append(Counter())
            opened[name] += 1
    if at < len(source):
        yield "text", stack[-1] if stack else None, source[at:]


class Token(NamedTuple):
    """What the pages of a host, or one page, say of a token. Sums and bounds merge, so they are made in every task."""

    token: int
    parent: int
    label: str
    depth: int
    pages: int
    total: int
    vector: int
    text: int  # characters in it
    links: int  # of them in links
    plain: int  # of them neither in links nor in parts named as other than the article
    low: int  # smallest and largest hash of a page's text in it
    high: int
    texts: int  # one bit of 64 for the page's text outside such parts
    other: bool


def page_tokens(source: str, weight: int = 1) -> list[Token]:
    """The tokens of one page, the page itself first."""
    sums: dict[int, list] = {ROOT: [ROOT, b"", 0, 1, 0, 0, 0, 0, False]}
    whole = 0
    for kind, node, text in events(source):
        if kind == "open":
            entry = sums.get(node.token)
            if entry is None:
                sums[node.token] = [node.parent, node.label, node.depth, 1, 0, 0, 0, 0, node.other]
            else:
                entry[3] += 1
        elif kind == "text" and (text := text.strip()):
            link, other = (node.link, node.other) if node else (False, False)
            entry, n, h = sums[node.token if node else ROOT], len(text), xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))
            entry[4] += n
            entry[5] += n * link
            entry[6] += n * (not link and not other)
            entry[7] += h
            whole += h * (not other)
    for token in reversed(list(sums)):  # parents were met first
        if token != ROOT:
            entry, up = sums[token], sums[sums[token][0]]
            for i in (4, 5, 6, 7):
                up[i] += entry[i]
    bit = 1 << (whole * 0x9E3779B1 >> 7 & 63)
    bit -= bit >> 63 << 64
    return [Token(t, e[0], e[1].decode("utf-8", "replace"), e[2], 1, e[3], e[3] * weight & (1 << FINGERPRINT_BITS) - 1, e[4], e[5], e[6], e[7] & 2**62 - 1, e[7] & 2**62 - 1, bit, e[8]) for t, e in sums.items()]


@dataclass(frozen=True)
class Template:
    content: frozenset[int]  # tokens whose text is the article
    dropped: frozenset[int]  # tokens inside them that are the template's own text, or menus
    whole: bool  # the slot is the whole page


def valid_tokens(tokens: Iterable[Token]) -> set[int]:
    """Tokens of valid classes: the classes are divided by place and have two tokens or more each."""
    by_id = {t.token: t for t in tokens}
    place, parts = {}, defaultdict(list)
    for t in sorted(by_id.values(), key=lambda t: t.depth):
        vector, up = (t.pages, t.total, t.vector), by_id.get(t.parent)
        same = up is not None and t.token != ROOT and (up.pages, up.total, up.vector) == vector
        place[t.token] = place[up.token] if same else t.parent
        parts[vector, place[t.token]].append(t.token)
    return {ROOT} | {t for part in parts.values() if len(part) > 1 for t in part}


def deduce(tokens: Iterable[Token], compared: bool = True) -> Template:
    """The template of pages with these frequent tokens; compared: there were enough pages to compare."""
    by_id = {t.token: t for t in sorted(tokens, key=lambda t: (t.depth, t.token))}
    root, order = by_id[ROOT], list(by_id.values())
    tag = {t.token: re.split(r"[.:]", t.label, maxsplit=1)[0] for t in order}
    once = {t.token for t in order if t.total == t.pages}
    valid = valid_tokens(order)

    # texts that never vary are the template's, unless the pages are copies of each other
    fixed = {t.token for t in order if compared and t.token in once and t.token != ROOT and t.low == t.high and t.texts.bit_count() >= DISTINCT_PAGES and t.pages >= 0.8 * root.pages}
    unvaried: Counter[int] = Counter()
    for t in reversed(order):
        if t.token in fixed:
            unvaried[t.token] = t.plain
        if t.token != ROOT:
            unvaried[t.parent] += unvaried[t.token]
    if root.plain - unvaried[ROOT] < COPIES * root.plain:
        fixed, unvaried = set(), Counter()
    varying = {t.token: t.plain - unvaried[t.token] for t in order}

    def above(token: int) -> list[int]:
        out = [token]
        while out[-1] != ROOT:
            out.append(by_id[out[-1]].parent)
        return out

    slots = [t for t in order if t.token in valid and t.token in once and (tag[t.token] in CONTAINERS or tag[t.token] in ("html", "body", "")) and not t.other]
    heads = [t for t in order if tag[t.token] in HEADINGS and varying[t.token] > 0 and 2 * t.links <= t.text and not t.other]
    headed = {a for t in heads for a in above(t.token)}
    holding = [t for t in slots if varying[t.token] > 0 and varying[t.token] >= (MOST if t.token in headed else NEARLY_ALL) * varying[ROOT] and 2 * t.links <= t.text]
    chosen = max([t for t in holding if t.token in headed and t.label not in ("html", "body", "")] or holding, key=lambda t: (t.depth, varying[t.token], t.token), default=root)

    def within(tokens: set[int]) -> set[int]:
        out = set(tokens)
        for t in order:  # parents come first
            if t.parent in out and t.token != ROOT:
                out.add(t.token)
        return out

    page_wide = {t for t in tag if tag[t] in ("html", "body", "")}
    content = {chosen.token}
    if chosen.token not in page_wide:
        below = within(content)
        around = [t for t in above(chosen.token)[1:] if t not in page_wide]
        if not any(t.token in below for t in heads):
            heads = [t for t in heads if t.token in once and t.token not in fixed]
            if heads:
                head = min(heads, key=lambda t: (tag[t.token], t.depth, t.token))
                over = set(above(head.token))
                both = next((t for t in around if t in over), None)
                content = {both} if both is not None else {chosen.token, head.token}
            else:  # no headings on this host: the widest token that adds more varying text than links
                gains = [t for t in around if varying[t] > varying[chosen.token] and by_id[t].links - chosen.links <= varying[t] - varying[chosen.token]]
                content = {gains[-1]} if gains else content
    size, below, over = sum(by_id[t].plain for t in content), within(content), {t for c in content for t in above(c)}
    below -= over
    inside = [t for t in order if t.token in valid and t.token in once and tag[t.token] in CONTAINERS and t.token in below]
    # what never varies is the template's around the slot that was found, but inside it a byline or a section's name is article
    own = within({chosen.token}) if chosen.token not in page_wide else set()
    dropped = {t.token for t in inside if (t.token in fixed and t.token not in own and 2 * t.plain < size) or (compared and t.links >= MENU * t.text > 0 and 2 * t.text < size)}
    return Template(frozenset(content), frozenset(dropped), bool(content & page_wide))


_FIELDS = Token._fields
_TYPES = dict(token="long", parent="long", label="string", depth="int", pages="long", total="long", vector="long", text="long", links="long", plain="long", low="long", high="long", texts="long", other="boolean")


def token_vectors(pages: DataFrame) -> DataFrame:
    """Mergeable occurrence vectors per (host, token) of rows (url, html)."""
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def count(batches):
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, source = split_url(url)[0], source or ""
                weight = xxhash.xxh64_intdigest(f"{url} {source}".encode("utf-8", "surrogatepass")) >> (64 - FINGERPRINT_BITS)
                for t in page_tokens(source, weight):
                    s = sums.get((host, t.token))
                    if s is None:
                        sums[host, t.token] = list(t)
                        continue
                    for i in (4, 5, 6, 7, 8, 9):
                        s[i] += t[i]
                    s[10], s[11] = min(s[10], t.low), max(s[11], t.high)
                    s[12] |= t.texts
            mask = (1 << FINGERPRINT_BITS) - 1
            for s in sums.values():
                s[6] &= mask
            columns = list(zip(*((k[0], *s) for k, s in sums.items()), strict=True)) or [[]] * (len(_FIELDS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *(arrow[_TYPES[f]] for f in _FIELDS)], strict=True)], names=["host", *_FIELDS])

    return _merged(pages.select("url", "html").mapInArrow(count, "host string, " + ", ".join(f"{f} {_TYPES[f]}" for f in _FIELDS)), "host", "token")


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "text", "links", "plain")]
    one = [F.min(c).alias(c) for c in ("parent", "label", "depth")]  # equal for equal tokens
    vector = (F.sum("vector") % (1 << FINGERPRINT_BITS)).alias("vector")
    return rows.groupBy(*by).agg(*one, *sums, vector, F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("texts").alias("texts"), F.bool_and("other").alias("other"))


def templates(vectors: DataFrame, least_pages: int) -> DataFrame:
    """Per host of least_pages pages or more: its template.

    Only tokens on at least FREQUENT of a host's pages are gathered, so a host has at most twice as many as
    an average page of it, however many pages it has. A host's tokens are dealt over SALTS parts before.
    """
    size = vectors.where((F.col("token") == ROOT) & (F.col("pages") >= least_pages) & (F.col("host") != "")).select("host", F.col("pages").alias("n_pages"))
    size = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    frequent = vectors.withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(size, ["host", "salt"]).where(F.col("pages") >= FREQUENT * F.col("n_pages"))
    groups = frequent.groupBy("host").agg(F.collect_list(F.struct(*_FIELDS)).alias("tokens"))

    def work(batches):
        for batch in batches:
            found = [deduce([Token(**t) for t in tokens]) for tokens in batch.column(1).to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(t.content) for t in found], longs), pa.array([sorted(t.dropped) for t in found], longs), pa.array([t.whole for t in found], pa.bool_())], names=["host", "content", "dropped", "whole"])

    return groups.mapInArrow(work, "host string, content array<long>, dropped array<long>, whole boolean")


def corpus_template(vectors: DataFrame) -> Template | None:
    """The template of all pages together, from the vectors of the hosts."""
    n = vectors.where(F.col("token") == ROOT).agg(F.sum("pages")).first()[0]
    if not n:
        return None
    got = _merged(vectors, "token").where(F.col("pages") >= FREQUENT * n).select(*_FIELDS)
    return deduce([Token(*r) for r in got.toLocalIterator()])


def read_slots(source: str, template: Template | None) -> str | None:
    """The blocks of the template's content slots; None if the page lacks them. Without a template, all text of the page."""
    content, dropped = (template.content, template.dropped) if template else (frozenset([ROOT]), frozenset[int]())
    wanted, blocks, met = content | dropped, [[]], ROOT in content
    for kind, node, text in events(source, wanted):
        if kind == "block":
            if blocks[-1]:
                blocks.append([])
        elif kind == "open":
            met = met or node.token in content
        elif node is None:
            if ROOT in content:
                blocks[-1].append(text)
        elif (ROOT in content or node.lineage & content) and not node.lineage & dropped and not (template and node.other):
            blocks[-1].append(text)
    if not met:
        return None
    return "\n".join(b for parts in blocks if (b := SPACE_RUN.sub(" ", html_lib.unescape("".join(parts))).strip()))


def main_text(source: str, choices: Iterable[Template | None]) -> str:
    """By the first of the templates whose content slot is on the page and not all of it; else by the classes of the
    page alone, and if these have the whole page as their slot, as the first of the templates has it."""
    known = [t for t in choices if t is not None]
    for template in known:
        if not template.whole and (text := read_slots(source, template)) is not None:
            return text
    own = deduce(page_tokens(source), compared=False)
    if own.whole:
        own = next((t for t in known if t.whole and ROOT in t.content), own)
    return read_slots(source, own) or ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 3) -> DataFrame:
    """Per row: id, url, text, n_chars.

    Null or empty html gives an empty text, a null url is a page without a host. Pages without a host, and
    those of hosts with fewer than least_pages pages, use the template of all pages; a page that lacks its
    template's content slot is read by its own classes. Rows that repeat are extracted each and tell as
    little as one (their text is one text); ties between equally deep slots go to the one with more varying
    text, then to the larger token. An empty table gives an empty result; further columns are ignored.
    Whole pages are read, however long or deeply nested.
    """
    from ._spark import saved

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    vectors = saved(token_vectors(rows), "tokens")
    everywhere = corpus_template(vectors)
    own = saved(templates(vectors, least_pages), "templates").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    host = F.translate(F.regexp_extract("url", "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    salted = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(own, ["host", "salt"], "left").select("page_id", "url", "html", "content", "dropped", "whole")

    def read(batches):
        for batch in batches:
            texts, known = [], {}
            for source, content, dropped, whole in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                mine = None
                if content is not None:
                    key = (tuple(content), tuple(dropped))
                    mine = known.setdefault(key, Template(frozenset(content), frozenset(dropped), whole))
                texts.append(main_text(source or "", (mine, everywhere)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"{id_col} {kind}, url string, text string, n_chars long")
