"""Text of captured pages: main text, title, page markers, redaction."""

from __future__ import annotations

import codecs
import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Markers of blocked pages, of blocked search pages and of pages that need a browser.
PAGE_BLOCK_MARKERS = ["captcha", "verify you are human", "access denied", "robot check"]
SEARCH_BLOCK_MARKERS = ["unfortunately, bots use duckduckgo too", "please complete the following challenge", "verify you are a human", "captcha"]
NEEDS_BROWSER_MARKERS = ["__next_data__", 'id="root"></div>', "enable javascript"]
BLOCKED_STATUSES = [401, 403, 429]
# Secrets in diagnostics.
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"
SECRET = r"(?i)\b(token|api[_-]?key|password|passwd|secret|authorization|access[_-]?token)(\s*[:=]\s*)([^\s,;]+)"
URL = r"(?i)https?://[^\s\"'<>]+"
HIDDEN, HIDDEN_URL = "[REDACTED]", "[REDACTED_URL]"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


#: Any other reference: numbers, further names, and names without a semicolon.
OTHER_REFERENCE = "&(?!(?:" + "|".join(name[1:-1] for name, _ in ENTITIES) + ");)[#A-Za-z]"


@pandas_udf(T.StringType())
def _unescape_all(text: pd.Series) -> pd.Series:
    return text.map(html_lib.unescape, na_action="ignore")


def unescape(text: Column, every: bool = True) -> Column:
    """Character references as HTML knows them. The frequent ones of ENTITIES (`&amp;` last) are replaced by Spark's own
    functions; only texts with any other reference go through Python, the rest reach it as nulls. Without `every` those of
    ENTITIES alone are read, in full: a text that was cut behind `&amp` keeps it."""
    plain = text
    for name, char in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    if not every:
        return plain
    return F.coalesce(_unescape_all(F.when(text.rlike(OTHER_REFERENCE), text)), plain)


#: A tag whose attribute values may hold ">", and the value of its href, in any quoting, behind any other attributes.
QUOTED_TAG = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HREF = r"""(?is)^<[a-z]+(?:[\s/]+(?!href[\s=/>])[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']*))?)*[\s/]+href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type), F.lit("text/html")).rlike("html|xml")


def stripped(html: Column) -> Column:
    """Text nodes one to a line, without script, style, noscript and svg, before references are read."""
    t = html
    for name in ("script", "style", "noscript", "svg"):
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "\n")
    t = F.regexp_replace(t, QUOTED_TAG, "\n")
    return F.regexp_replace(t, r"<[^>]*>", "\n")


def lines_of(plain: Column, every: bool = True) -> Column:
    """References of a stripped text read, white space at line ends and blank lines removed. unescape() refers to its input
    three times, so give it a column that a select before has made."""
    t = F.regexp_replace(unescape(plain, every), r"[ \t\r]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(t, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def main_text(html: Column, content_type: Column | None = None, every: bool = True) -> Column:
    """Text nodes one to a line, without script, style, noscript and svg; other content passes unchanged."""
    t = lines_of(stripped(html), every)
    return t if content_type is None else F.when(is_html(content_type), t).otherwise(html)


def raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)


def clean_title(raw: Column, every: bool = True) -> Column:
    t = F.btrim(F.regexp_replace(unescape(raw, every), r"[ \t\r\n]+", " "))
    return F.nullif(t, F.lit(""))


def title(html: Column, every: bool = True) -> Column:
    """The page title with its white space folded; null if there is none."""
    return clean_title(raw_title(html), every)


def hrefs(html: Column, tag: str = "a", where=None, repeats: bool = False, every: bool = True) -> Column:
    """href values of a tag in document order, first seen once or with repeats; `where`: of those tags alone for which it
    holds; `every`: as for unescape()."""
    seen = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    tags = F.regexp_extract_all(seen, F.lit(rf"""(?is)<{tag}[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    if where is not None:
        tags = F.filter(tags, where)
    values = F.transform(tags, lambda x: F.regexp_replace(F.regexp_extract(x, HREF, 1), r"""^["']|["']$""", ""))
    # the values are unescaped as one text, as Python functions cannot run inside an array
    joined = unescape(F.array_join(F.filter(values, lambda x: x != ""), HREF_MARK), every)
    found = F.split(joined, HREF_MARK)
    return F.when(F.length(joined) > 0, found if repeats else F.array_distinct(found)).when(html.isNotNull(), F.array().cast("array<string>"))


HREF_MARK = "\uffff\n"  # no URL has it


def _has_any(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def looks_blocked(text: Column, status: Column | None = None) -> Column:
    """HTTP status 401, 403 or 429, or a challenge marker in the first 50 000 characters."""
    marked = _has_any(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 50_000)), PAGE_BLOCK_MARKERS)
    return marked if status is None else F.coalesce(status.isin(BLOCKED_STATUSES), F.lit(False)) | marked


def search_blocked(text: Column) -> Column:
    return _has_any(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200_000)), SEARCH_BLOCK_MARKERS)


def needs_browser(html: Column) -> Column:
    return _has_any(F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 100_000)), NEEDS_BROWSER_MARKERS)


def redact(text: Column, most: int = 1000) -> Column:
    """Bearer tokens, then key=value secrets are hidden, URLs lose user, query and fragment, and the text is cut."""
    from .urls import redact_url

    t = F.regexp_replace(text, BEARER, f"Bearer {HIDDEN}")
    t = F.regexp_replace(t, SECRET, rf"$1$2{HIDDEN}")
    around, urls = F.split(t, URL), F.regexp_extract_all(t, F.lit(URL), F.lit(0))
    parts = F.zip_with(around, urls, lambda x, u: F.concat(x, F.coalesce(redact_url(u), F.lit(""))))
    t = F.when(F.size(urls) > 0, F.array_join(parts, "")).otherwise(t)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def safe_error(message: Column, kind: Column, most: int = 500) -> Column:
    """The redacted message of an error, or its kind where none is left."""
    return F.coalesce(F.nullif(redact(message, most), F.lit("")), kind)


def agent_blocked(success: Column, diagnostic: Column) -> Column:
    """An agent's run met a challenge: it did not succeed, and its result or errors name a block marker."""
    return ~F.coalesce(success, F.lit(False)) & _has_any(F.lower(F.coalesce(diagnostic, F.lit(""))), PAGE_BLOCK_MARKERS)


def ql_string(value: Column) -> Column:
    """Backslashes and double quotes escaped for a quoted query string."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def regex_escaped(value: Column) -> Column:
    """A text as a regular expression that matches itself alone."""
    return F.regexp_replace(value, r"([^\p{L}\p{N}_])", r"\\$1")


def charset(content_type: Column) -> Column:
    """Charset of a content type without quotes; utf-8 where there is none."""
    found = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset[ \t]*=[ \t]*[\"']?([A-Za-z0-9._-]+)", 1)
    return F.coalesce(F.nullif(F.lower(found), F.lit("")), F.lit("utf-8"))


# Byte order marks.
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
META = re.compile(rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)""", re.I)
META_BYTES = 1024


def decode_bytes(body: bytes, content_type: str | None = None) -> tuple[str, str]:
    """(text, charset) of a body: by its byte order mark, else by the charset of its content type, else by a meta tag in its first
    META_BYTES bytes, else as UTF-8; bytes that do not fit become replacement characters, a charset that nobody knows is UTF-8."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace"), name
    told = re.search(r"charset[ \t]*=[ \t]*[\"']?([A-Za-z0-9._-]+)", content_type or "", re.I)
    meta = None if told else META.search(body[:META_BYTES])
    name = told[1] if told else meta[1].decode() if meta else "utf-8"
    try:
        known = codecs.lookup(name)
        if not known._is_text_encoding or (meta and known.name.startswith("utf-16")):  # a tag read as ASCII is no UTF-16
            known = codecs.lookup("utf-8")
    except LookupError:
        known = codecs.lookup("utf-8")
    return body.decode(known.name, "replace"), known.name


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """Text and charset of a binary column, by decode_bytes(); null for a null body."""
    rows = [(None, None) if b is None else decode_bytes(bytes(b), t) for b, t in zip(body, content_type, strict=True)]
    return pd.DataFrame(rows, columns=["text", "charset"])


def content_length(value: Column) -> Column:
    """A length header as a number of at least 0; null where it is none."""
    n = F.btrim(value).try_cast("long")
    return F.when(n.isNotNull(), F.greatest(F.lit(0).cast("long"), n))


def bounded_int(value: Column, least: int, most: int) -> Column:
    """An integer clamped to a range; text that is no number is null."""
    n = value.try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), n)))
