"""Captured files in batches and as a stream, charsets, and scopes from a table."""

import random
import time

import pytest

from siftwork.functions.text import decode_bytes
from siftwork.operators.selection import scoped
from siftwork.sources.captured import CapturedPayloads


@pytest.fixture()
def captured(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPayloads)
    return spark


def test_charsets():
    french, russian = "Été à l'œuvre", "Привет, мир"
    assert decode_bytes(french.replace("œ", "oe").encode("latin-1"), "text/html; charset=ISO-8859-1") == (french.replace("œ", "oe"), "iso8859-1")
    assert decode_bytes(french.encode("cp1252"), 'text/html; Charset = "windows-1252"') == (french, "cp1252")
    page = f'<html><head><META http-equiv="x" content="text/html; charset=windows-1251"><title>{russian}</title>'
    assert decode_bytes(page.encode("cp1251")) == (page, "cp1251")
    assert decode_bytes(page.encode("utf-8"), "text/html; charset=utf-8") == (page, "utf-8")  # the header wins
    assert decode_bytes(b"\xef\xbb\xbf" + russian.encode(), "text/html; charset=koi8-r") == (russian, "utf-8")  # the mark wins
    for name in ("utf-16-le", "utf-16-be"):
        mark = b"\xff\xfe" if name.endswith("le") else b"\xfe\xff"
        assert decode_bytes(mark + russian.encode(name)) == (russian, name)
    assert decode_bytes(b"a\xffb") == ("a\ufffdb", "utf-8") and decode_bytes(b"") == ("", "utf-8")
    assert decode_bytes("é".encode(), "text/html; charset=no-such") == ("é", "utf-8")
    assert decode_bytes(b"x", "text/plain; charset=rot13")[1] == "utf-8"  # no charset of bytes
    assert decode_bytes(b"<meta charset=utf-16>x")[0] == "<meta charset=utf-16>x"
    assert decode_bytes(b" " * 2000 + b"<meta charset=cp1251>\xcf")[1] == "utf-8"  # too late


def test_files_of_several_charsets(captured, tmp_path):
    russian = "<meta charset='windows-1251'>Привет"
    (tmp_path / "a.html").write_bytes(russian.encode("cp1251"))
    (tmp_path / "b.html").write_bytes("Привет".encode())
    (tmp_path / "c.html").write_bytes("é".encode("latin-1"))
    read = lambda **o: sorted(map(tuple, captured.read.format("captured").options(path=str(tmp_path), **o).load().select("name", "body", "charset").collect()))
    assert read() == [("a.html", russian, "cp1251"), ("b.html", "Привет", "utf-8"), ("c.html", "\ufffd", "utf-8")]
    assert read(content_type="text/html; charset=latin-1", pattern="c*") == [("c.html", "é", "iso8859-1")]


def test_many_small_files_are_few_tasks(captured, tmp_path):
    for i in range(10_000):
        (tmp_path / f"{i:05d}.json").write_text(str(i))
    df = captured.read.format("captured").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() <= 4
    assert df.selectExpr("sum(cast(body as bigint))").first()[0] == sum(range(10_000))


def test_a_stream_reads_each_file_once(captured, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a").write_text("1")
    (folder / "b").write_text("2")

    def go():
        time.sleep(0.6)
        source = captured.readStream.format("captured").option("path", str(folder)).option("settle_seconds", "0.3").load()
        q = source.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in captured.read.parquet(str(out)).select("name", "body").collect())

    assert go() == [("a", "1"), ("b", "2")]
    (folder / "c").write_text("3")
    assert go() == [("a", "1"), ("b", "2"), ("c", "3")]
    assert go() == [("a", "1"), ("b", "2"), ("c", "3")]


def test_scopes_equal_plain_rules(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    pages = [(i, rng.choice(["x", "y", "z", None]), f"http://{h.upper() if i % 3 else h}/p") for i, h in enumerate(hosts)] + [(900, "x", "no url"), (901, "y", None)]
    rules = list({(rng.choice(["x", "y", None]), rng.choice(hosts), rng.random() < 0.3) for _ in range(25)}) + [("y", "a", True)]
    rules = [r for r in rules if r[0] != "y" or r[2]]  # y only denies
    got = {r.page_id: (r.allowed, r.rule) for r in scoped(spark.createDataFrame(pages, "page_id int, scope string, url string"), spark.createDataFrame(rules, "scope string, domain string, denied boolean"), "scope").collect()}
    assert len(got) == len(pages)
    for i, scope, url in pages:
        h = url.split("/")[2].lower() if url and "://" in url else ""
        own = [r for r in rules if r[0] == scope]
        fits = lambda kind: max((d for _, d, no in own if no == kind and (h == d or h.endswith("." + d))), key=len, default=None)  # noqa: B023, E731
        no, yes = (fits(True), fits(False)) if h else (None, None)
        assert got[i] == (bool(h) and no is None and (yes is not None or all(r[2] for r in own)), no or yes), (i, scope, url)
