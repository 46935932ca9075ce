from __future__ import annotations

import os
import zlib

import pytest
from compare import SMALL, database, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from vignette.llm import queries, warc

PAGE = "page_id bigint, url string, html string"


def test_query_equals_sql(spark):
    assert rows_of_spark(queries.op5_warc(spark, SMALL)) == rows_of_sql(database(SMALL), queries.oracle_sql()["op5_warc"])


def stream(n: int) -> list[bytes]:
    return [warc.page_record(i, f"http://x/{i}", f"<p>page {i} " + "words " * (i * 40)) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["none", "front", "middle", "byte", "cut", "between", "length"])
def test_salvage_recovers_all_but_the_damaged(packed, harm):
    records = [warc.member(r) if packed else r for r in stream(6)]
    lost: set[int] = set()
    if harm == "front":
        records[0], lost = records[0][5:], {0}
    elif harm == "middle":
        records[2], lost = records[2][: len(records[2]) // 2], {2}
    elif harm == "byte":
        at = len(records[3]) - 30
        records[3], lost = records[3][:at] + bytes([records[3][at] ^ 1]) + records[3][at + 1 :], {3}
    elif harm == "cut":
        records[5], lost = records[5][:-9], {5}
    elif harm == "between":
        records[1] += b"\x1f\x8b\x08 noise WARC/1.0\r\nnothing"
    elif harm == "length" and not packed:
        records[4], lost = records[4].replace(b"Content-Length: ", b"Content-Length: 9"), {4}
    data = b"".join(records)
    found = list(warc.salvage(data))
    got = {int(x.headers["x-page-id"]) for x in found if isinstance(x, warc.Record)}
    assert got == set(range(6)) - lost
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert bool(gaps) == (harm not in ("none",) and not (harm == "length" and packed))
    spans = sorted((x.at, x.end) for x in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_odd_pages(spark, tmp_path):
    rows = [(1, "http://é/ü ?a=%20", "<p>é🙂</p>"), (2, None, "x"), (3, "u", None), (None, "u", ""), (4, "u", "z" * 3_000_000), (4, "u", "z"), (4, "u", "z")]
    pages = spark.createDataFrame(rows, PAGE).withColumns({"path": F.lit("other"), "fault": F.lit("other"), "gap": F.lit(1)})
    files = warc.write_pages(pages, f"file://{tmp_path}/w").collect()
    assert sum(r["records"] for r in files) == len(rows)
    got = warc.read(spark.createDataFrame([(r["path"],) for r in files], "path string"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["page_id"], r["url"], r["html"]) for r in got.collect()], key=key) == sorted(rows, key=key)
    empty = tmp_path / "empty.warc"
    empty.write_bytes(b"")
    junk = tmp_path / "junk.warc"
    junk.write_bytes(os.urandom(5000))
    both = warc.read(spark.createDataFrame([(str(empty),), (str(junk),), (None,)], "path string")).collect()
    assert [(r["at"], r["length"], r["page_id"]) for r in both] == [(0, 5000, None)]
    rows_, folder = warc.round_trip(pages.limit(0))
    assert warc.recovered(rows_, folder).count() == 0


def test_gaps_are_logged(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}") for i in range(200)], PAGE)
    rows, folder = warc.round_trip(pages)
    got = warc.recovered(rows, folder)
    gaps = spark.read.parquet(f"{folder}/gaps")
    assert gaps.count() > 0 and 150 < got.count() < 200 and set(gaps.columns) == {"path", "at", "inner", "length", "gap"}


def numbers(data) -> list[int]:
    return [int(x.headers["x-page-id"]) for x in warc.salvage(data) if isinstance(x, warc.Record)]


def gaps_of(data) -> list:
    return [x for x in warc.salvage(data) if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("held", [1 << 26, 1000])
def test_a_member_may_hold_many_records(monkeypatch, held):
    """What compressing a whole file makes; also where members are too large to be held."""
    monkeypatch.setattr(warc, "HELD", held)
    records = stream(40)
    whole = warc.member(b"".join(records))
    assert numbers(whole) == list(range(40)) and not gaps_of(whole)
    two = warc.member(b"".join(records[:20])) + b"junk" + warc.member(b"".join(records[20:]))
    assert numbers(two) == list(range(40)) and [g.end - g.at for g in gaps_of(two)] == [4]
    broken = list(records)
    broken[7] = broken[7].replace(b"page 7", b"page 8")
    inside = warc.member(b"".join(broken))
    assert numbers(inside) == [i for i in range(40) if i != 7] and gaps_of(inside)[0].reason == "digest differs"
    cut = whole[: len(whole) * 2 // 3] + warc.member(records[0])
    got = numbers(cut)
    assert got[-1] == 0 and got[:-1] == list(range(len(got) - 1)) and len(got) > 15 and gaps_of(cut)
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    bad = made.compress(b"".join(records[:20])) + made.flush(zlib.Z_FULL_FLUSH) + b"\x07" * 50 + warc.member(records[0])
    assert numbers(bad) == [*range(19), 0] and [g.reason for g in gaps_of(bad)] == ["bad gzip member"]


def test_a_member_with_a_wrong_checksum_is_quarantined():
    """The fault may lie in any header, which no digest covers."""
    data = warc.member(b"".join(stream(3)))
    bad = data[:-8] + b"\0\0\0\0" + data[-4:]
    assert numbers(bad + data) == [0, 1, 2] and [(g.at, g.end, g.reason) for g in gaps_of(bad)] == [(0, len(bad), "checksum differs")]


def changed(old: bytes, new: bytes) -> bytes:
    made = warc.page_record(5, "u", "<p>five").replace(old, new)
    assert new in made
    return made


def test_valid_records_in_other_writings():
    import base64
    import hashlib

    block = b"<p>five"
    sha = hashlib.sha1(block).digest()
    base = b"sha1:" + base64.b32encode(sha)
    forms = [
        changed(b"WARC/1.0", b"WARC/0.18"),
        changed(b"WARC/1.0", b"WARC/1.1"),
        changed(base, b"sha1:" + sha.hex().encode()),
        changed(base, b"sha1:" + sha.hex().upper().encode()),
        changed(base, b"sha-256:" + hashlib.sha256(block).hexdigest().encode()),
        changed(base, b"md5:" + base64.b64encode(hashlib.md5(block).digest())),
        changed(base, b"blake9:whatever"),
        changed(b"WARC-Type: resource", b"WARC-Type: resource\r\nX-Folded: a\r\n b\r\n\tc"),
        changed(b"WARC-Type: resource", b"WARC-Type: resource\r\nX-Long: " + b"y" * 300_000),
        changed(b"\r\n", b"\n"),
    ]
    for data in forms:
        assert numbers(data) == [5] and numbers(warc.member(data)) == [5], data[:200]
    wrong = changed(base, b"sha1:" + hashlib.sha1(b"x").hexdigest().encode())
    assert numbers(wrong) == [] and gaps_of(wrong)[0].reason == "digest differs"
    long = warc.page_record(6, "u" * 200_000 + "%", "x")
    assert numbers(long + long) == [6, 6]


def test_responses_lose_their_http_headers():
    import gzip

    page = "<p>né</p>"
    chunks = b"3\r\n<p>\r\n4;x=y\r\nn\xc3\xa9<\r\n3\r\n/p>\r\n0\r\n\r\n"
    for head, content in [
        (b"Content-Type: text/html; charset=utf-8", page.encode()),
        (b"Content-Type: text/html; charset=latin-1", page.encode("latin-1")),
        (b"Content-Type: text/html; charset=nonsense", page.encode()),
        (b"Transfer-Encoding: chunked", chunks),
        (b"Content-Encoding: gzip", gzip.compress(page.encode())),
    ]:
        made = warc.record("response", b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + content, {"Content-Type": b"application/http; msgtype=response"}, "0")
        (found,) = warc.salvage(made)
        assert warc.decoded(*warc.body(found.headers, found.block)) == page


def test_remote_files_are_read_in_blocks(tmp_path, monkeypatch):
    """The reader for files that cannot be mapped gives what the map gives, also across its blocks."""
    import random

    from pyarrow import fs

    rng = random.Random(3)
    parts = []
    for k, r in enumerate(stream(60)):
        parts.append(warc.damage(warc.member(r) if k % 3 else r, rng.choice([0, 0, 0, 1, 2, 3])))
    parts.append(warc.member(b"".join(stream(50))))
    data = b"".join(parts)
    (tmp_path / "x.warc").write_bytes(data)
    monkeypatch.setattr(warc.Remote, "BLOCK", 777)
    for kept in (2, 8):
        monkeypatch.setattr(warc.Remote, "KEPT", kept)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc")) as file:
            assert list(warc.salvage(warc.Remote(file))) == list(warc.salvage(data))
    where, name = warc.file_system("file:///a/b")
    assert isinstance(where, fs.LocalFileSystem) and name == "/a/b" and warc.file_system("/a/b")[1] == "/a/b"


def test_many_beginnings_take_linear_time():
    import time

    def seconds(n):
        data = b"WARC/1.0\r\nX: y\r\n" * n
        began = time.process_time()
        assert not numbers(data)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 0.1 + 9 * max(seconds(4_000) for _ in range(3))
