"""Operator 5: WARC files, with a salvage reader.

The writer makes one gzip member a record. The reader walks from record to record and checks everything it can: the
gzip checksum, the version line, the length and the digest of the block, the end of the record. When a check fails it
searches on for the next place where a whole valid record starts (a gzip member or a version line), takes up reading
there, and logs the bytes in between as quarantined: (path, at, length, reason). Compressed and plain records may
stand in one file, and a member may hold any number of records (a whole file compressed as one stream): inside it the
search goes on in the same way, over the inflated bytes. Of a member that is cut off or breaks, the records before the
one that touches the fault are recovered; one whose checksum differs is quarantined, as no digest covers headers.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS by the path's scheme), so writers and readers may
be on different hosts. A local file is mapped, others are read block by block; a file is one task's work, many files
make the parallelism. Members and headers have no size limit; a member beyond HELD inflated bytes is inflated twice
and never held.

Cases: an empty file has no records; one without any valid record is a single gap; a record cut off by the file's end
is a gap; records that repeat are all returned; a null url or html is marked in the record and comes back as null; a
null page_id comes back as null; an empty table writes no record; a page of any length is one record; headers may be
folded, digests in base 16, 32 or 64; a response comes back as its body, without HTTP headers, chunks and content
encoding; other columns of pages are not written.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import mmap
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, stored

MAGIC = b"\x1f\x8b\x08"
_LINE = rb"WARC/[01]\.\d+\r?\n"
_VERSION = re.compile(_LINE)
_START = re.compile(rb"\x1f\x8b\x08|" + _LINE)
_BLANK = re.compile(rb"\r?\n\r?\n")
_FOLD = re.compile(rb"\r?\n[ \t]+")
_ESCAPED = re.compile(rb"[\x00-\x20%\x7f]")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
PIECE = 1 << 16
HELD = 1 << 26
PAGES = ("resource", "response", "conversion")


class Record(NamedTuple):
    at: int
    end: int
    headers: dict[str, bytes]
    block: bytes
    inner: int | None = None  # the record's place in the inflated member


class Gap(NamedTuple):
    at: int
    end: int
    reason: str
    inner: int | None = None


# --- writing --------------------------------------------------------------------------------------------------------


def record(kind: str, block: bytes, headers: dict[str, bytes], name: str) -> bytes:
    """One record, uncompressed."""
    digest = base64.b32encode(hashlib.sha1(block).digest())
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:" + name.encode() + b">", b"WARC-Date: 2024-01-01T00:00:00Z", *(k.encode() + b": " + v for k, v in headers.items()), b"WARC-Block-Digest: sha1:" + digest, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def page_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    headers = {"Content-Type": b"text/html; charset=utf-8"}
    if page_id is not None:
        headers["X-Page-Id"] = b"%d" % page_id
    if url is not None:
        headers["WARC-Target-URI"] = _ESCAPED.sub(lambda m: b"%%%02X" % m[0][0], url.encode())
    if html is None:
        headers["X-Null-Block"] = b"1"
    block = (html or "").encode()
    return record("resource", block, headers, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{hashlib.sha1(block).hexdigest()}")))


def damage(data: bytes, kind: int) -> bytes:
    """What happens to archives: 1 the end is lost, 2 a byte changes, 3 foreign bytes follow."""
    if kind == 1:
        return data[: max(12, len(data) * 2 // 3)]
    if kind == 2:
        at = len(data) // 2
        return data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :]
    return data + b"\x00\x1f\x8b\x07noise" * 5 if kind == 3 else data


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that serves a path or URI, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), re.sub(r"^file:(//(?=/))?", "", path)


def write_pages(pages: DataFrame, folder: str, fault: Column | None = None) -> DataFrame:
    """Writes (page_id, url, html) as gzip WARC files into a folder that all executors share, one a task, and returns
    (path, records). fault: a column 0..3, see damage(). A task that runs again writes another file; only listed files
    count."""

    def run(batches):
        path = f"{folder}/pages-{TaskContext.get().partitionId():06}-{uuid.uuid4().hex}.warc.gz"
        where, name = file_system(path)
        where.create_dir(name.rpartition("/")[0])
        count = 0
        with where.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for page_id, url, html, kind in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(damage(member(page_record(page_id, url, html)), kind or 0))
                    count += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count])], ["path", "records"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"), (F.lit(0) if fault is None else fault).cast("int").alias("fault"))
    return rows.mapInArrow(run, "path string, records bigint")


# --- reading --------------------------------------------------------------------------------------------------------


class Remote:
    """A file of any file system as a sequence of bytes; a few blocks are kept."""

    BLOCK, KEPT = 1 << 22, 8

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.blocks = file, file.size(), OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.file.read_at(min(self.BLOCK, self.size - k * self.BLOCK), k * self.BLOCK)
            if len(self.blocks) > self.KEPT:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def __getitem__(self, part: slice) -> bytes:
        a, b = max(0, part.start or 0), self.size if part.stop is None else min(self.size, part.stop)
        if a >= b:
            return b""
        first, last = a // self.BLOCK, (b - 1) // self.BLOCK
        if first == last:
            return self._block(first)[a - first * self.BLOCK : b - first * self.BLOCK]
        if b - a > self.BLOCK * self.KEPT:
            return self.file.read_at(b - a, a)
        return b"".join(self._block(k) for k in range(first, last + 1))[a - first * self.BLOCK : b - first * self.BLOCK]


class Stream:
    """The inflated bytes of the gzip member at `at`, piece by piece, exactly up to its end or its fault."""

    def __init__(self, data, at: int):
        self.data, self.at, self.made = data, at, zlib.decompressobj(31)
        self.step, self.pending = PIECE, b""
        self.over, self.reason = False, ""

    @property
    def end(self) -> int:
        return self.at - len(self.pending) - len(self.made.unused_data)

    def more(self) -> bytes:
        """The next piece; empty where the member is over."""
        while not self.over:
            if not self.pending:
                self.pending = self.data[self.at : self.at + PIECE]
                self.at += len(self.pending)
            chunk, before = self.pending[: self.step], self.made.copy()
            try:
                got = self.made.decompress(chunk, 1 << 22)
            except zlib.error as e:
                if len(chunk) > 1:  # once more in smaller steps, up to the byte that fails
                    self.made, self.step = before, max(1, len(chunk) // 16)
                    continue
                self.over, self.reason = True, "checksum differs" if "check" in str(e) else "bad gzip member"
                break
            self.pending = self.made.unconsumed_tail + self.pending[len(chunk) :]
            if self.made.eof:
                self.over = True
            elif not chunk and not got:
                self.over, self.reason = True, "member cut off"
            if got:
                return got
        return b""


class Inflated:
    """What the member at `at` gives, read forwards; forget() lets go of what lies before."""

    def __init__(self, data, at: int, size: int):
        self.stream, self.size, self.base, self.held = Stream(data, at), size, 0, bytearray()

    def __len__(self) -> int:
        return self.size

    def forget(self, at: int) -> None:
        del self.held[: max(0, at - self.base)]
        self.base = max(self.base, at)

    def __getitem__(self, part: slice) -> bytes:
        a, b = part.start, min(self.size, part.stop)
        while self.base + len(self.held) < b and (got := self.stream.more()):
            self.held += got
        return bytes(self.held[max(0, a - self.base) : max(0, b - self.base)])


def _search(pattern: re.Pattern, data, at: int, until: int) -> tuple[int, int] | None:
    """(begin, end) of the first match of a pattern for up to 32 bytes."""
    if isinstance(data, (bytes, mmap.mmap)):
        found = pattern.search(data, at, until)
        return found.span() if found else None
    step = PIECE
    while at < until:
        part = data[at : min(until, at + step + 32)]
        found = pattern.search(part)
        if found and (found.start() < step or at + step >= until):
            return found.start() + at, found.end() + at
        at, step = at + step, min(step * 2, Remote.BLOCK)
    return None


class Member(NamedTuple):
    reason: str  # empty if the checksum is right
    end: int
    inflated: int = 0  # how many bytes it gives
    content: bytes | None = None  # these, where they are held


def _inflate(data, at: int) -> Member:
    stream, parts, head, total = Stream(data, at), [], b"", 0
    while got := stream.more():
        if len(head) < 6:
            head += got[:6]
            if not b"WARC/".startswith(head[:5]) or len(head) > 5 and head[5:6] not in b"01":
                return Member("no version line", stream.end)
        total += len(got)
        if parts is not None:
            parts.append(got)
            if total > HELD:
                parts = None
    return Member(stream.reason, stream.end, total, None if parts is None else b"".join(parts))


def _digest_differs(stated: bytes, block: bytes) -> bool:
    """False where it matches or its kind is not known."""
    kind, colon, value = stated.strip().partition(b":")
    name = kind.decode("latin-1").strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return False
    made = hashlib.new(name, block).digest()
    value = value.strip()
    return value.lower() != made.hex().encode() and value.upper().rstrip(b"=") != base64.b32encode(made).rstrip(b"=") and value.rstrip(b"=") not in (base64.b64encode(made).rstrip(b"="), base64.urlsafe_b64encode(made).rstrip(b"="))


def _parse(data, at: int, until: int, blank: list[int] | None = None) -> tuple[dict[str, bytes], bytes, int] | str:
    """(headers, block, end) of the record at `at`, or what is wrong with it. blank remembers the empty line found last, so
    that many beginnings before one such line do not search for it again."""
    line = _VERSION.match(data[at : min(until, at + 32)])
    if not line:
        return "no version line"
    top = at + line.end()
    blank = [-1, -1] if blank is None else blank
    if blank[0] < top - 1:
        blank[:] = _search(_BLANK, data, top, until) or (until, until)
    stop, begin = blank
    if stop >= until:
        return "header not closed"
    headers = {}
    for part in _FOLD.sub(b" ", data[top:stop]).splitlines():
        key, colon, value = part.partition(b":")
        if not colon:
            return "bad header"
        headers[key.decode("latin-1").strip().lower()] = value.strip()
    size = headers.get("content-length", b"")
    if not size.isdigit() or len(size) > 18:
        return "no length"
    end = begin + int(size)
    if end > until:
        return "block cut off"
    close = re.match(rb"\r?\n\r?\n", data[end : min(until, end + 4)])
    if not close:
        return "record not closed"
    block = data[begin:end]
    if _digest_differs(headers.get("warc-block-digest", b""), block):
        return "digest differs"
    return headers, block, end + close.end()


class Found(NamedTuple):
    """The items that start at a place; a reason where what follows them is broken."""

    items: Iterator[Record | Gap]
    reason: str = ""


def read_at(data, at: int, size: int, blank: list[int] | None = None) -> Found | str:
    """What starts exactly at `at`: a record, a member with its records, or what is wrong there."""
    if data[at : at + 3] != MAGIC:
        parsed = _parse(data, at, size, blank)
        return parsed if isinstance(parsed, str) else Found(iter([Record(at, parsed[2], parsed[0], parsed[1])]))
    found = _inflate(data, at)
    if not found.inflated:
        return found.reason or "empty member"

    def inside() -> Iterator[Record | Gap]:
        return _walk(Inflated(data, at, found.inflated) if found.content is None else found.content, found.inflated, _VERSION)

    if not found.reason:
        return Found(x._replace(at=at, end=found.end, inner=x.at) for x in inside())
    if found.reason == "checksum differs":  # the wrong byte may stand in any header, which no digest covers
        return found.reason
    before = lambda: (x for x in inside() if isinstance(x, Record) and x.end < found.inflated)
    if next(before(), None) is None:
        return found.reason
    return Found((x._replace(at=at, end=at + len(MAGIC), inner=x.at) for x in before()), found.reason)


def _walk(data, size: int, starts: re.Pattern) -> Iterator[Record | Gap]:
    at, blank = 0, [-1, -1]
    while at < size:
        found = read_at(data, at, size, blank)
        reason = found if isinstance(found, str) else found.reason
        for x in () if isinstance(found, str) else found.items:
            at = max(at, x.end)
            yield x
        if reason:
            begin, start = at, _search(starts, data, at + 1, size)
            while start and isinstance(read_at(data, start[0], size, blank), str):
                start = _search(starts, data, start[0] + 1, size)
            at = start[0] if start else size
            yield Gap(begin, at, reason)
        if isinstance(data, Inflated):
            data.forget(at)


def salvage(data) -> Iterator[Record | Gap]:
    """All valid records of a file, in order, and the gaps between them. data: bytes, a memory map or a Remote."""
    return _walk(data, len(data), _START)


def body(headers: dict[str, bytes], block: bytes) -> tuple[bytes, bytes]:
    """(content, its type) of a record: of an HTTP response without headers, chunks and content encoding."""
    kind = headers.get("content-type", b"")
    if headers.get("warc-type", b"").lower() != b"response" or not kind.lower().startswith(b"application/http"):
        return block, kind
    stop = _BLANK.search(block)
    if not stop:
        return block, kind
    http = {}
    for line in _FOLD.sub(b" ", block[: stop.start()]).splitlines()[1:]:
        key, _, value = line.partition(b":")
        http[key.strip().lower()] = value.strip()
    content = block[stop.end() :]
    if b"chunked" in http.get(b"transfer-encoding", b"").lower():
        parts, at = [], 0
        while m := re.compile(rb"\s*([0-9a-fA-F]+)[^\n]*\n").match(content, at):
            n = int(m[1], 16)
            parts.append(content[m.end() : m.end() + n])
            at = m.end() + n
            if not n:
                break
        content = b"".join(parts) if parts else content
    for coding in reversed(http.get(b"content-encoding", b"").lower().split(b",")):
        with contextlib.suppress(zlib.error):
            if coding.strip() in (b"gzip", b"x-gzip"):
                content = zlib.decompressobj(31).decompress(content)
            elif coding.strip() == b"deflate":
                content = zlib.decompressobj(15 if content[:1] == b"x" else -15).decompress(content)
    return content, http.get(b"content-type", b"")


def decoded(content: bytes, kind: bytes) -> str:
    named = _CHARSET.search(kind)
    with contextlib.suppress(LookupError):
        if named:
            return content.decode(named[1].decode("ascii"), errors="replace")
    return content.decode(errors="replace")


ROWS = "path string, at bigint, inner bigint, length bigint, gap string, kind string, page_id bigint, url string, html string"


@contextlib.contextmanager
def opened(path: str):
    """The bytes of a file, mapped if it is local; None if it is empty."""
    where, name = file_system(path)
    if not where.get_file_info(name).size:
        yield None
    elif isinstance(where, fs.LocalFileSystem):
        with open(name, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data
    else:
        with where.open_input_file(name) as file:
            yield Remote(file)


def _row(path: str, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return path, x.at, x.inner, x.end - x.at, x.reason, None, None, None, None
    page, url = x.headers.get("x-page-id"), x.headers.get("warc-target-uri")
    html = None if "x-null-block" in x.headers else decoded(*body(x.headers, x.block))
    kind = x.headers.get("warc-type", b"").decode("latin-1").lower()
    number = int(page) if page and re.fullmatch(rb"-?\d{1,18}|-?[0-8]\d{18}|-?9[01]\d{17}", page) else None
    return path, x.at, x.inner, x.end - x.at, None, kind, number, None if url is None else unquote_to_bytes(url.strip(b"<>")).decode(errors="replace"), html


def read(files: DataFrame) -> DataFrame:
    """files: (path). Rows (path, at, inner, length, gap, kind, page_id, url, html): a record where gap is null, else a
    quarantined stretch of the file and why. inner is the place in the inflated member, null in plain files."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                rows: list[tuple] = []
                held = 0
                with opened(path) as data:
                    for x in () if data is None else salvage(data):
                        rows.append(_row(path, x))
                        held += len(x.block) if isinstance(x, Record) else 0
                        if held > 1 << 24 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.select(F.col("path").cast("string")).mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "at", "inner", "length", "gap", "kind", "page_id", "url", "html"])


def fault_of(page_id: Column) -> Column:
    """Marks some 6 % of the pages for damage(), by a digest that SQL engines share."""
    first = F.substring(F.md5(page_id.cast("string")), 1, 2)
    return F.when(first < "06", 1).when(first < "0c", 2).when(first < "10", 3).otherwise(0)


def round_trip(pages: DataFrame) -> tuple[DataFrame, str]:
    """(rows of read(), stored; folder) after writing all pages as WARC files of which some records are damaged."""
    folder = scratch_path(pages.sparkSession, "warc")
    files = stored(write_pages(pages, folder, fault_of(F.col("page_id"))), "warc-files")
    return stored(read(files.repartition(max(1, files.count()))), "warc-rows"), folder


def recovered(rows: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html) of the records that hold pages; the gaps (path, at, inner, length, gap) go to the table `gaps` in
    the folder."""
    rows.where("gap IS NOT NULL").select("path", "at", "inner", "length", "gap").write.parquet(f"{folder}/gaps")
    return rows.where(F.col("gap").isNull() & F.col("kind").isin(*PAGES)).select("page_id", "url", "html")
