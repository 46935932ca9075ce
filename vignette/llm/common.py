"""Helpers shared by the text operators: Arrow buffers as numpy views, word hashing, shared storage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..storage import bounded_batches  # noqa: F401  (for the operators)

GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def shared_dir(spark) -> str:
    """The folder that all executors share. The cluster names it in spark.checkpoint.dir; only where that
    is unset (tests on one machine) a folder of our own is made and set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


_OPEN: list[list[str]] = []  # the paths that each open scratch() has seen


def scratch_path(spark, name: str) -> str:
    """A new place under the shared folder; inside scratch() it is deleted at the end."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def stored(df, name: str):
    """df written as Parquet under the shared folder and read back: cuts lineage and survives lost executors. Inside
    scratch() it is deleted at the end, else it stays, as results may still read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def remove(spark, *paths: str) -> None:
    """Deletes folders through the Hadoop file system that holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scratch(spark):
    """What stored() writes inside is deleted at the end; for callers that have written the result by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, *_OPEN.pop())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each (a longer row stands alone)."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, by prefix sums of a polynomial over Z/2^64 (no loop over spans)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = 1 << max(12, int(len(raw)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of letters, digits and non-ASCII bytes; none crosses a row's end."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = _WORD[raw]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    head[cuts] = inside[cuts]
    starts = np.flatnonzero(head)
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    tail[cuts] = inside[cuts]
    ends = np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
