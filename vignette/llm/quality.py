"""Operator 6: quality rules from compression bands.

The zstandard ratio (bytes / compressed bytes) of a whole document must lie in the band of its length, and the
chunks of CHUNK bytes that lie outside the chunk band may make up at most CHUNK_SHARE of its bytes. Above a band the
text repeats itself, below it the text is close to incompressible (keys, encoded binaries). Bands widen with length
because longer texts offer more matches. The table was set for running prose in Latin script at level 3; other scripts
and levels need bands of their own.

Cases: a null or empty text is rejected as "empty"; a text of any length is read whole; repeated rows get equal
verdicts; a ratio on the edge of its band is kept; an empty table gives no rows; no other column is looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.25
#: (largest number of bytes, lowest ratio, highest ratio)
BANDS = [(64, 0.0, 1.6), (128, 0.75, 1.8), (256, 0.98, 2.3), (512, 1.12, 2.3), (1024, 1.22, 2.4), (2048, 1.3, 2.6), (4096, 1.35, 2.7), (8192, 1.4, 2.9), (16384, 1.4, 3.1), (1 << 62, 1.4, 3.6)]
#: A whole chunk's band; a last chunk of other length takes the band of its length.
CHUNK_BAND = (1.3, 2.9)

VERDICT = "struct<ratio:double,chunks:int,chunks_outside:int,reason:string>"
_TYPE = pa.struct([("ratio", pa.float64()), ("chunks", pa.int32()), ("chunks_outside", pa.int32()), ("reason", pa.string())])
_UPTO = np.array([b[0] for b in BANDS])


def band(n: int) -> tuple[float, float]:
    return BANDS[int(np.searchsorted(_UPTO, n))][1:]


def judge(text: bytes, compress) -> tuple[float | None, int, int, str | None]:
    """(ratio, chunks, chunks outside their band, reason to reject or None). compress: bytes -> bytes."""
    n = len(text)
    if not n:
        return None, 0, 0, "empty"
    ratio = n / len(compress(text))
    low, high = band(n)
    chunks, outside, outside_bytes = 1, 0, 0
    if n > CHUNK:
        chunks = -(-n // CHUNK)
        view = memoryview(text)
        for a in range(0, n, CHUNK):
            size = min(CHUNK, n - a)
            r = size / len(compress(view[a : a + size]))
            lo, hi = CHUNK_BAND if size == CHUNK else band(size)
            if not lo <= r <= hi:
                outside += 1
                outside_bytes += size
    if ratio > high:
        reason = "repetitive"
    elif ratio < low:
        reason = "incompressible"
    else:
        reason = "uneven" if outside_bytes > CHUNK_SHARE * n else None
    return ratio, chunks, outside, reason


def compressor():
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress


def verdict(text: Column) -> Column:
    """Column of struct(ratio, chunks, chunks_outside, reason); reason is null where the text is kept."""

    @F.arrow_udf(VERDICT)
    def run(column: pa.Array) -> pa.Array:
        raw, offsets = utf8(column)
        data, compress = memoryview(raw), compressor()
        rows = [judge(bytes(data[a:b]), compress) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.array([dict(zip(("ratio", "chunks", "chunks_outside", "reason"), r)) for r in rows], _TYPE)

    return run(text.cast("string"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ratio, chunks, chunks_outside, reason, keep) of every row; no shuffle."""
    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), verdict(F.col(text_col)).alias("v"))
    return found.select("doc_id", "v.ratio", "v.chunks", "v.chunks_outside", "v.reason", F.col("v.reason").isNull().alias("keep"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, all columns unchanged."""
    bounded_batches(docs.sparkSession)
    return docs.where(verdict(F.col(text_col)).getField("reason").isNull())
