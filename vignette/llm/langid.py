"""Operator 2: language identification by compression.

Texts are put in lower case. Every language has a raw-content zstandard dictionary, made of a bounded sample of the
documents that carry its label: of the label's distinct texts the `sample` that come first by a hash, each with slices
spread over its whole length, dictionary bytes shared out evenly. A text, cut into blocks of BLOCK bytes that cover all
of it, is compressed against each dictionary; the language with the smallest sum wins. It is rejected (lang null)
where the runner-up's sum is not larger by the share MARGIN and by MARGIN_BYTES. Blocks keep the dictionary's help
alive in long texts, which would otherwise serve as their own dictionary.

Cases: a null or empty text is rejected. What cannot be judged is kept, with lang null: every text where fewer than two
languages could be learnt, and texts whose own label could not be (fewer than `least` usable documents, or beyond the
`most` labels with the most documents), as they would turn into another language. A sampled document that the quality
rules reject teaches only where fewer than `least` others do. Texts of any length serve as samples and are judged whole; a tie is a narrow margin and is
rejected; repeated rows get equal results and count once in the sample; an empty table learns nothing and keeps
nothing; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, utf8
from .quality import compressor, judge

LEVEL = 5
BLOCK = 4096
SAMPLE_DOCS = 96  # labelled documents read per language, at most
DICT_BYTES = 1 << 16
MIN_DOCS = 3
MOST_LANGUAGES = 200  # dictionaries of DICT_BYTES that a worker holds, at most
PIECES = 4  # slices of a sampled document that is longer than its share
MARGIN = 0.01
MARGIN_BYTES = 1

SCORES = "struct<lang:string,margin:double,keep:boolean>"
_TYPE = pa.struct([("lang", pa.string()), ("margin", pa.float64()), ("keep", pa.bool_())])


def _slices(room: int):
    """Arrow function from texts to struct(good, data): whether the quality rules accept them, and their lower-case UTF-8,
    PIECES slices of at most `room` bytes in all where they are longer."""

    @F.arrow_udf("struct<good:boolean,data:binary>")
    def run(column: pa.Array) -> pa.Array:
        compress, good, out = compressor(), [], []
        for text in column.to_pylist():
            good.append(judge((text or "").encode(), compress)[3] is None)
            data = (text or "").lower().encode()
            if len(data) > room:
                part = room // PIECES
                step = (len(data) - part) // (PIECES - 1)
                data = b"\n".join(data[k * step : k * step + part] for k in range(PIECES))
            out.append(data)
        return pa.StructArray.from_arrays([pa.array(good), pa.array(out, pa.binary())], ["good", "data"])

    return run


def _filled(texts: list[bytes], size: int) -> bytes:
    """All texts joined, the longer ones cut evenly so that the whole has `size` bytes at most."""
    share = size
    while sum(min(len(t), share) + 1 for t in texts) > size and share > 1:
        share = share * 15 // 16
    return b"\n".join(t[:share] for t in texts)[:size]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, size: int = DICT_BYTES, least: int = MIN_DOCS, most: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """language -> dictionary. The sample is the only part of this operator that does not see every row. Hashes alone find
    it, so that copies count once and no task sends more texts than are wanted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text <> ''").withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    largest = [r["lang"] for r in distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    first = distinct.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where((F.col("n") <= sample) & F.col("lang").isin(largest)).select("lang", "h")
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in first.collect()], "lang string, h bigint")  # sample * most rows at most
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    made: dict[str, list[tuple[int, bool, bytes]]] = {}
    for r in texts.select("lang", "h", _slices(4 * size // sample)("text").alias("v")).collect():
        made.setdefault(r["lang"], []).append((r["h"], r["v"]["good"], bytes(r["v"]["data"])))
    out = {}
    for lang, own in sorted(made.items()):
        best = [t for _, good, t in sorted(own) if good]
        if len(best) < least:
            best = [t for _, _, t in sorted(own)]
        if len(best) >= least:
            out[lang] = _filled(best, size)
    return out


def _against(dictionary: bytes, level: int):
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(dictionary), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    raw.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress


class Classifier:
    """decide() takes the UTF-8 of a text in lower case."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.compress = [_against(dictionaries[name], LEVEL) for name in self.names]

    def sizes(self, text: bytes) -> list[int]:
        view = memoryview(text)
        blocks = [view[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def decide(self, text: bytes) -> tuple[str | None, float]:
        """(language or None, margin); with fewer than two languages nothing is decided."""
        if not text or len(self.names) < 2:
            return None, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        lead = sizes[order[1]] - best
        margin = lead / best
        sure = margin >= MARGIN and lead >= MARGIN_BYTES
        return (self.names[order[0]] if sure else None), margin


def identify(text: Column, dictionaries: dict[str, bytes], label: Column | None = None) -> Column:
    """Column of struct(lang, margin, keep). lang is null where the text is rejected or could not be judged; keep tells
    which. label: the language that the row claims; one that was not learnt is left unjudged."""
    held: list[Classifier] = []

    @F.arrow_udf(SCORES)
    def run(column: pa.Array, label: pa.Array) -> pa.Array:
        if not held:
            held.append(Classifier(dictionaries))
        raw, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
        data, decide = memoryview(raw), held[0].decide
        known, rows = {None, *dictionaries}, []
        for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), label.to_pylist()):
            if a < b and (own not in known or len(dictionaries) < 2):
                rows.append((None, 0.0, True))
            else:
                lang, margin = decide(bytes(data[a:b]))
                rows.append((lang, margin, lang is not None))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(np.array([r[1] for r in rows], np.float64)), pa.array([r[2] for r in rows], pa.bool_())], fields=list(_TYPE))

    return run(text.cast("string"), F.lit(None).cast("string") if label is None else label.cast("string"))


def languages(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_found, margin, keep) of every row; the dictionaries, some 64 KB a language, go along with the tasks."""
    dictionaries = fit(docs, text_col, lang_col) if dictionaries is None else dictionaries
    bounded_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), identify(F.col(text_col), dictionaries, F.col(lang_col)).alias("v"))
    return found.select("doc_id", F.col("v.lang").alias("lang_found"), "v.margin", "v.keep")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, all columns unchanged."""
    dictionaries = fit(docs, text_col, lang_col) if dictionaries is None else dictionaries
    bounded_batches(docs.sparkSession)
    return docs.where(identify(F.col(text_col), dictionaries, F.col(lang_col)).getField("keep"))
