from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pytest
from compare import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vignette.llm import bpe, queries
from vignette.llm.common import utf8

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts: list[str]) -> list[list[int]]:
    raw, offsets = utf8(pa.array(texts, pa.string()))
    ids, bounds = bpe.vocabulary().encode(raw, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


HARD = ["", " ", "  ", "a", "I'll don't 'tis 'RE we've", "x  y\n\n z \t", "abc123 4५६", "…—“quoted”", "漢字 かな 🙂🙂", "tab\tsep\r\n", "   lead", "trail   ", "'", "''s", "a'", " nb em", "ǅ ª ²", "a" * 5000, "ab" * 3000, " " * 4000 + "x"]


def test_hard_texts(reference):
    assert encoded(HARD) == [reference.encode_ordinary(t) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" '\n\tstrevmld1é.", max_size=40)), max_size=6))
def test_random_texts(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(texts) == [reference.encode_ordinary(t) for t in texts]


def test_query_equals_reference(spark, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op3_byte_bpe(spark, SMALL)
    for r in got.collect():
        assert r["roundtrip"] and r["ids"] == reference.encode_ordinary(docs[r["doc_id"]])
        at, data = 0, docs[r["doc_id"]].encode()
        for token, offset in zip(r["ids"], r["offsets"]):
            assert offset == at and data.startswith(reference.decode_single_token_bytes(token), at)
            at += len(reference.decode_single_token_bytes(token))
    assert {r["doc_id"]: r["text"] for r in bpe.decode(got).collect()} == docs


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows, clashing=True)
    got = bpe.encode(df)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and sum(r["ids"] is None for r in rows) == sum(t is None for _, t, _ in odd_rows)
    back = sorted(((r["doc_id"] or 0, r["text"] or "") for r in bpe.decode(got).collect()))
    assert back == sorted((i or 0, t or "") for i, t, _ in odd_rows)
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.decode(got.where(F.lit(False))).count() == 0


def test_slices_that_share_a_hash(monkeypatch):
    """Every slice of one length has the same hash; ids are still exact, also where the cache holds another slice."""
    words = bpe.Vocabulary(bpe.read(bpe.VOCABULARY))
    monkeypatch.setattr(bpe, "span_hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    true = bpe.vocabulary()
    for text in ("one two six ten, and four more", "red big sun sea: the last word it is", "one two"):
        data = text.encode()
        got = words.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
        want = [i for a, b in zip(*(lambda s: (s, [*s[1:], len(data)]))(bpe.boundaries(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist())) for i in true.merge_long(data[a:b])]
        assert got == want
