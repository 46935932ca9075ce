"""Lengths of packed documents against tiktoken on operator 3's vocabulary."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from compare import SMALL
from test_quality import brute_verdict

import corpus_pipeline
from vignette.llm import bpe, langid, packing, queries, secrets, simhash

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def tokens():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(bpe.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def laid(bins) -> dict:
    """Tokens of every document; its pieces must follow each other without gap."""
    spans: dict = {}
    for r in bins:
        assert r["used"] == sum(r["lengths"]) <= packing.CAPACITY
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            spans.setdefault(d, []).append((s, n))
    for parts in spans.values():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
    return {d: sum(n for _, n in parts) for d, parts in spans.items()}


def test_lengths_are_token_counts(spark, tokens):
    want = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r["text"]}
    assert laid(queries.op8_best_fit_packing(spark, SMALL).collect()) == want


def test_last_stage_cuts_at_tokens(spark, documents, tokens):
    text = "Zwölf 漢字 x9!q " * 700  # below the capacity in bytes / 4, above it in tokens
    assert -(-len(text.encode()) // 4) <= packing.CAPACITY < tokens(text)
    got = corpus_pipeline.best_fit_packing(spark, documents([(1, text, "de"), (2, None, "de"), (3, "", "de")]), SMALL).collect()
    assert laid(got) == {1: tokens(text)} and len(got) == 3


def test_pipeline_packs_the_tokens_of_masked_texts(spark, tokens):
    """As test_pipeline.py, with the tokens of what is left of each text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r in rows if brute_verdict(r[1])[3] is None]
    decide = langid.Classifier(langid.fit(docs.join(spark.createDataFrame([(r[0],) for r in rows], "doc_id bigint"), "doc_id"))).decide
    rows = [r for r in rows if decide(r[1].lower().encode())[0] is not None]
    group = simhash.brute_force_groups(rows)
    net, want = secrets.model(), {}
    for i, text in rows:
        if group.get(i, i) != i:
            continue
        data, made, at = text.encode(), b"", 0
        s, e, _, _, bad = secrets.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), net)
        for a, b in zip(s[bad], e[bad]):
            made, at = made + data[at:a] + secrets.MASK, b
        want[i] = tokens((made + data[at:]).decode())
    assert laid(corpus_pipeline.run(spark, SMALL).collect()) == want
