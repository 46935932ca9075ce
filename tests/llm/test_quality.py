"""Quality rules (6) and quality classifier (1)."""

from __future__ import annotations

import numpy as np
import pytest
import zstandard
from compare import SMALL

from vignette.llm import byteconv, quality, queries


def brute_verdict(text: str | None) -> tuple:
    if not text:
        return None, 0, 0, "empty"
    c = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    data = text.encode()
    ratio = len(data) / len(c.compress(data))
    low, high = next(b[1:] for b in quality.BANDS if len(data) <= b[0])
    pieces = [data[a : a + quality.CHUNK] for a in range(0, len(data), quality.CHUNK)] if len(data) > quality.CHUNK else []
    bad = []
    for p in pieces:
        lo, hi = quality.CHUNK_BAND if len(p) == quality.CHUNK else next(b[1:] for b in quality.BANDS if len(p) <= b[0])
        if not lo <= len(p) / len(c.compress(p)) <= hi:
            bad.append(len(p))
    reason = "repetitive" if ratio > high else "incompressible" if ratio < low else "uneven" if sum(bad) > quality.CHUNK_SHARE * len(data) else None
    return ratio, max(1, len(pieces)), len(bad), reason


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op6_quality_rules(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["ratio"], r["chunks"], r["chunks_outside"], r["reason"]) == brute_verdict(docs[r["doc_id"]]) and r["keep"] == (r["reason"] is None)


def test_rules_on_odd_rows(documents, odd_rows):
    df = documents(odd_rows, clashing=True)
    got = quality.verdicts(df).collect()
    assert len(got) == len(odd_rows)
    assert {r["doc_id"] for r in got if r["reason"] == "empty"} == {1, 2, None}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r["keep"] for r in got)
    assert quality.keep_good(df.limit(0)).count() == 0


def test_repetitive_and_random_texts_go(documents):
    import random

    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=5000))
    got = {r["doc_id"]: r["reason"] for r in quality.verdicts(documents([(1, "again and again " * 400, "en"), (2, noise, "en")])).collect()}
    assert got == {1: "repetitive", 2: "incompressible"}


def test_network_equals_loops():
    g = np.random.default_rng(1)
    net = byteconv.Network()
    texts = [bytes(g.integers(32, 120, n).astype(np.uint8)) for n in (1, 7, 300, 512, 513, 1500)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    fast = net.probabilities(np.frombuffer(b"".join(texts), np.uint8), offsets)
    w, move = net.w, byteconv.CHUNK - byteconv.OVERLAP
    for t, p in zip(texts, fast):
        pooled = []
        for a in range(0, max(1, len(t) - byteconv.OVERLAP), move):
            chunk = t[a : a + byteconv.CHUNK].ljust(byteconv.CHUNK, b"\0")
            best = np.max([w["emb"][list(chunk[k : k + byteconv.WIDTH])].ravel() @ w["f"] for k in range(0, byteconv.CHUNK - byteconv.WIDTH + 1, byteconv.STEP)], axis=0)
            pooled.append(np.maximum(best + w["fb"], 0))
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ w["o"] + w["ob"]
        assert p == pytest.approx(1 / (1 + np.exp(-float(z[0]))), abs=1e-4)


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("pmod(xxhash64(doc_id), 4) > 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    net = byteconv.fit(docs, train)
    got = byteconv.classify(docs.join(test.select("doc_id"), "doc_id"), net).join(test, "doc_id").where("probability IS NOT NULL").collect()
    assert len(got) > 300
    right = np.mean([(r["probability"] >= 0.5) == (r["quality"] == 1) for r in got])
    good = [r["keep"] for r in got if r["quality"] == 1]
    assert right > 0.85 and np.mean(good) > 0.96, (right, np.mean(good))


def test_classifier_on_odd_rows(spark, documents, odd_rows):
    df = documents(odd_rows, clashing=True)
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (9, 1, 1), (None, 1, 0), (77, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    net = byteconv.fit(df, labels)
    got = byteconv.classify(df, net).collect()
    assert len(got) == len(odd_rows)
    assert all((r["probability"] is None) == (r["doc_id"] in (1, 2) or (r["doc_id"] is None and not r["keep"] and r["probability"] is None)) for r in got)
    one_class = byteconv.fit(df, labels.where("quality = 1 AND doc_id <> 5"))
    assert one_class is None
    assert {r["doc_id"] for r in byteconv.classify(df, None).collect() if not r["keep"]} == {1, 2, None}
    assert byteconv.fit(df.limit(0), labels.limit(0)) is None and byteconv.classify(df.limit(0), net).count() == 0


def test_classifier_query_equals_loops(spark):
    """Every probability and decision of the query, from chunks, filters and pools in plain loops over whole documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = byteconv.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    w, move = {k: v.astype(np.float64) for k, v in net.w.items()}, byteconv.CHUNK - byteconv.OVERLAP
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, SMALL).collect()}
    assert set(got) == set(texts)
    near = 0
    for i, t in texts.items():
        if not t:
            assert got[i]["probability"] is None and not got[i]["keep"]
            continue
        pooled = []
        for a in range(0, max(1, len(t) - byteconv.OVERLAP), move):
            chunk = t[a : a + byteconv.CHUNK].ljust(byteconv.CHUNK, b"\0")
            best = np.full(len(w["fb"]), -np.inf)
            for k in range(0, byteconv.CHUNK - byteconv.WIDTH + 1, byteconv.STEP):
                best = np.maximum(best, w["emb"][list(chunk[k : k + byteconv.WIDTH])].ravel() @ w["f"])
            pooled.append(np.maximum(best + w["fb"], 0))
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ w["o"] + w["ob"]
        p = 1 / (1 + np.exp(-float(np.squeeze(z))))
        assert got[i]["probability"] == pytest.approx(p, abs=2e-4)
        if abs(p - net.threshold) > 2e-4:
            assert got[i]["keep"] == (p >= net.threshold)
        else:
            near += 1
    assert near < 5
