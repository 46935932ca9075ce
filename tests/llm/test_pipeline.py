"""The pipeline against its stages done by hand on plain Python rows."""

from __future__ import annotations

import numpy as np
from compare import SMALL
from test_packing import tokens
from test_quality import brute_verdict

import corpus_pipeline
from vignette.llm import langid, secrets, simhash


def test_run_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [r for r in rows if brute_verdict(r[1])[3] is None]
    good = spark.read.parquet(f"{SMALL}/documents.parquet").join(spark.createDataFrame([(r[0],) for r in rows], "doc_id bigint"), "doc_id")
    decide = langid.Classifier(langid.fit(good)).decide
    rows = [r for r in rows if decide(r[1].lower().encode())[0] is not None]
    group = simhash.brute_force_groups(rows)
    rows = [r for r in rows if group.get(r[0], r[0]) == r[0]]
    net, total = secrets.model(), {}
    for i, text in rows:
        data, made, at = text.encode(), b"", 0
        s, e, _, _, bad = secrets.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), net)
        for a, b in zip(s[bad], e[bad]):
            made, at = made + data[at:a] + secrets.MASK, b
        total[i] = tokens((made + data[at:]).decode())
    got: dict = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        for d, n in zip(r["doc_ids"], r["lengths"]):
            got[d] = got.get(d, 0) + n
    assert got == total


def test_stages_keep_the_columns(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            assert stage(spark, df, SMALL).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SMALL).count() == 0


def test_clean_documents_stay(spark):
    """Of the documents labelled good, the quality rules and language ID together lose few."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").select(*docs.columns)
    n = good.count()
    one = corpus_pipeline.quality_rules(spark, good, folder)
    two = langid.keep_identified(one, langid.fit(docs))
    assert one.count() >= 0.98 * n and two.count() >= 0.96 * n
