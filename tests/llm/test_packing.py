from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from compare import SMALL
from pyspark.sql import functions as F

from vignette.llm import bpe, packing, queries


def brute_pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """The same rule over plain lists: all pairs are tried."""
    left = list(range(len(lengths)))
    bins = []
    while left:
        chosen, gap = [], capacity
        while fits := [i for i in left if lengths[i] <= gap]:
            i = max(fits, key=lambda i: (lengths[i], -i))
            left.remove(i)
            chosen.append(i)
            gap -= lengths[i]
        last = chosen[-1]
        room = gap + lengths[last]
        best = None
        if gap:
            for x in range(len(left)):
                for y in range(x + 1, len(left)):
                    a, b = sorted((lengths[left[x]], lengths[left[y]]), reverse=True)
                    if a + b <= room and (best is None or (a + b, a) > best):
                        best = (a + b, a)
        if best and best[0] > lengths[last]:
            chosen.pop()
            for want in (best[1], best[0] - best[1]):
                i = min(i for i in left if lengths[i] == want)
                left.remove(i)
                chosen.append(i)
            left = sorted([*left, last])
        bins.append(chosen)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=24), st.integers(30, 40))
def test_rule_equals_brute_force(lengths, capacity):
    got = packing.pack(lengths, capacity)
    assert [[lengths[i] for i in b] for b in got] == [[lengths[i] for i in b] for b in brute_pack(lengths, capacity)]
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))


def tokens(text: str) -> int:
    """Ids that operator 3 gives; test_packing_tokens.py holds them against tiktoken."""
    data = text.encode()
    return len(bpe.vocabulary().encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])


def covered(bins, want: dict, capacity: int) -> None:
    spans: dict = {}
    for r in bins:
        assert r["used"] == sum(r["lengths"]) <= capacity
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            spans.setdefault(d, []).append((s, n))
    assert set(spans) == set(want)
    for d, parts in spans.items():
        assert sum(n for _, n in parts) == want[d]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: tokens(r["text"]) for r in docs.collect() if r["text"]}
    bins = queries.op8_best_fit_packing(spark, SMALL).collect()
    covered(bins, want, packing.CAPACITY)
    rest = [(d, n % packing.CAPACITY) for d, n in sorted(want.items()) if n % packing.CAPACITY]
    brute = brute_pack([n for _, n in rest], packing.CAPACITY)
    whole = sum(n // packing.CAPACITY for n in want.values())
    assert len(bins) == len(brute) + whole
    assert sorted(r["used"] for r in bins) == sorted([sum(rest[i][1] for i in b) for b in brute] + [packing.CAPACITY] * whole)


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows, clashing=True)
    want: dict = {}
    for i, t, _ in odd_rows:
        if t:
            want[i] = want.get(i, 0) + tokens(t)
    covered(packing.bins(df).collect(), want, packing.CAPACITY)
    several = packing.bins(df, shard=2)
    covered(several.collect(), want, packing.CAPACITY)
    assert several.select("bin_id").distinct().count() == several.count()
    assert packing.bins(df.limit(0)).count() == 0 and packing.bins(df.where(F.lit(False))).count() == 0


def test_repeated_rows_do_not_fill_a_shard(documents):
    """A third of all rows with one id and text, a third without any id."""
    rows = [(7, "the same words again", "en")] * 300 + [(None, "one length " * 3, "en")] * 300 + [(100 + i, "words " * (i % 40 + 1), "en") for i in range(300)]
    df = documents(rows)
    got = packing.bins(df, capacity=64, shard=100).collect()
    sizes: dict = {}
    for r in got:
        sizes[r["bin_id"] >> 32] = sizes.get(r["bin_id"] >> 32, 0) + len(r["doc_ids"])
    assert len(sizes) == 9 and max(sizes.values()) < 160
    want: dict = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + tokens(t)
    covered(got, want, 64)
