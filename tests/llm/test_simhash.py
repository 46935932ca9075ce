from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from vignette.llm import queries, simhash


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = simhash.brute_force_groups(rows)
    size = {}
    for g in want.values():
        size[g] = size.get(g, 0) + 1
    got = {r["doc_id"]: (r["group_id"], r["is_kept"]) for r in queries.op7_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (g, i == g) for i, g in want.items() if size[g] > 1}


def near_pairs(n: int, distance: int, seed: int) -> np.ndarray:
    g = np.random.default_rng(seed)
    base = g.integers(0, 2**64, (n, 2), np.uint64, endpoint=False)
    twin = base.copy()
    for i in range(n):
        for b in g.choice(128, distance, replace=False):
            twin[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.concatenate([base, twin])


def test_recursion_keeps_its_recall(spark):
    """20,000 pairs at the largest distance that counts, searched through every level of the recursion."""
    n = 20_000
    fp = near_pairs(n, simhash.MAX_DISTANCE, 3).view(np.int64)
    nodes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(fp.tolist())], "node bigint, hi bigint, lo bigint")
    found = {(r["a"], r["b"]) for r in simhash.edges(nodes, 2 * n).collect()}
    assert simhash.plan(2 * n)["depth"] >= 1
    true = {(i, i + n) for i in range(n)}
    assert len(true & found) / n >= 0.9
    assert len(found - true) < 20


def test_plan_reaches_recall_at_every_size():
    for n in (1, 100, 10_000, 1_000_000, 100_000_000, 10_000_000_000):
        p = simhash.plan(n)
        assert 1 - (1 - p["caught"]) ** p["trees"] >= simhash.RECALL and p["trees"] < 60, (n, p)


def test_near_copies_are_found_and_others_are_not(documents):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ber", "lin", "mor", "tas", "kel", "vin", "dor", "pal") for b in ("ado", "ent", "isk", "ula", "orm", "eth", "ang")]
    rows, i = [], 0
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for k in range(3):
            now = list(words)
            for _ in range(k * 2):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            rows.append((i, " ".join(now), "en"))
            i += 1
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(documents(rows)).collect()}
    assert sum(got.get(j) == j - j % 3 for j in range(i)) / i >= 0.95
    assert not any(g % 3 for g in got.values())


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows, clashing=True)
    out = simhash.deduplicate(df)
    rows = out.collect()
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in rows]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 2 and {1, 2, 3, 4, 7, 8, 9} <= set(ids)
    groups = simhash.groups(df).collect()
    assert sorted(r["doc_id"] for r in groups) == [5, 5, 6] and {r["group_id"] for r in groups} == {5}
    assert simhash.deduplicate(df.limit(0)).count() == 0 and simhash.groups(df.where(F.lit(False))).count() == 0


def test_fingerprints_do_not_depend_on_batches():
    texts = [f"some {i} words that differ by number {i * i} only here and there {i % 3}" for i in range(50)] + ["", None, "one"]
    whole = simhash.fingerprints(pa.array(texts, pa.string()))[0]
    parts = np.concatenate([simhash.fingerprints(pa.array([t], pa.string()))[0] for t in texts])
    assert (whole == parts).all() and (simhash.fingerprints(pa.array(texts, pa.string()), most=64)[0] == whole).all()


A, B, C = ("the quick harbour ship came home with seven barrels of salt and the crew sang all night", "zwei alte Wärter zählten die Lampen im Turm und schrieben jede Nacht ihre Namen auf", "por la mañana el mercado se llenó de gente que compraba pan fresco y flores amarillas")


@pytest.mark.parametrize("rows", [
    [(1, A), (5, A), (5, B), (7, C)],
    [(1, A), (2, A), (1, B), (3, B), (7, C)],
    [(1, A), (1, B), (2, B), (2, C), (3, C), (3, A)],
    [(4, A), (4, A), (4, B), (4, None), (4, ""), (None, A), (None, None)],
    [(1, A), (1, A + " again"), (1, B), (9, A)],
])
def test_only_the_copied_row_of_a_repeated_id_goes(documents, rows):
    """Against brute force by row: every text that leads its group or stands alone stays exactly once per doc_id."""
    told = simhash.brute_force_members(rows)
    df = documents([(i, t, "en") for i, t in rows], clashing=True)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(df).collect()), key=str)
    want, seen = [], set()
    for (i, t), m in zip(rows, told):
        if m and (not m[1] or (i, t) in seen):
            continue
        want.append((i, t))
        if m:
            seen.add((i, t))
    assert got == sorted(want, key=str)
    assert {t for _, t in got} == {t for _, t in rows if t != A + " again"} | {t for _, t in got if t == A + " again"}
    groups = sorted(((r["doc_id"], r["group_id"], r["is_kept"]) for r in simhash.groups(df).collect()))
    size: dict = {}
    for (i, _), m in zip(rows, told):
        if m:
            size.setdefault(m[0], []).append((i, *m))
    assert set(groups) <= {x for v in size.values() for x in v}


def test_stored_tables_go_after_use(spark, documents):
    import os

    from vignette.llm import common

    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    with common.scratch(spark):
        assert simhash.deduplicate(documents([(1, A, "en"), (2, A, "en")])).count() == 1
    assert set(os.listdir(folder)) == before
