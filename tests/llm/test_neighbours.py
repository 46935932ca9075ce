from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vignette.llm import crosspoly, queries

VECTOR = "vec_id bigint, embedding array<float>"


def brute(ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, set]:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    return {int(i): set(ids[np.lexsort((ids, -row))[:k]].tolist()) for i, row in zip(ids, s)}


def recall(got, want: dict) -> float:
    found: dict = {}
    for r in got:
        found.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    return sum(len(found.get(i, set()) & w) for i, w in want.items()) / sum(len(w) for w in want.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    want = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows]), crosspoly.K)
    want = {i: w for i, w in want.items() if i % 20 == 0}
    got = queries.op10_nearest_neighbours(spark, f"/root/testdata/{sf}").collect()
    assert {r["vec_id"] for r in got} == set(want) and len(got) == len(want) * crosspoly.K and recall(got, want) >= 0.9
    assert all(r["vec_id"] != r["neighbor_id"] for r in got)
    true = {r["vec_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in rows}
    assert all(abs(r["similarity"] - true[r["vec_id"]] @ true[r["neighbor_id"]]) < 1e-5 for r in got)


def clustered(n: int, d: int, seed: int) -> np.ndarray:
    g = np.random.default_rng(seed)
    centre = g.normal(size=(60, d))
    return np.concatenate([centre[g.integers(0, 60, n // 2)] + 0.25 * g.normal(size=(n // 2, d)), g.normal(size=(n - n // 2, d))]).astype(np.float32)


def frame(spark, x: np.ndarray):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], VECTOR).repartition(4)


def test_recall_on_many_buckets(spark):
    """Half of the vectors in tight clusters, every row a query."""
    x = clustered(10_000, 24, 4)
    assert recall(crosspoly.neighbours(frame(spark, x)).collect(), brute(np.arange(len(x)), x, 10)) >= 0.9


@pytest.mark.parametrize("most", [16_384, 150])
def test_cut_groups_lose_nothing(spark, monkeypatch, most):
    """A plan whose limit lets every bucket through is exact search, also where groups are cut into blocks; a third of the
    rows are copies of one vector, a third lie in one bucket."""
    monkeypatch.setattr(crosspoly, "MOST", most)
    g = np.random.default_rng(9)
    same = g.normal(size=16)
    x = np.concatenate([np.repeat(same[None], 400, axis=0), same * 3 + 0.01 * g.normal(size=(400, 16)), g.normal(size=(400, 16))]).astype(np.float32)
    x = x[g.permutation(len(x))]
    whole = crosspoly.Plan(crosspoly.shape(64, 16), 2, 100.0, 4, 1.0)
    got = crosspoly.neighbours(frame(spark, x), every=5, using=whole).collect()
    u = x / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    by: dict = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == set(range(0, len(x), 5))
    for i, found in by.items():
        s = u @ u[i]
        s[i] = -3
        found.sort(key=lambda r: r["rank"])
        best = np.sort(s)[::-1][:10]
        assert len({r["neighbor_id"] for r in found}) == 10 and np.allclose([r["similarity"] for r in found], best, atol=1e-5)
        ties = [r["neighbor_id"] for r in found if r["similarity"] == found[0]["similarity"]]
        assert ties == sorted(ties)


def test_share_of_the_table_that_a_query_meets_falls():
    """Gaussian vectors, the hardest case: planned on 256 queries among 10, 50 and 200 thousand vectors."""
    share, ship = [], []
    for n in (10_000, 50_000, 200_000):
        g = np.random.default_rng(n)
        x = g.normal(size=(n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = x[:256]
        s = q @ x.T
        s[np.arange(256), np.arange(256)] = -2
        near = np.argpartition(-s, 10, axis=1)[:, :10]
        p = crosspoly.cheapest(q, x[near.ravel()], np.repeat(np.arange(256), 10), n, n // 20, crosspoly.TARGET)
        share.append(p.share)
        ship.append(p.tables)
    assert share[0] < 0.8 and share[0] > share[1] > share[2] and share[2] < 0.35, share
    assert max(ship) <= max(crosspoly.TABLES)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1), atol=1e-5)
    assert np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x, atol=1e-5)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, VECTOR).withColumns({"bucket": F.lit("x"), "id": F.lit("x"), "v": F.lit(1), "rank": F.lit(0), "similarity": F.lit(None).cast("string")})
    got = crosspoly.neighbours(df).collect()
    of = {i: [r["neighbor_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["vec_id"] == i] for i in (1, 2, 3, 9)}
    assert of == {1: [2, 9, 3], 2: [1, 9, 3], 3: [1, 2, 9], 9: [1, 2, 3]} and len(got) == 12
    assert crosspoly.neighbours(df.limit(0)).count() == 0
    assert crosspoly.neighbours(df.where("vec_id = 1")).count() == 0
