from __future__ import annotations

import numpy as np
import pytest

from vignette.operators import index, nearest, search, store

HIT = "query_id int, movie_id string, scene_id string, score double"


def merged(spark, low, high, k=20):
    rows = search.merge_levels(spark.createDataFrame([(0, "m", s, x) for s, x in low], HIT), spark.createDataFrame([(0, "m", s, x) for s, x in high], HIT), k).collect()
    return {r["scene_id"]: r["score"] for r in rows}


@pytest.mark.parametrize(
    ("low", "high", "want"),
    [
        ([("a", 0.95)], [("a", 0.80)], {"a": 0.95}),
        ([("a", 0.70)], [("a", 0.99)], {"a": 0.99}),
        ([("a", 0.85)], [], {"a": 0.85}),
        ([("a", 0.6), ("a", 0.95)], [("a", 0.5)], {"a": 0.95}),
        ([], [("a", -0.4)], {"a": 0.0}),
        ([], [], {}),
    ],
)
def test_levels_merge_by_maximum(spark, low, high, want):
    assert merged(spark, low, high) == want


def test_movies_take_their_best_scene(spark):
    hits = spark.createDataFrame([(0, "m1", "a", 1, 0.91), (0, "m1", "b", 2, 0.87), (0, "m2", "c", 1, 0.72)], "query_id int, movie_id string, scene_id string, scene_index int, score double")
    got = search.movies(hits, 2).orderBy("rank").collect()
    assert [(r["movie_id"], r["best_scene"]) for r in got] == [("m1", "a"), ("m2", "c")]


@pytest.mark.parametrize(("k", "pool"), [(0, 100), (26, 100), (5, 0), (5, 301)])
def test_limits(k, pool):
    with pytest.raises(ValueError):
        search.limits(k, pool)


def test_block_products_equal_numpy(spark):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(37, 8)), rng.normal(size=(211, 8))
    c[7] = 0
    qs = spark.createDataFrame([(i, [float(x) for x in v], f"g{i % 3}") for i, v in enumerate(q)], "query_id bigint, q array<float>, g string").repartition(3)
    cs = spark.createDataFrame([(i, [float(x) for x in v], f"g{i % 3}") for i, v in enumerate(c)], "vec_id bigint, embedding array<float>, g string").repartition(5)
    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
    s = np.round(np.divide(q @ c.T, length, out=np.zeros_like(length), where=length > 0), 5)
    got = {}
    for r in nearest.block_top_k(qs, cs, 5, block=16).collect():
        got.setdefault(r["query_id"], set()).add(r["corpus_id"])
    for i in range(len(q)):
        assert len(got[i] & set(np.argsort(-s[i])[:5].tolist())) >= 4
    for same in (True, False):
        for r in nearest.block_top_k(qs, cs, 4, block=16, **{"same" if same else "other": "g"}).collect():
            assert (r["query_id"] % 3 == r["corpus_id"] % 3) == same
    best = {(r["query_id"], r["g"]): r["score"] for r in nearest.block_group_best(qs, cs, "g", block=16).collect()}
    for i in range(len(q)):
        for g in range(3):
            assert best[i, f"g{g}"] == pytest.approx(s[i, g::3].max(), abs=2e-5)


def test_approximate_layouts_find_most(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.2 * rng.normal(size=16)]) for i in range(600)]
    c = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = c.where("vec_id < 40").selectExpr("vec_id AS query_id", "embedding AS q")
    exact = {(r["query_id"], r["corpus_id"]) for r in nearest.block_top_k(q, c, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in index.ivf_search(index.ivf(c, 6), q, 10, 3).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    probe = rows[0][1]
    want = {r["vec_id"] for r in nearest.search(c, probe, 10).collect()}
    small = {r[0] for r in index.int8_search(c, index.int8_bound(c), probe, k=10, rescore=5).select("vec_id").collect()}
    assert len(want & small) >= 9


POINT = "id string, document string, metadata map<string,string>, embedding array<float>"


def test_store_verbs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), 2)
    s.create("scenes", POINT)
    assert s.exists("scenes") and s.count("scenes") == 0 and s.names() == ["scenes"]
    one = spark.createDataFrame([("a", "x", {"k": "1"}, [1.0, 0.0]), ("b", "y", None, [0.0, 1.0])], POINT)
    s.upsert("scenes", one)
    s.upsert("scenes", one)
    assert s.count("scenes") == 2
    p = s.get("scenes")
    with pytest.raises(ValueError):
        store.add(p, one)
    change = spark.createDataFrame([("a", "z", None, False, None), ("b", None, None, True, None)], "id string, document string, metadata map<string,string>, metadata_given boolean, embedding array<float>")
    got = {r["id"]: r for r in store.update(p, change).collect()}
    assert got["a"]["document"] == "z" and got["a"]["metadata"] == {"k": "1"} and got["b"]["document"] == "y" and got["b"]["metadata"] is None
    with pytest.raises(KeyError):
        store.delete(p, spark.createDataFrame([("a",), ("nowhere",)], "id string"))
    assert [r["id"] for r in store.delete(p, spark.createDataFrame([("a",)], "id string")).collect()] == ["b"]
    assert store.scroll(p, 0).count() == 1 and store.scroll(p, 5, 1).first()["id"] == "b"
    assert s.index_movie(one, one.limit(0)) == 1
    s.reset()
    assert s.names() == []


def test_store_survives_its_session_object(spark, tmp_path):
    """Repeated ids: the last wins; a store opened anew knows its tables; parts are merged after some upserts; reset deletes."""
    folder = str(tmp_path / "kept")
    row = lambda i, d: (i, d, {"k": d}, [1.0, 0.0])
    one = store.Store(spark, folder, 2)
    first = one.upsert("scenes", spark.createDataFrame([row("a", "1"), row("a", "2"), row("b", "1")], POINT))
    assert {r["id"]: r["document"] for r in first.collect()} == {"a": "2", "b": "1"}
    again = store.Store(spark, folder, 2)
    assert again.names() == ["scenes"] and again.exists("scenes") and not again.exists("sentences")
    for k in range(10):
        batch = spark.createDataFrame([row("b", f"old{k}"), row(f"n{k}", "x"), row("b", f"new{k}")], POINT)
        got = {r["id"]: r["document"] for r in again.upsert("scenes", batch).collect()}
        assert got == {"a": "2", "b": f"new{k}", **{f"n{i}": "x" for i in range(k + 1)}}
        assert again.parts("scenes") < store.Store.COMPACT
    assert {r["id"]: r["document"] for r in one.get("scenes").collect()} == got  # the other object sees the newest version
    tuned = again.tune("scenes", files=2, sort=["id"])
    assert tuned.count() == 12 and again.parts("scenes") == 1
    import os

    again.reset("scenes")
    assert not one.exists("scenes") and "scenes" not in os.listdir(folder)
    with pytest.raises(KeyError):
        again.get("scenes")


def test_an_earlier_reader_keeps_its_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), 2)
    s.put("scenes", spark.createDataFrame([("a", "1", None, None)], POINT))
    before = s.get("scenes")
    s.upsert("scenes", spark.createDataFrame([("a", "2", None, None)], POINT))
    assert before.first()["document"] == "1" and s.get("scenes").first()["document"] == "2"


def test_order_decides_and_repeats_are_refused(spark):
    schema = POINT + ", at int"
    base = spark.createDataFrame([("a", "0", None, None, 0)], schema)
    batch = spark.createDataFrame([("a", "late", None, None, 9), ("a", "early", None, None, 3)], schema)
    assert store.upsert(base, batch, order="at").first()["document"] == "late" and store.upsert(base, batch).first()["document"] == "early"
    twice = spark.createDataFrame([("z", "1", None, None, 1), ("z", "2", None, None, 2)], schema)
    with pytest.raises(ValueError, match="repeats"):
        store.add(base, twice)


def test_null_vectors_take_no_part(spark):
    V = "vec_id bigint, embedding array<float>, g string"
    c = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 1.0], "y"), (None, [1.0, 1.0], "x"), (5, [1.0, None], "x")], V)
    q = c.selectExpr("vec_id AS query_id", "embedding AS q", "g")
    for partitions in (1, 3):
        got = nearest.block_top_k(q.repartition(partitions), c.repartition(partitions), 5).collect()
        assert {(r["query_id"], r["corpus_id"], r["score"]) for r in got} == {(1, 1, 1.0), (1, 3, 0.0), (3, 3, 1.0), (3, 1, 0.0)}
    best = {(r["query_id"], r["g"]): r["score"] for r in nearest.block_group_best(q, c, "g").collect()}
    assert best == {(1, "x"): 1.0, (1, "y"): 0.0, (3, "x"): 0.0, (3, "y"): 1.0}
    assert nearest.block_top_k(q, c.limit(0), 5).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0], "x")], V).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        nearest.block_top_k(q, odd, 5).collect()


def test_packing_vectors_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], f"g{i % 3}") for i in range(50)], "vec_id bigint, embedding array<float>, g string").repartition(4)
    made = nearest._blocks(rows, "vec_id", "embedding", 8, "c", "g", True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition above
    got = [(r["group"], len(r["c_ids"]), len(r["c_flat"])) for r in made.collect()]
    assert sum(n for _, n, _ in got) == 50 and all(f == 2 * n <= 16 for _, n, f in got) and len({g for g, _, _ in got}) == 3
