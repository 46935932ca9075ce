"""Generation with a stand-in model, evaluations on small cases, resumed runs."""

from __future__ import annotations

import json

import pytest

from vignette.operators import clean, evaluate, generate, lexical
from vignette.operators.store import Store

MOVIE = "movie_id string, movie_title string, overview string"


def test_synopsis_queries_drop_repeats_and_leaks(spark):
    movies = spark.createDataFrame([("a", "Silver Harbour", "a ship"), ("b", "B", " "), ("c", "C", None), ("d", None, "a train")], MOVIE)

    def ask(kind, fields):
        assert kind == "synopsis" and fields["n"] <= generate.SYNOPSIS_BATCH
        if fields["attempt"] == 0:
            return json.dumps({"queries": ["a man finds a ship", "A man FINDS the ship!", "storm in silver harbour tonight"]})
        return json.dumps({"queries": [f"sailor number {fields['attempt']} swims home"]})

    got = {r["movie_id"]: r["queries"] for r in generate.synopsis_queries(movies, ask, 4).collect()}
    assert got["a"] == ["a man finds a ship", "sailor number 1 swims home"] and got["b"] == got["c"] == []
    assert got["d"] == ["a man finds a ship", "storm in silver harbour tonight"][:2] + ["sailor number 1 swims home"]


def test_failing_models_are_asked_again(spark):
    movies = spark.createDataFrame([("a", "A", "x y")], MOVIE)
    calls = spark.sparkContext.accumulator(0)

    def ask(kind, fields):
        calls.add(1)
        raise RuntimeError("busy")

    assert generate.synopsis_queries(movies, ask, 4, tries=3).first()["queries"] == []
    assert calls.value == 6  # two rounds of three calls


def test_scene_queries_and_paraphrases(spark):
    scenes = spark.createDataFrame([("m", "Title Words", i, "x" * (10 - i)) for i in range(5)], "movie_id string, movie_title string, scene_index int, text string")
    answers = {10: '{"query": "somebody opens a door", "skip": false}', 9: '{"query": "no", "skip": true}', 8: '{"query": "title words here", "skip": false}'}
    got = generate.scene_queries(scenes, lambda kind, f: answers[len(f["scene_text"])]).collect()
    assert [(r["scene_idx"], r["query"]) for r in got] == [(0, "somebody opens a door")]
    q = spark.createDataFrame([(1, "q", "T")], "query_id int, query string, movie_title string")
    assert generate.paraphrases(q, lambda k, f: '["one way", "other way"]').count() == 2


def test_raw_queries_leave_out_what_is_done(spark):
    movies = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], MOVIE)
    scenes = spark.createDataFrame([("a", "A", 0, "t"), ("b", "B", 0, "t")], "movie_id string, movie_title string, scene_index int, text string")
    done = spark.createDataFrame([("a",)], "movie_id string")
    rows = generate.raw_queries(movies, scenes, lambda k, f: json.dumps({"queries": ["four plain words here"], "query": "scene words right here"}), done).collect()
    assert {(r["movie_id"], r["query_type"], r["scene_idx"]) for r in rows} == {("b", "synopsis", None), ("b", "scene_summary", 0)}


def test_a_broken_run_goes_on(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    todo = spark.createDataFrame([(f"m{i}", i) for i in range(40)], "movie_id string, n int")
    seen = []

    def step(rows):
        seen.append(rows.count())
        if len(seen) == 3:
            raise RuntimeError("stop")
        return rows.where("n % 10 <> 0").selectExpr("movie_id", "n * 2 AS m")

    with pytest.raises(RuntimeError):
        generate.resumed(todo, step, store, "out", every=10)
    assert 0 < store.count("out") < 36
    generate.resumed(todo, step, store, "out", every=10)
    assert {r["movie_id"]: r["m"] for r in store.get("out").collect()} == {f"m{i}": 2 * i for i in range(40) if i % 10}
    assert generate.progress(store, "out", 40) == (36, 40, 90.0) and generate.progress(store, "none", 0) == (0, 0, 0.0)
    seen[:] = [0] * 5
    assert generate.resumed(todo, step, store, "out", every=10) == 0 and seen[5:] == [4]  # keys without rows are tried again


def test_evaluations(spark):
    q = spark.createDataFrame([(1, "a", "a"), (2, "b", "b"), (3, "z", "z")], "query_id int, movie_key string, query string")
    R = "query_id int, rank int, movie_key string, movie_name string"
    lists = [[(1, 1, "b", "B"), (1, 2, "a", "A"), (2, 1, "c", "C")], [(1, 1, "a", "A"), (2, 1, "b", "B")]]
    retrieve = lambda asked, top_k, run: spark.createDataFrame(lists[run], R)
    one = evaluate.run_pipeline(q, retrieve).first()
    assert (one["correct_at_5"], one["mrr"], one["median_rank"], one["failed"]) == (1, round(0.5 / 3, 3), 2, 2)
    two = evaluate.run_pipeline(q, retrieve, runs=2).first()
    assert (two["correct_at_5"], two["failed"]) == (2, 1)
    known = spark.createDataFrame([("a",), ("b",)], "movie_key string")
    row = evaluate.run_scene_eval(q, retrieve, known).first()
    assert (row["total_queries"], row["skipped_missing_target"], row["correct_at_20"]) == (2, 1, 1)
    none = evaluate.run_scene_eval(q, retrieve, known.limit(0)).first()
    assert (none["total_queries"], none["mrr"], none["accuracy_at_5"], none["median_rank"], none["skipped_missing_target"]) == (0, 0.0, 0.0, None, 3)
    leaked = spark.createDataFrame([(1, False), (2, True), (3, None), (4, False)], "query_id int, leaked boolean")
    assert [r["query_id"] for r in evaluate.clean_queries(leaked, 2).collect()] == [1, 3]


def test_corpus_of_scripts(spark):
    meta = spark.createDataFrame([("a", None, "fa"), ("b", "B", "fb"), ("c", "C", None), ("d", "D", "fd"), ("e", "E", "fe")], "key string, name string, file_name string")
    scene = "INT. ROOM - DAY\n" + "somebody talks about the weather. " * 10
    texts = spark.createDataFrame([("fa", "\n".join([scene] * 4)), ("fb", "short script"), ("fd", " \n "), ("other", "x")], "file_name string, text string")
    docs, missing = lexical.corpus(meta, texts)
    rows = docs.collect()
    assert sorted((r["movie_key"], r["movie_name"]) for r in rows) == [("a", "a")] * 3 + [("b", "B")] and len({r["doc_id"] for r in rows}) == 4
    assert {r["movie_key"] for r in missing.collect()} == {"d", "e"}
    assert lexical.build(docs).postings.where("term = 'weather'").count() == 3


def test_regenerated_queries_do_not_repeat_kept_ones(spark):
    rows = spark.createDataFrame([(1, "m", "T", "a sailor finds a map of the drowned northern city", "synopsis"), (2, "m", "T", "", "synopsis")], "row_id bigint, movie_id string, movie_title string, query string, query_type string")
    from pyspark.sql import functions as F

    out = clean.cleaned(rows, can_regenerate=F.lit(True), generate=lambda wait: wait.select("row_id", F.lit("a sailor finds a map of the drowned northern city").alias("query"))).collect()
    told = {r["row_id"]: (r["action"], r["reject_reason"], r["duplicate"]) for r in out}
    assert told[1][0] == "keep" and told[2] == ("reject", "duplicate_within_movie", "exact")
