from __future__ import annotations

import json

import pytest

from vignette.config import Settings, storage_url, truth
from vignette.hooks import capitalised_names, encode, hashing_encoder
from vignette.operators import lookup, mine
from vignette.operators.store import Store
from vignette.sources import files
from vignette.streaming import ingest


def test_scripts_and_encodings(spark, tmp_path):
    (tmp_path / "movie-a_parsed.txt").write_bytes("S: INT. ROOM\nC: ANN\nD: café: now\nnoise\n".encode() + b"N: bad \xff byte\n")
    got = files.tagged_scripts(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["movie_id"], r["tag"], r["content"]) for r in got][:3] == [("movie-a", "S", "INT. ROOM"), ("movie-a", "C", "ANN"), ("movie-a", "D", "café: now")]
    assert got[3]["content"] == "bad � byte" and [r["line_no"] for r in got] == [0, 1, 2, 4]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "latin.txt").write_bytes("café".encode("latin-1"))
    (raw / "utf.txt").write_bytes("café".encode())
    assert {r["text"] for r in files.whole_texts(spark, str(raw)).collect()} == {"café"}
    listing = spark.createDataFrame([("/d/a_parsed.txt",), ("/d/a.txt",), ("/d/b.txt",)], "path string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "file_name string")
    assert {r["file_name"]: r["path"] for r in files.tagged_paths(names, listing).collect()} == {"a": "/d/a_parsed.txt", "b": "/d/b.txt", "c": None}


def test_json_sources(spark, tmp_path):
    meta = {"matrix": {"file": {"name": "The Matrix", "file_name": "The-Matrix"}, "tmdb": {"title": "Matrix", "overview": "a b"}}, "it": {"file": {"name": "It"}}}
    (tmp_path / "meta.json").write_text(json.dumps(meta))
    rows = {r["key"]: r for r in files.metadata(spark, str(tmp_path / "meta.json")).collect()}
    assert rows["matrix"]["title"] == "Matrix" and rows["it"]["title"] is None
    (tmp_path / "e").mkdir()
    (tmp_path / "r").mkdir()
    (tmp_path / "e" / "movie-a_entities.json").write_text(json.dumps({"entities": [{"text": "Ann", "label": "PERSON"}]}))
    (tmp_path / "r" / "movie-a_relations.json").write_text(json.dumps({"relations": [{"from": "Ann", "from_type": "PERSON", "to": "Bo", "to_type": "PERSON", "label": "SAVES", "evidence": "x"}]}))
    e, r = files.extracted(spark, str(tmp_path / "e"), str(tmp_path / "r"))
    assert e.first()["movie_id"] == r.first()["movie_id"] == "movie-a" and r.first()["to_name"] == "Bo"
    assert files.extracted(spark, str(tmp_path / "e"))[1].count() == 0
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"movie_id": "m", "query": "a"}\n\n{"movie_id": "m", "query": "b"}\n')
    assert files.json_lines(spark, str(lines)).count() == 2
    lines.write_text('{"movie_id": "m", "query": "a"}\n{broken\n')
    assert len(files.json_lines(spark, str(lines), lenient=True).collect()) == 1
    with pytest.raises(Exception):
        files.json_lines(spark, str(lines)).collect()


def test_eval_files(spark, tmp_path):
    known = lookup.build(spark.createDataFrame([("matrix", "The Matrix", None, None)], "key string, name string, title string, file_name string"))
    flat = [{"query": "a b", "movie_id": "matrix"}, {"query": "{broken", "movie_id": "matrix"}, {"query": "c", "movie_id": "matrix", "validation": {"has_leakage": True}}, {"query": "d", "movie_id": "nowhere"}]
    (tmp_path / "flat.json").write_text(json.dumps(flat))
    got = files.eval_queries(spark, str(tmp_path / "flat.json"), known).collect()
    assert [(r["query_id"], r["movie_key"]) for r in got] == [(0, "matrix")]
    (tmp_path / "nested.json").write_text(json.dumps({"evaluation_queries": flat}))
    assert files.eval_queries(spark, str(tmp_path / "nested.json"), known).count() == 3
    assert files.eval_queries(spark, str(tmp_path / "nested.json"), known, clean_only=False).count() == 4


def test_annotations_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("person_id,query_id,query_text,engine,rank,movie_key,movie_title,movie_overview,relevance_grade\nP1,1,q,e,1,m,t,o,2\nP1,1,q,e,2,n,t,o,\nP1,1,q,e,3,o,t,o,five\nP1,1,q,e,4,p,t,o,3\n")
    rows = files.annotations(spark, str(tmp_path / "a.csv"))
    assert [(r["movie_key"], r["grade"]) for r in rows.collect()] == [("m", 2.0)]
    files.write_csv(rows, str(tmp_path / "csv"))
    files.write_report(rows, str(tmp_path / "report"))
    files.append_json_lines(rows, str(tmp_path / "lines"))
    files.append_json_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_settings():
    assert Settings.read({}) == Settings()
    s = Settings.read({"VIGNETTE_ENV": "dev", "VIGNETTE_DEV_MODE": "memory", "VIGNETTE_MODE": "server", "VIGNETTE_URL": "host:1/", "VIGNETTE_HTTPS": "yes"})
    assert s.mode == "local" and s.url == "https://host:1" and storage_url(" ") is None
    for bad in ({"VIGNETTE_MODE": "x"}, {"VIGNETTE_QUANTILE": "2"}, {"VIGNETTE_TOP_K": "99"}, {"VIGNETTE_INT8": "maybe"}):
        with pytest.raises(ValueError):
            Settings.read(bad)
    assert truth("On") and not truth("")


def test_encoding(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "c")], "id int, text string")
    got = encode(rows, hashing_encoder(16), 16).collect()
    assert all(sum(x * x for x in r["embedding"]) == pytest.approx(1, abs=1e-5) for r in got)
    with pytest.raises(Exception, match="blank"):
        encode(spark.createDataFrame([(1, " ")], "id int, text string"), hashing_encoder(16), 16).collect()
    with pytest.raises(Exception, match="returned"):
        encode(rows, hashing_encoder(8), 16).collect()
    names = capitalised_names(spark.createDataFrame([(1, "then Ann Lee met Bo and Ann Lee left")], "k int, text string"), "k").orderBy("ord").collect()
    assert [r["text"] for r in names] == ["Ann Lee", "Bo"]


def test_streams(spark, tmp_path):
    schema = "id string, document string"
    source = tmp_path / "in"
    spark.createDataFrame([("a", "1"), ("b", "1")], schema).write.parquet(str(source))
    store = Store(spark, str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    ingest.upserts(stream(), store, "points", str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("b", "2"), ("c", "2")], schema).write.mode("append").parquet(str(source))
    ingest.upserts(stream(), store, "points", str(tmp_path / "c")).awaitTermination()
    assert {r["id"]: r["document"] for r in store.get("points").collect()} == {"a": "1", "b": "2", "c": "2"}


def test_mining_helpers(spark):
    scenes = spark.createDataFrame([(i, f"m{i % 4}", [float(i % 5), 1.0]) for i in range(40)], "vec_id bigint, movie_id string, embedding array<float>")
    asked = spark.createDataFrame([(100 + i, f"m{i}", [1.0, 1.0]) for i in range(4)], "query_id bigint, movie_id string, q array<float>")
    for parts in (1, 5):
        drawn = mine.random_negatives(asked, scenes.repartition(parts), 3).join(scenes, "vec_id").collect()
        assert len({(r["query_id"], r["vec_id"]) for r in drawn}) == 12 and all(f"m{r['query_id'] - 100}" != r["movie_id"] for r in drawn)
    few = mine.random_negatives(asked, scenes.where("vec_id < 2"), 3).collect()
    assert len(few) == 6
    # a movie with most scenes, one without any, and every number of others from 0 on
    skewed = spark.createDataFrame([(i, "big" if i < 90 else f"m{i % 3}", [1.0]) for i in range(100)], "vec_id bigint, movie_id string, embedding array<float>")
    many = spark.createDataFrame([(i, ["big", "m0", "none"][i % 3], [1.0]) for i in range(300)], "query_id bigint, movie_id string, q array<float>")
    drawn = mine.random_negatives(many, skewed, 7).join(skewed, "vec_id").join(many.withColumnRenamed("movie_id", "asked"), "query_id").collect()
    assert len({(r["query_id"], r["vec_id"]) for r in drawn}) == len(drawn) == 2100 and all(r["movie_id"] != r["asked"] for r in drawn)
    assert len({r["vec_id"] for r in drawn}) == 100 and len({r["vec_id"] for r in drawn if r["asked"] == "big"}) == 10
    for k in range(6):
        assert mine.random_negatives(asked.limit(1), scenes.where(f"movie_id = 'm0' OR vec_id < {k}"), 3).count() == min(3, sum(i % 4 != 0 for i in range(k)))
    study = mine.assignments([str(i) for i in range(10)], ["x", "y"], 4, 6)
    seen = [(p, q) for p, q, _ in study]
    assert len(seen) == len(set(seen)) and all(sum(p == f"P0{i}" for p, *_ in study) <= 6 for i in range(1, 5))
    paged = mine.grid(scenes, contains={"movie_id": "M1"}, order=["vec_id"], page=1, size=4)
    assert [r["vec_id"] for r in paged.collect()] == [17, 21, 25, 29] and mine.grid(scenes, fuzzy={"movie_id": "mm1"}, size=100).count() == 40
