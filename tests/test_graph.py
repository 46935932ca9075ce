from __future__ import annotations

import pytest

from vignette.facade import Engine, Unavailable
from vignette.hooks import hashing_encoder, keyword_translator, translate
from vignette.operators import fuse, graph
from vignette.plans.pattern import Pattern, compile_pattern, with_details

ENTITY = "movie_id string, name string, entity_type string"
RELATION = "movie_id string, from_name string, from_type string, to_name string, to_type string, label string, evidence string"


@pytest.fixture(scope="module")
def built(spark):
    raw = spark.createDataFrame([("movie-a", n, "PERSON") for n in ("Alice", "Bob", "Carol")] + [("movie-b", n, "PERSON") for n in ("Dana", "Eve", "Finn")] + [("movie-a", " - ", "PERSON"), ("movie-a", "Rome", "CITY")], ENTITY)
    p = "PERSON"
    relations = spark.createDataFrame(
        [("movie-a", "Alice", p, "Bob", p, "TEACHES", "shows him"), ("movie-a", "Bob", p, "Carol", p, "BETRAYS", "sells her"), ("movie-a", "Bob", p, "Carol", p, "BETRAYS", "sells her"), ("movie-b", "Dana", p, "Eve", p, "SAVES", "pulls her out")]
        + [("movie-b", "Dana", p, "Zed", p, "SAVES", "x"), ("movie-b", "Dana", p, "Dana", p, "TEACHES", "x"), ("movie-b", "Dana", p, "Eve", p, "EATS", "x"), ("movie-b", "Dana", p, "Eve", p, "SAVES", " "), ("movie-b", "Dana", p, "Eve", "CITY", "SAVES", "x"), ("movie-b", "Yan", p, "Eve", p, "SAVES", "x"), ("movie-b", "--", p, "Eve", p, "SAVES", "x"), ("movie-b", None, None, None, None, None, None)],
        RELATION,
    )
    entities = graph.normalize_entities(raw)
    kept, dropped = graph.normalize_relations(relations, entities)
    return entities.cache(), kept.cache(), dropped.cache()


def test_counts_and_reasons(built):
    entities, kept, dropped = built
    c = graph.counts(entities, kept).first()
    assert (c["movies"], c["entities"], c["relations"], c["edges"]) == (2, 6, 3, 9)
    told = graph.summary(entities, kept, dropped).first()
    assert told["nodes"] == 8 and told["dropped"] == 8
    assert told["dropped_by_reason"] == dict.fromkeys(["blank_entity_name", "empty_evidence", "invalid_entity_type", "invalid_predicate", "malformed_relation", "missing_from_entity", "missing_to_entity", "self_relation"], 1)


def test_ids_are_stable(built):
    assert {r["entity_id"] for r in built[0].collect()} >= {"movie-a:person:alice", "movie-b:person:finn"}
    assert all(len(r["relation_id"].split(":rel:")[1]) == 16 for r in built[1].collect())


def test_path(built):
    entities, kept, _ = built
    got = with_details(compile_pattern(Pattern(["teaches", " betrays "], limit=5), kept), entities, kept).collect()
    assert [[s["entity_name"] for s in r["path"]] for r in got] == [["Alice", "Bob", "Carol"]]
    assert got[0]["score"] == 2.03 and [e["predicate"] for e in got[0]["evidences"]] == ["TEACHES", "BETRAYS"]
    assert compile_pattern(Pattern(["TEACHES"], contains_entities=["Dana"]), kept).isEmpty()


@pytest.mark.parametrize("bad", [{"predicates": []}, {"predicates": ["EATS"]}, {"predicates": ["SAVES"], "limit": 0}, {"predicates": ["SAVES"], "entity_types": ["CITY"]}])
def test_pattern_requests_are_checked(bad):
    with pytest.raises(ValueError):
        Pattern(**bad)


def test_details_of_a_movie(built):
    entities, kept, _ = built
    own, out, into = graph.movie_details(entities, kept, "movie-a")
    assert own.count() == 3 and [r["from_name"] for r in out.collect()] == ["Alice", "Bob"] and [r["to_name"] for r in into.collect()] == ["Bob", "Carol"]
    with pytest.raises(KeyError):
        graph.movie_details(entities, kept, "nowhere")


def test_names_are_cleaned(spark):
    rows = [(0, "JOHN (V.O.)", "PERSON", 0), (0, "John", "PERSON", 1), (0, "INT. HOUSE", "FAC", 2), (0, "Mary's", "PERSON", 3), (0, "day", "PERSON", 4), (0, "b-b-but", "PERSON", 5), (0, "Man of", "PERSON", 6), (0, "Acme", "CITY", 7)]
    got = graph.clean_entities(spark.createDataFrame(rows, "m int, text string, label string, ord int"), ["m"]).orderBy("ord").collect()
    assert [(r["text"], r["ord"]) for r in got] == [("John", 0), ("Mary", 3)]


def test_fusion_halves_in_order(spark):
    s = spark.createDataFrame([(0, "a", 0.8), (0, "b", 0.4)], "query_id int, movie_id string, score double")
    g = spark.createDataFrame([(0, "a", 2.0, 0), (0, "a", 1.0, 1), (0, "c", 1.0, 2)], "query_id int, movie_id string, score double, ord int")
    got = {r["movie_id"]: (r["score"], r["graph_score"]) for r in fuse.merge_hits(s, g, 10).collect()}
    assert got["a"] == (0.75, 1.0) and got["b"] == (0.5, None) and got["c"] == (0.5, 1.0)


def test_translation():
    assert translate("who betrays whom", 5, None).status == "unavailable"
    assert translate("nice weather", 5, keyword_translator).status == "skipped"
    made = translate("someone who teaches and then betrays", 5, keyword_translator)
    assert made.status == "translated" and made.pattern.words["predicates"] == ["TEACHES", "BETRAYS"]
    assert translate("x", 5, lambda q, n: "not json").status == "failed"
    assert translate("x", 5, lambda q, n: '```json\n{"predicates": ["EATS"]}\n```').status == "failed"


def test_engine(spark, built):
    entities, kept, _ = built
    enc = hashing_encoder(32)
    scene = lambda m, i, t: (m, m, f"{m}-{i}", i, t, [float(x) for x in enc([t])[0]], i)
    rows = [scene("movie-a", 0, "a teacher betrays a friend"), scene("movie-a", 1, "rain on the road"), scene("movie-b", 0, "a rescue at sea")]
    scenes = spark.createDataFrame(rows, "movie_id string, movie_title string, scene_id string, scene_index int, text string, embedding array<float>, vec_id int")
    e = Engine(spark, scenes, scenes, entities, kept, enc, keyword_translator)
    assert e.ready() and all(e.health().values())
    assert e.search("a teacher betrays a friend").orderBy("rank").first()["best_scene"] == "movie-a-0"
    assert e.search_scenes("rescue at sea", 1).first()["scene_id"] == "movie-b-0"
    found, told, strategy = e.query("a teacher betrays a friend")
    assert strategy == "hybrid" and told.status == "translated" and found.orderBy("rank").first()["movie_id"] == "movie-a"
    graph_only = Engine(spark, entities=entities, relations=kept, translator=keyword_translator)
    assert graph_only.query("who saves whom")[2] == "graph_only"
    with pytest.raises(Unavailable):
        graph_only.search("x")
    with pytest.raises(ValueError):
        e.search(" ")


def test_engine_over_a_store(spark, tmp_path):
    """Build, reload and serve; an engine opened anew finds the graph and lacks the levels."""
    p = "PERSON"
    entities = spark.createDataFrame([("movie-a", n, p) for n in ("Alice", "Bob", "Carol")] + [("movie-b", "Dana", p)], ENTITY)
    relations = spark.createDataFrame([("movie-a", "Alice", p, "Bob", p, "TEACHES", "x"), ("movie-a", "Bob", p, "Carol", p, "BETRAYS", "y"), ("movie-b", "Dana", p, "Zed", p, "SAVES", "z")], RELATION)
    e = Engine.open(spark, str(tmp_path), translator=keyword_translator)
    assert not e.ready() and e.graph_health()["status"] == "not_ready" and e.graph_health()["last_build"] is None
    with pytest.raises(Unavailable):
        e.movie("movie-a")
    told = e.build_graph(entities, relations).first()
    assert (told["movies"], told["entities"], told["relations"], told["dropped"], told["mode"]) == (2, 4, 2, 1, "full")
    assert told["dropped_by_reason"] == {"missing_to_entity": 1}
    with pytest.raises(ValueError):
        e.build_graph(entities, relations, "movie-a", rebuild=True)
    with pytest.raises(ValueError):
        e.build_graph(entities, relations, "nowhere")
    e.build_graph(entities.where("name <> 'Carol'"), relations, "movie-a")
    again = Engine.open(spark, str(tmp_path))
    h = again.graph_health()
    assert h["status"] == "ready" and h["counts"] == {"movies": 2, "entities": 3, "relations": 1, "edges": 4}
    assert h["last_build"]["mode"] == "movie" and h["last_build"]["requested"] == "movie-a" and h["last_build"]["number"] == 1
    assert again.pattern(Pattern(["TEACHES"])).count() == 1 and again.health() == {"vectors": False, "graph": True, "encoder": False}
    again.build_graph(entities.where("movie_id = 'movie-b'"), relations, rebuild=True)
    assert again.graph_health()["counts"] == {"movies": 1, "entities": 1, "relations": 0, "edges": 1}


def test_titles_of_source_files(spark):
    rows = [("a", "The-Long-Day.txt", "x.txt"), ("b", None, "/p/q/Other-One.v2.pdf"), ("c-d", "", None)]
    got = {r["movie_id"]: (r["title"], r["source_file"]) for r in graph.titled(spark.createDataFrame(rows, "movie_id string, entity_file string, relation_file string")).collect()}
    assert got == {"a": ("The Long Day", "The-Long-Day.txt"), "b": ("Other One.v2", "/p/q/Other-One.v2.pdf"), "c-d": ("c d", "c-d.txt")}


def test_filters_and_extractors_that_fail(spark):
    e = spark.createDataFrame([("m", "Ann", "PERSON", 0), ("m", "Bo", "PERSON", 1), ("n", "Cy", "PERSON", 0)], "movie_id string, text string, label string, ord int")
    assert graph.filtered_entities(e, None).count() == 3
    got = graph.filtered_entities(e, lambda l: [{"text": x["text"].upper(), "label": x["label"]} for x in l if x["text"] != "Bo"]).collect()
    assert {(r["movie_id"], r["text"]) for r in got} == {("m", "ANN"), ("n", "CY")}
    assert graph.filtered_entities(e, lambda l: l[99]).count() == 3
    texts = spark.createDataFrame([("m", "t"), ("n", "t")], "movie_id string, text string")
    answer = '[{"from": "Ann", "from_type": "PERSON", "to": "Bo", "to_type": "PERSON", "label": "SAVES", "evidence": "e"}]'
    found = graph.extracted_relations(texts, e, lambda t, names: answer if "Ann" in names else "no json").collect()
    assert [(r["movie_id"], r["from_name"], r["to_name"]) for r in found] == [("m", "Ann", "Bo")]
