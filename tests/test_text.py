from __future__ import annotations

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from vignette.functions import ids, repair, text, vectors
from vignette.operators import clean, leakage, lookup, parse


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_ids_equal_python(spark):
    for name in ("m::scene_0001", "é::x", ""):
        assert one(spark, ids.uuid5(F.col("a")), a=name) == str(uuid.uuid5(ids.NAMESPACE, name))
    assert one(spark, text.slug(F.col("a")), a="  Dr. Who?! ") == "dr-who" and one(spark, text.slug(F.col("a")), a="é") == "unknown"
    assert one(spark, text.is_noise_name(F.col("a")), a="É") is False and one(spark, text.is_noise_name(F.col("a")), a="_-_") is True
    assert one(spark, ids.movie_id(F.col("a")), a="The Spider-Man") == "the_spider_man"


CASES = [
    ("", None, "empty", "empty_query"),
    ('{"query": "a man betrays his oldest friend"}', "a man betrays his oldest friend", "parsed_json_wrapper", None),
    ('"a man betrays his oldest friend"', "a man betrays his oldest friend", "parsed_json_wrapper", None),
    ('```json\n{"query": "a man betrays his oldest friend"}\n```', "a man betrays his oldest friend", "parsed_fenced_json_wrapper", None),
    ('{"query": "a man betrays his oldest friend", "skip', "a man betrays his oldest friend", "salvaged_partial_json", None),
    ('{"query": "a man betrays his oldest', "a man betrays his oldest", "salvaged_partial_json", None),
    ('{"query": "a man betrays his friend", "skip": true}', "a man betrays his friend", "salvaged_partial_json", None),
    ('{"query": "too short', None, "as_is", "json_wrapper_artifact"),
    ("a man betrays his friend and", None, "as_is", "likely_truncated"),
    ("two words", None, "as_is", "too_short"),
    ("a  man betrays   his friend", "a man betrays his friend", "normalized_plain_text", None),
    ("a man betrays his friend", "a man betrays his friend", "as_is", None),
    ("“a man betrays his friend”", "a man betrays his friend", "parsed_json_wrapper", None),
    ("```\na man betrays his friend\n```", "a man betrays his friend", "normalized_plain_text", None),
    ('{"query": 5}', None, "as_is", "json_wrapper_artifact"),
]


def test_repair(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(CASES)] + [(len(CASES), None)], "row_id int, query string")
    got = {r["row_id"]: r for r in clean.repaired(rows).collect()}
    for i, (_, cleaned, method, reason) in enumerate([*CASES, (None, None, "empty", "empty_query")]):
        assert (got[i]["cleaned_query"], got[i]["repair_method"], got[i]["structural_reason"]) == (cleaned, method, reason), i
    assert got[3]["repair_flags"] == ["markdown_fence", "had_json_wrapper"] and got[4]["repair_flags"] == ["had_json_wrapper", "partial_json_salvaged"]


@pytest.mark.parametrize(
    ("query", "kind", "flags"),
    [
        ("a nurse hides a stolen letter inside the old piano", "synopsis", []),
        ("a film about someone", "synopsis", ["banned_synopsis_prefix", "generic_low_information", "soft_too_short", "low_content_density"]),
        ('{"query": "x', "scene_summary", ["json_wrapper_artifact", "likely_truncated", "soft_too_short", "low_content_density"]),
        ("Anna meets Bert near the harbour, the mill; the church and the station", "synopsis", ["character_name_leakage", "overstuffed_clauses"]),
        ("why does the storm harbour pilot steer against orders exploring redemption", "synopsis", ["title_leakage", "abstract_theme_wording", "question_meta_style"]),
    ],
)
def test_scores(spark, query, kind, flags):
    row = spark.createDataFrame([(query, "The Storm Harbour", kind)], "cleaned_query string, movie_title string, query_type string")
    got = clean.scored(row).first()
    if flags[:1] == ["character_name_leakage"]:
        flags = [*flags]
    cost = {"json_wrapper_artifact": 0.6, "likely_truncated": 0.45, "banned_synopsis_prefix": 0.25, "title_leakage": 0.2, "character_name_leakage": 0.2, "generic_low_information": 0.2, "abstract_theme_wording": 0.1, "low_content_density": 0.1, "question_meta_style": 0.1}
    assert got["quality_flags"] == flags
    assert got["quality_score"] == pytest.approx(max(0.0, round(1 - sum(cost.get(f, 0.15) for f in flags), 4)))


def brute_greedy(rows: list[tuple]) -> dict[int, str]:
    """rows (id, scope, query, score): the sequential removal, written out."""
    words = lambda q: [w for w in re.findall("[a-z0-9]+", q.lower()) if w not in text.QUERY_STOPS]
    out, kept = {}, []
    for i, scope, q, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        mine = [k for k in kept if k[1] == scope]
        a = set(words(q))

        def near(b):
            b = set(b)
            return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)

        exact = any(words(k[2]) == words(q) for k in mine)
        close = any(near(words(k[2])) >= 0.85 for k in mine)
        out[i] = "exact" if exact else "near" if close else "survivor"
        if not exact and not close:
            kept.append((i, scope, q))
    return out


def test_greedy_removal_equals_the_sequential_one(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 2)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(base)
            q = " ".join(base)
        else:
            q = " ".join(rng.choices(vocabulary, k=rng.choice([0, 8, 12, 14])))
        rows.append((i, f"s{rng.randrange(2)}", q, rng.choice([0.8, 0.9, 1.0])))
    df = spark.createDataFrame(rows, "row_id int, scope string, cleaned_query string, score double")
    for scope in (["scope"],):
        got = {r["row_id"]: r["verdict"] for r in clean.greedy_survivors(df, scope, [(-F.col("score")).alias("s")]).collect()}
        assert got == brute_greedy([(i, s if scope else "", q, x) for i, s, q, x in rows])
    assert clean.greedy_survivors(df.limit(0), [], [(-F.col("score")).alias("s")]).count() == 0


def test_cleaning_job(spark):
    q = "a nurse hides a stolen letter inside the old piano"
    rows = [(0, "m", "T", q, "synopsis"), (1, "m", "T", q + "!", "synopsis"), (2, "n", "T", q, "synopsis"), (3, "n", "T", "short", "scene_summary"), (4, "n", "T", "someone walks a man talks friends wait there", "synopsis")]
    df = spark.createDataFrame(rows, "row_id int, movie_id string, movie_title string, query string, query_type string")
    done = clean.cleaned(df)
    got = {r["row_id"]: (r["action"], r["reject_reason"], r["duplicate"]) for r in done.collect()}
    assert got == {0: ("keep", None, None), 1: ("reject", "duplicate_within_movie", "exact"), 2: ("reject", "duplicate_global", "exact"), 3: ("reject", "too_short", None), 4: ("reject", "below_quality", None)}
    kept, audit, rejected = clean.outputs(done)
    assert (kept.count(), audit.count(), rejected.count()) == (1, 5, 4)
    assert clean.report(done).where("query_type IS NULL").first()["keep"] == 1
    again = clean.cleaned(df, can_regenerate=F.lit(True), generate=lambda w: w.select("row_id", F.concat(F.lit("the captain sells a stolen map to rival smugglers "), "row_id").alias("query")))
    got = {r["row_id"]: (r["action"], r["was_regenerated"]) for r in again.collect()}
    assert got[3] == ("regenerate", True) and got[0] == ("keep", False)
    assert clean.first_movies(df, 1).count() == 2


def test_replies(spark):
    for raw, want in [
        ('{"queries": ["one \\"quoted\\" a", "two", " "]}', ['one "quoted" a', "two"]),
        ('```json\n["x", "y"]\n```', ["x", "y"]),
        ('{"queries": ["whole one", "whole \\"two\\"", "cut of', ["whole one", 'whole "two"']),
        ('{"paraphrases": ["a ] b", "c"', ["a ] b", "c"]),
        ("no list", []),
        ('["' + "x" * 50_000 + '", "cut', ["x" * 50_000]),
    ]:
        assert one(spark, repair.string_list(F.col("a")), a=raw) == want, raw
    assert one(spark, repair.string_list(F.col("a"), "mine"), a=json.dumps({"queries": ["q"], "mine": ["m"]})) == ["m"]
    for raw, want in [('{"query": "a b", "skip": false}', "a b"), ('{"query": "a b", "skip": true}', None), ("SKIP", None), ("plain words", "plain words"), ("w " * 60, None)]:
        assert one(spark, repair.scene_summary(F.col("a")), a=raw) == want, raw


def test_leakage(spark):
    titles = leakage.forbidden_titles(spark.createDataFrame([("It",), ("The",), ("Blue Harbour",), ("Up and Away",)], "name string"))
    asked = [(0, "who sailed to the blue harbour at night", "Night Train"), (1, "the night train leaves", "Night Train"), (2, "a blue harbourmaster", "Up and Away"), (3, None, None)]
    got = {r["query_id"]: r for r in leakage.check(spark.createDataFrame(asked, "query_id int, query string, movie_title string"), titles).collect()}
    assert got[0]["others"] == ["blue harbour"] and got[0]["leakage_score"] == pytest.approx(0.3) and got[0]["partial"] == ["night"]
    assert got[1]["direct"] and got[1]["has_leakage"] and got[2]["leakage_score"] == 0.0 and got[3]["direct"]


def test_lookup(spark):
    movies = spark.createDataFrame([("12monkeys", "12 Monkeys", "Twelve Monkeys", "12-Monkeys"), ("matrix", "Matrix, The", None, None), ("thematrix2", "The Matrix", None, None)], "key string, name string, title string, file_name string")
    got = {r["alias"]: (r["key"], r["conflict"]) for r in lookup.build(movies).collect()}
    assert got["twelvemonkeys"] == ("12monkeys", False) and got["matrix"] == ("matrix", False) and got["thematrix"] == ("thematrix2", False)


def test_parse_keeps_order(spark):
    script = "N: dawn\nS: INT. ROOM\nC: ANN\nE: V.O.\nD: hello: you\nD: again\nnoise\nS: EXT. SEA\nD: who?\nT: CUT"
    lines = parse.tagged_lines(spark.createDataFrame([("m", script)], "movie_id string, value string"), "movie_id")
    s = parse.sentences(lines, ["movie_id"]).orderBy("position_in_script").collect()
    assert [(r["scene_index"], r["line_type"], r["character_name"]) for r in s] == [(-1, "description", None), (0, "dialogue", "ANN"), (0, "dialogue", "ANN"), (1, "dialogue", None), (1, "transition", None)]
    scenes = parse.scenes(lines, ["movie_id"]).orderBy("scene_index").collect()
    assert [r["text"] for r in scenes] == ["INT. ROOM\nANN (V.O.): hello: you\nANN: again", "EXT. SEA\nNone: who?\nCUT"]
    assert [r["character_names"] for r in scenes] == [["ANN"], []]


def test_vector_guards(spark):
    row = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert row.select(vectors.unit(F.col("v")).alias("u")).first()["u"] == [0.6, 0.8]
    with pytest.raises(Exception, match="expected 3"):
        row.select(vectors.checked(F.col("v"), 3)).collect()
