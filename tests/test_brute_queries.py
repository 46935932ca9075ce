"""Queries without SQL against brute-force versions in plain Python, on whole small tables."""

from __future__ import annotations

import json
import re

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from vignette import catalog
from vignette.functions.text import QUERY_STOPS
from vignette.functions.vocabulary import ENTITY_TYPES
from vignette.operators import parse
from vignette.sources import views

Q = catalog.queries()


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def test_p14_paragraphs(spark):
    want = {}
    for r in table(spark, "documents"):
        chunks, now = [], ""
        for part in r["text"].replace("\n", "\n\n").split("\n\n"):
            if len(now) + len(part) > 4000 and now:
                chunks.append(now.strip())
                now = part
            else:
                now = now + "\n\n" + part
        if now.strip():
            chunks.append(now.strip())
        want[r["doc_id"]] = [len(c) for c in chunks]
    got = {r["doc_id"]: (r["chunks"], r["sizes"]) for r in Q["p14_packed_paragraphs"](spark, SMALL).collect()}
    assert got == {i: (len(s), s) for i, s in want.items()}


def test_p15_one_scene_of_every_script(spark):
    scenes = parse.scenes(views.lines(spark, SMALL), ["movie_id", "doc_id"]).select("movie_id", "doc_id", "scene_id").collect()
    of: dict = {}
    for r in scenes:
        of.setdefault((r["movie_id"], r["doc_id"]), set()).add(r["scene_id"])
    got = Q["p15_random_scene"](spark, SMALL).collect()
    assert sorted((r["movie_id"], r["doc_id"]) for r in got) == sorted(of) and all(r["scene_id"] in of[r["movie_id"], r["doc_id"]] for r in got)
    again = parse.random_scene(parse.scenes(views.lines(spark, SMALL), ["movie_id", "doc_id"]).repartition(7), ["movie_id", "doc_id"]).collect()
    assert set(got) == set(again) and len({r["scene_id"] for r in got}) > 1


def test_g1_capitalised_names(spark):
    want = set()
    for r in table(spark, "documents"):
        seen: dict = {}
        for i, m in enumerate(re.findall(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b", r["text"])):
            seen.setdefault(m, i)
        want |= {(r["doc_id"], t, "PERSON", i) for t, i in seen.items()}
    assert {(r["doc_id"], r["text"], r["label"], r["ord"]) for r in Q["g1_capitalised_names"](spark, SMALL).collect()} == want


def cleaned_name(name: str) -> str:
    s = " ".join(name.split())
    s = re.sub(r"\s*\([^)]*\)\s*", " ", s).strip()
    s = re.sub(r"\b(?:CONT'?D|INTERCUT|O\.S\.?|PRELAP|PRE-LAP|V\.O\.?|VISUALS)\b", "", s, flags=re.I)
    s = s.strip(" .()")
    s = re.sub("[-–—]+$", "", s).strip()
    return re.sub("['’]s?$", "", s, flags=re.I).strip()


def noise(name: str) -> bool:
    times = "AFTERNOON CONTINUOUS DAWN DAY DUSK EVENING FLASH FLASHBACK LATER MORNING NIGHT THE A AN ANGLE CAMERA CLOSE CUT FADE POV PULL PUSH RACK SMASH VOICE WIDE".split()
    up = name.upper()
    return (
        len(name) <= 1
        or re.match(r"\d", name) is not None
        or re.match(r"[A-Z\s'\-]+\s+-\s+(?:AFTERNOON|CONTINUOUS|DAWN|DAY|DUSK|EVENING|LATER|MORNING|NIGHT)$", up) is not None
        or re.match(r"(?:INT|EXT|I/E|E/I)(?:[./\s]|$)", name, re.I) is not None
        or up in times
        or (name == name.lower() and name != up and " " not in name)
        or '"' in name
        or "\\" in name
        or re.match(r"(\w+)-\1-", name, re.I) is not None
        or re.search(r"\b(?:a|an|and|at|by|for|in|of|on|or|the|to|with)$", name, re.I) is not None
    )


def test_g5_clean_entities(spark):
    assert "PERSON" in ENTITY_TYPES
    want = set()
    for r in table(spark, "documents"):
        best: dict = {}
        for i, w in enumerate(r["text"].split(" ")):
            name = cleaned_name(w)
            if not name or noise(name):
                continue
            shouted = name == name.upper() and name != name.lower()
            key = name.lower()
            first, rank, shown = best.get(key, (i, (2, 0), ""))
            if (shouted, i) < rank:
                rank, shown = (shouted, i), name
            best[key] = (first, rank, shown)
        want |= {(r["doc_id"], shown, "PERSON", first) for first, _, shown in best.values()}
    assert {(r["doc_id"], r["text"], r["label"], r["ord"]) for r in Q["g5_clean_entities"](spark, SMALL).collect()} == want


def tokens(text: str) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in QUERY_STOPS]


def similar(a: set, b: set) -> bool:
    return (len(a & b) / len(a | b) if a | b else 1.0) >= 0.85 and bool(a) and bool(b)


def greedy(rows: list[tuple], by) -> dict:
    """row id -> verdict; rows (id, priority, text) in the order of priority."""
    kept: dict = {}
    out = {}
    for i, _, text in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = kept.setdefault(by[i], [])
        key, own = " ".join(tokens(text)), set(tokens(text))
        if any(k == key for k, _ in mine):
            out[i] = "exact"
        elif any(similar(own, s) or own == s for _, s in mine):
            out[i] = "near"
        else:
            out[i] = "survivor"
            mine.append((key, own))
    return out


def test_m8_greedy_deduplication(spark):
    docs = table(spark, "documents")
    want = greedy([(r["doc_id"], -r["n_chars"], r["text"]) for r in docs], {r["doc_id"]: r["source"] for r in docs})
    assert {r["doc_id"]: r["verdict"] for r in Q["m8_greedy_deduplication"](spark, SMALL).collect()} == want


def test_m8_on_chains_of_near_copies(spark):
    """Texts that differ by a few words in a row, in three scopes, with priorities against the order of the chain."""
    from vignette.operators import clean

    words = [f"word{i}" for i in range(40)]
    rows = []
    for k in range(60):
        text = " ".join(words[k // 3 : k // 3 + 20] + ([f"extra{k}"] if k % 4 == 0 else []))
        rows.append((k, (k * 7) % 10, text, f"s{k % 3}"))
    rows += [(100 + k, 5, "", "s0") for k in range(3)] + [(200 + k, 1, rows[0][2], "s0") for k in range(4)]
    df = spark.createDataFrame([(i, p, t, s) for i, p, t, s in rows], "doc_id bigint, p int, text string, source string")
    got = {r["doc_id"]: r["verdict"] for r in clean.greedy_survivors(df, ["source"], [F.col("p").alias("s")], "text", "doc_id").collect()}
    assert got == greedy([(i, p, t) for i, p, t, _ in rows], {r[0]: r[3] for r in rows})
    assert set(got.values()) == {"survivor", "near", "exact"}


def repaired(query: str) -> tuple:
    """(cleaned query, whether beyond repair) of the shapes that the view makes."""
    tidy = lambda s: " ".join(s.split()).strip()
    s = query.strip()
    if s.startswith("```"):
        s = re.sub(r"\s*```$", "", re.sub(r"^```(json)?\s*", "", s)).strip()
    if s.startswith("{"):
        try:
            return tidy(json.loads(s)["query"]), False
        except ValueError:
            part = tidy(re.sub(r"[ ,}]+$", "", re.search(r'"query"\s*:\s*"(.*)$', s, re.S)[1]))
            return (part, False) if len(part.split()) >= 5 and "{" not in part and "}" not in part else (None, True)
    return tidy(s.strip('"').strip("'")), None


def test_f8_repaired_queries(spark):
    raw = {r["row_id"]: r["query"] for r in views.raw_queries(spark, SMALL).collect()}
    got = {r["row_id"]: r for r in Q["f8_repaired_queries"](spark, SMALL).collect()}
    assert set(got) == set(raw)
    for i, q in raw.items():
        want, lost = repaired(q)
        if lost is None and got[i]["structural_reason"]:  # plain text may be cut off or too short
            assert got[i]["cleaned_query"] is None and got[i]["structural_reason"] in ("likely_truncated", "too_short", "json_wrapper_artifact")
            if got[i]["structural_reason"] == "too_short":
                assert len(want.split()) < 5
        elif not lost:
            assert got[i]["cleaned_query"] == want, q
        if q.startswith("```"):
            assert "markdown_fence" in got[i]["flags"]
        if q.startswith('{"query": "') and q.endswith('"}'):
            assert got[i]["repair_method"] == "parsed_json_wrapper"


def test_a26_counts_what_m7_tells(spark):
    rows = Q["m7_cleaned_queries"](spark, SMALL).collect()
    kind = {r["row_id"]: (r["query_type"], r["movie_id"]) for r in views.raw_queries(spark, SMALL).collect()}
    assert {r["row_id"] for r in rows} == set(kind)
    for r in Q["a26_cleaning_report"](spark, SMALL).collect():
        own = [x for x in rows if r["query_type"] in (None, kind[x["row_id"]][0])]
        for action in ("keep", "regenerate", "reject"):
            assert r[action] == sum(x["action"] == action for x in own)
        assert r["movies"] == len({kind[x["row_id"]][1] for x in own})
    least = {"scene_summary": 0.75, "synopsis": 0.85}
    for r in rows:
        if r["action"] == "keep":
            assert r["quality_score"] >= least[kind[r["row_id"]][0]] and r["reject_reason"] is None and r["cleaned_query"]
        else:
            assert r["reject_reason"]
    kept = [r for r in rows if r["action"] == "keep"]
    assert len({" ".join(tokens(r["cleaned_query"])) for r in kept}) == len(kept)
    assert not any(similar(set(tokens(a["cleaned_query"])), set(tokens(b["cleaned_query"]))) for a in kept for b in kept if a["row_id"] < b["row_id"])


def test_v18_int8_search(spark):
    from vignette.operators import nearest
    from vignette.queries.search import PROBE

    exact = {r["vec_id"] for r in nearest.search(views.table(spark, SMALL, "embeddings"), PROBE, 20).collect()}
    found = Q["v18_int8_search"](spark, SMALL).collect()
    key = "vec_id" if "vec_id" in found[0].asDict() else "id"
    assert len(found) == 20 and len(exact & {r[key] for r in found}) >= 18


@pytest.mark.parametrize("name", ["a23_interval_alpha"])
def test_a23_by_pairs(spark, name):
    """Every pair of grades of an item, and every pair of all grades, instead of the closed form."""
    from vignette.queries.evaluation import annotations

    of: dict = {}
    for r in annotations(spark, SMALL).where("grade IS NOT NULL").collect():
        of.setdefault(r["engine"], {}).setdefault((r["query_id"], r["movie_key"]), []).append(r["grade"])
    got = {r["engine"]: r["alpha"] for r in Q[name](spark, SMALL).collect()}
    assert set(got) == set(of)
    for engine, items in of.items():
        inside = [(a - b) ** 2 for g in items.values() for i, a in enumerate(g) for b in g[:i]]
        flat = [x for g in items.values() for x in g]
        every = [(a - b) ** 2 for i, a in enumerate(flat) for b in flat[:i]]
        assert got[engine] == pytest.approx(1 - (sum(inside) / len(inside)) / (sum(every) / len(every)), abs=1e-6)
