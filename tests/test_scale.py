"""What has to hold at size, seen on small inputs: how much leaves a step, and that the result stays the whole one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vignette.operators import index, nearest

V = "vec_id bigint, embedding array<float>, g string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _brute(q, c, k, skip=lambda a, b: False):
    score = lambda x, y: round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 6)
    out = {}
    for i, x, g in q:
        rows = [(-score(np.float64(np.float32(x)), np.float64(np.float32(y))), j) for j, y, h in c if not skip((i, g), (j, h))]
        out[i] = [(j, -s) for s, j in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("kind", ["plain", "exclude_same", "other", "same"])
def test_blocks_met_in_turn_give_the_exact_nearest(spark, kind):
    """Many blocks, many partitions and ties: copies of vectors differ by their id alone."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i % 60]], f"g{i % 7}") for i in range(240)]
    c = spark.createDataFrame(rows, V).repartition(3)
    q = c.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS q", "g")
    option = {"plain": {}, "exclude_same": {"exclude_same": True}, "other": {"other": "g"}, "same": {"same": "g"}}[kind]
    got = {}
    for r in nearest.block_top_k(q, c, 9, block=16, **option).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["corpus_id"], r["score"]))
    skip = {"plain": lambda a, b: False, "exclude_same": lambda a, b: a[0] == b[0], "other": lambda a, b: a[1] == b[1], "same": lambda a, b: a[1] != b[1]}[kind]
    want = _brute([r for r in rows if r[0] % 3 == 0], rows, 9, skip)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}


def test_a_product_passes_on_the_k_best_and_not_those_of_every_block(spark):
    """40 corpus blocks in one partition; before, each of them sent k rows a query."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(rng.normal(size=(640, 4)))]
    c = spark.createDataFrame(rows, V).coalesce(1)
    q = c.where("vec_id < 20").selectExpr("vec_id AS query_id", "embedding AS q")
    top = nearest.block_top_k(q, c, 5, block=16)
    top.collect()
    seen, nodes = [], [top._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName() == "MapInArrow":
            seen.append(node.metrics().apply("pythonNumRowsReceived").value())
            continue
        nodes += [node.children().apply(i) for i in range(node.children().size())] + ([node.plan()] if hasattr(node, "plan") and "QueryStage" in node.nodeName() else [])
    assert seen == [20 * 5]


def test_vectors_with_parts_that_are_no_numbers_hide_no_neighbour(spark):
    rows = [(i, [1.0, float(i)], "a") for i in range(8)] + [(100 + i, [float("nan"), 1.0], "a") for i in range(8)]
    c = spark.createDataFrame(rows, V)
    got = nearest.block_top_k(c.where("vec_id = 2").selectExpr("vec_id AS query_id", "embedding AS q"), c, 3).collect()
    assert {r["corpus_id"] for r in got} == {2, 3, 4}


def test_inverted_lists_meet_in_blocks(spark):
    """before, every query was joined with every row of its lists, one at a time."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(rng.normal(size=(300, 6)))]
    c = spark.createDataFrame(rows, V)
    q = c.selectExpr("vec_id AS query_id", "embedding AS q")
    built = index.ivf(c, 4)
    found = index.ivf_search(built, q, 5, 4)
    assert "MapInArrow" in _plan(found) and "aggregate(" not in _plan(found).lower().replace("hashaggregate(", "").replace("sortaggregate(", "")
    want = _brute(rows, rows, 5)
    assert {(r["query_id"], r["rank"], r["id"]) for r in found.collect()} == {(i, n + 1, j) for i, x in want.items() for n, (j, _) in enumerate(x)}
    one = index._nearest_lists(q, built[1]).groupBy("query_id").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert len(one) == 300 and all(r["n"] == [1, 2, 3, 4] for r in one)


def test_a_filter_meets_its_movies_in_batches(spark):
    """before, every movie was a pandas frame of its own."""
    from vignette.operators import graph

    rows = [(m, f"n{i}" if i else None, "PERSON" if i != 2 else None, None if i == 3 else i) for m in (*range(40), None) for i in (2, 0, 1, 3)]
    e = spark.createDataFrame(rows, "movie_id int, text string, label string, ord int")

    def choose(entities):
        if len(entities) != 4 or [x["text"] for x in entities] != [None, "n1", "n2", "n3"]:
            raise ValueError("not in order")
        return [{"text": "new", "label": entities[1]["label"]}, entities[3]]

    made = graph.filtered_entities(e, choose)
    assert "FlatMapGroups" not in _plan(made)
    assert {tuple(r) for r in made.where("movie_id < 2").collect()} == {(m, t, "PERSON", i) for m in (0, 1) for t, i in (("new", 0), ("n3", 1))}
    assert made.count() == 82
    for bad in (lambda x: [{"text": 5, "label": "a"}], lambda x: None, lambda x: [{"name": "a"}]):
        assert {tuple(map(str, r)) for r in graph.filtered_entities(e, bad).collect()} == {tuple(map(str, r)) for r in rows}
    assert graph.filtered_entities(e, lambda x: []).count() == 0


def test_words_that_need_no_cleaning_are_noise_when_cleaned(spark):
    """what clean_entities() leaves out before it cleans, it would leave out afterwards."""
    from vignette.operators import graph

    words = [w + m for w in ("word", "visuals", "intercut", "prelap", "a", "x", "über", "straße", "naïve", "ĸa", "viſuals", "of", "éa") for m in ("", ".", ",", ";", ":", "!", "?")]
    able = spark.createDataFrame([(w,) for w in words], "text string").where(F.col("text").rlike(graph.SMALL_WORD)).select(F.explode(F.array(graph.clean_name(F.col("text")))).alias("text"))
    assert able.count() == len(words)
    assert able.where((F.col("text") != "") & ~graph.is_noise(F.col("text"))).count() == 0
    rest = ["intercut!!", "two words", "Word", "o.s.", "l'a", "a-b", "don't"]
    assert spark.createDataFrame([(w,) for w in rest], "text string").where(F.col("text").rlike(graph.SMALL_WORD)).count() == 0


def test_aliases_of_one_file_are_made_in_many_tasks(spark):
    """Before, the movies of one file and all their aliases were sorted in one task."""
    from vignette.operators import lookup

    movies = spark.range(500).selectExpr("concat('k', id) AS key", "concat('name ', id) AS name", "concat('The ', id) AS title", "'f' AS file_name").coalesce(1)
    parts = [r["n"] for r in lookup.aliases(movies).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < sum(parts)


def test_the_words_of_a_source_do_not_meet_in_one_window(spark):
    """before, the window over a source carried the words of all its documents."""
    from vignette.queries import evaluation

    nodes, seen = [evaluation.f3_jaccard(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Window":
            seen.append({node.output().apply(i).name() for i in range(node.output().size())})
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert seen and all("a" not in names for names in seen)


def test_queries_of_one_file_are_asked_for_in_many_tasks_and_merged_once(spark):
    """before, the movies of one file were one task, and every reply was parsed once for each use."""
    from vignette.operators import generate
    from vignette.queries.formats import told

    movies = spark.range(300).selectExpr("concat('m', id) AS movie_id", "'Zqx' AS movie_title", "concat('a b c', id) AS overview").coalesce(1)
    made = generate.synopsis_queries(movies, told, 6)
    assert made.where("size(queries) = 6").count() == 300
    assert len(made.inputFiles()) >= 4
    rows = spark.createDataFrame([(["old words here"], '["Old words: here", "the and", "new Zqx words", "fresh words", "fresh, words", "last one here"]')], "queries array<string>, reply string")
    one = generate._merged(rows, "queries", F.from_json("reply", "array<string>"), F.lit("Zqx"), 3)
    assert one.first()["queries"] == ["old words here", "fresh words", "last one here"]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    """before, a task read as many files as fit its bytes with four megabytes each for opening them."""
    from vignette.sources import files

    for i in range(700):
        (tmp_path / f"t{i}.txt").write_bytes(f"text {i} \u00e9".encode("latin-1" if i % 2 else "utf-8"))
    made = files.whole_texts(spark, str(tmp_path))
    splits = spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
    assert splits > 16 >= made.rdd.getNumPartitions()
    assert {r["text"] for r in made.collect()} == {f"text {i} \u00e9" for i in range(700)}


def test_a_build_makes_its_tables_once(spark, tmp_path, monkeypatch):
    """before, entities and kept relations were made anew for every table and count."""
    from vignette.operators import graph, graph_store, store

    seen = []
    monkeypatch.setattr(graph, "summary", lambda e, r, d, was=graph.summary: seen.append((e, r)) or was(e, r, d))
    e = spark.createDataFrame([("m", "Ann", "PERSON"), ("m", "Bo", "PERSON")], "movie_id string, name string, entity_type string")
    r = spark.createDataFrame([("m", "Ann", "PERSON", "Bo", "PERSON", "LOVES", "e")] * 3, "movie_id string, from_name string, from_type string, to_name string, to_type string, label string, evidence string")
    row = graph_store.GraphStore(spark, store.Store(spark, str(tmp_path))).build(e.distinct(), r).first()
    assert (row["entities"], row["relations"], row["dropped"]) == (2, 1, 0)
    assert all("Exchange" not in _plan(x) for x in seen[0])


def _shuffled(spark) -> int:
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once_for_near_duplicates(spark):
    """before, keys as long as the texts went through four shuffles and every token through two."""
    import random

    from vignette.operators import clean

    rng = random.Random(9)
    rows = [(i, f"s{i % 4}", " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(1500)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, scope string, cleaned_query string, score int")
    before = _shuffled(spark)
    assert clean.greedy_survivors(df, ["scope"], [F.col("score").alias("s")]).where("verdict = 'survivor'").count() == 200
    assert _shuffled(spark) - before < 3 * sum(len(r[2]) for r in rows)


@pytest.mark.parametrize("slots", [1, 3, 1 << 10])
def test_counters_that_tokens_share_lose_no_near_pair(spark, monkeypatch, slots):
    from vignette.operators import clean

    monkeypatch.setattr(clean, "SLOTS", slots)
    rng = np.random.default_rng(11)
    base = [{f"w{t}" for t in rng.choice(90, size=rng.integers(1, 45), replace=False)} for _ in range(12)]
    sets = [(b | {f"w{t}" for t in rng.choice(90, size=k)}) - {f"w{t}" for t in rng.choice(90, size=k)} for b in base for k in (0, 0, 1, 2, 3, 4, 6)]
    df = spark.createDataFrame([(i, f"g{i % 2}", " ".join(sorted(x)), i) for i, x in enumerate(sets)], "row_id int, scope string, cleaned_query string, score int")
    kept, want = [], {}
    for i, x in enumerate(sets):
        near = [y for s, y in kept if s == i % 2 and (x == y or (x and len(x & y) / len(x | y) >= 0.85))]
        want[i] = "exact" if x in near else "near" if near else "survivor"
        if not near:
            kept.append((i % 2, x))
    assert {r["row_id"]: r["verdict"] for r in clean.greedy_survivors(df, ["scope"], [F.col("score").alias("s")]).collect()} == want
    assert set(want.values()) == {"survivor", "near", "exact"}


def test_bm25_meets_queries_and_documents_in_blocks(spark, monkeypatch):
    """before, every posting of a query's terms was shuffled, and every part of a score."""
    import math
    from collections import Counter

    from vignette.operators import lexical

    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(lexical, "CELLS", 40)
    rng = np.random.default_rng(13)
    text = lambda n: " ".join(f"w{min(int(x), 39)}" for x in rng.exponential(8, size=n))
    docs = [(f"d{i}", f"m{i % 5}", text(rng.integers(1, 30))) for i in range(60)] + [("none", "m9", "the of a"), ("null", "m9", None)]
    asked = [(i, text(6) + (" w3 w3 elsewhere" if i % 2 else "")) for i in range(18)] + [(98, "elsewhere"), (99, None)]
    d, q = spark.createDataFrame(docs, "doc_id string, movie_key string, text string"), spark.createDataFrame(asked, "query_id int, text string")
    index = lexical.build(d)
    found = lexical.scores(index, q)
    assert "MapInArrow" in _plan(found) and "hashpartitioning" not in _plan(found)
    words = {i: [] if t is None or i == "none" else t.split() for i, _, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for x in words.values() for w in set(x))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    want = {}
    for i, t in asked:
        for j, x in words.items():
            tf = Counter(x)
            parts = [idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in (t or "").split() if w in tf]
            if parts:
                want[i, j] = sum(parts)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {(r["query_id"], r["movie_key"]): r["score"] for r in lexical.movies(index, q).collect()}
    assert len(best) == 20 * 6 and all(abs(s - max((want.get((i, j), 0) for j, m, _ in docs if m == k), default=0)) < 1e-6 for (i, k), s in best.items())
    assert {tuple(r) for r in index.postings.where("doc_id = 'd0'").select("term", "tf").collect()} == {(w, float(c)) for w, c in Counter(words["d0"]).items()}
    assert lexical.scores(lexical.build(d.limit(0)), q).count() == lexical.scores(index, q.limit(0)).count() == 0


def test_group_scores_that_a_worker_holds_are_bounded(monkeypatch):
    """A query block keeps a score a group, and no more than HELD of all blocks."""
    import pyarrow as pa

    monkeypatch.setattr(nearest, "HELD", 300)
    rng = np.random.default_rng(17)
    q, c, seen, got = rng.normal(size=(6, 10, 4)), rng.normal(size=(30, 12, 4)), [], {}

    def batches():
        for j in range(30):
            for i in range(6):
                parts = (np.arange(10) + 10 * i, q[i], np.zeros(10, np.int64), np.arange(12), c[j], np.arange(12) // 3 + j)
                yield pa.RecordBatch.from_arrays([pa.array([i]), *[pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(parts, (np.int64, np.float64, np.int64) * 2)]], list("abcdefg"))

    def results(state):
        seen.append(state.held())
        for g, best in state.best.items():
            yield from zip(state.ids.tolist(), [g] * len(best), best.tolist())

    for i, g, s in nearest._met(batches(), nearest._GroupBest, results):
        got[i, g] = max(s, got.get((i, g), -2))
    assert len(seen) > 6 and max(seen) < 300 + 10 * 4
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(6):
        for j in range(30):
            near = unit(q[i]) @ unit(c[j]).T
            for a in range(10):
                for b in range(12):
                    want[10 * i + a, b // 3 + j] = max(near[a, b], want.get((10 * i + a, b // 3 + j), -2))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_query_blocks_with_few_groups_that_a_worker_holds_are_bounded(monkeypatch):
    """Before, scores alone counted, so that blocks of few groups stayed with all their vectors."""
    import pyarrow as pa

    monkeypatch.setattr(nearest, "HELD", 300)
    rng = np.random.default_rng(19)
    q, c, alive, most, got = rng.normal(size=(40, 10, 4)), rng.normal(size=(2, 12, 4)), set(), [], {}

    def batches():
        for i in range(40):
            for j in range(2):
                parts = (np.arange(10) + 10 * i, q[i], np.zeros(10, np.int64), np.arange(12), c[j], np.full(12, 5))
                yield pa.RecordBatch.from_arrays([pa.array([i]), *[pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(parts, (np.int64, np.float64, np.int64) * 2)]], list("abcdefg"))

    def begin(ids, x, groups):
        alive.add(int(ids[0]))
        most.append(40 * len(alive))
        return nearest._GroupBest(ids, x, groups)

    def results(state):
        alive.discard(int(state.ids[0]))
        yield from zip(state.ids.tolist(), state.best[5].tolist())

    for i, s in nearest._met(batches(), begin, results):
        got[i] = max(s, got.get(i, -2))
    assert max(most) <= 300 + 40 and len(most) == 40
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    want = (unit(q.reshape(400, 4)) @ unit(c.reshape(24, 4)).T).max(axis=1)
    assert got.keys() == set(range(400)) and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_group_scores_of_all_query_blocks_together_are_bounded(monkeypatch):
    """before, each query block could hold HELD scores when the blocks took turns, as many times HELD as there were blocks."""
    import pyarrow as pa

    monkeypatch.setattr(nearest, "HELD", 300)
    rng = np.random.default_rng(23)
    q, c, alive, most, got = rng.normal(size=(6, 10, 4)), rng.normal(size=(20, 12, 4)), {}, [], {}

    def batches():
        for j in range(20):
            for i in range(6):
                parts = (np.arange(10) + 10 * i, q[i], np.zeros(10, np.int64), np.arange(12), c[j], np.arange(12) // 6 + 2 * j)
                yield pa.RecordBatch.from_arrays([pa.array([i]), *[pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(parts, (np.int64, np.float64, np.int64) * 2)]], list("abcdefg"))
                most.append(sum(x.held() for x in alive.values()))

    def begin(ids, x, groups):
        alive[int(ids[0])] = state = nearest._GroupBest(ids, x, groups)
        return state

    def results(state):
        del alive[int(state.ids[0])]
        for g, best in state.best.items():
            yield from zip(state.ids.tolist(), [g] * len(best), best.tolist())

    for i, g, s in nearest._met(batches(), begin, results):
        assert (i, g) not in got
        got[i, g] = s
    assert 200 < max(most) < 300 + 20
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    want = (unit(q.reshape(60, 4)) @ unit(c.reshape(240, 4)).T).reshape(60, 40, 6).max(axis=2)
    assert len(got) == 60 * 40 and all(abs(s - want[i, g]) < 1e-12 for (i, g), s in got.items())


def test_few_queries_are_spread_over_all_tasks(spark):
    """before, few queries were broadcast and one task met them, in turns, with the whole corpus."""
    rng = np.random.default_rng(29)
    c = spark.createDataFrame([(i, [float(x) for x in v], f"g{i % 5}") for i, v in enumerate(rng.normal(size=(200, 4)))], V)
    q = c.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding AS q")
    pack = lambda rows, i, v, prefix, group: nearest._blocks(rows, i, v, 2, prefix, group, False, True)
    met = nearest._pairs(pack(q, "query_id", "q", "q", None), pack(c, "vec_id", "embedding", "c", "g"), None)
    assert "BroadcastNestedLoop" not in _plan(met) and met.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert nearest.block_group_best(q, c, "g", block=2).count() == 3 * 5


@pytest.mark.parametrize("name", ["a6_scene_pool", "a17_accuracy_report_finetuning"])
def test_a_task_of_group_scores_has_one_python_worker(spark, name):
    """Before, packing either side and the product were one stage, three workers a task."""
    import __spark_entry__

    def depth(node) -> int:
        inner = [depth(node.children().apply(i)) for i in range(node.children().size())]
        return max([0, *inner]) + (node.nodeName() == "MapInArrow")

    made = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert depth(made._jdf.queryExecution().sparkPlan()) == 1
