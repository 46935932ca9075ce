"""The file formats, written to the shared folder and read back; the stored graph; generation with a stand-in model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generate, graph, lookup, mine
from ..operators.graph_store import GraphStore
from ..operators.store import Store
from ..sources import files, views
from ..storage import new_folder, stored
from .registry import query

_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query(r"SELECT movie_id, CAST(row_number() OVER (PARTITION BY movie_id ORDER BY doc_id, line_no) - 1 AS INTEGER) AS line_no, tag, regexp_replace(content, '\s+$', '') AS content FROM v_lines", ("v_lines",))
def s1_tagged_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged script a source, written as files of their own."""
    line = views.lines(spark, sf_dir).select("movie_id", F.struct("doc_id", "line_no", F.concat("tag", F.lit(": "), "content").alias("line")).alias("l"))
    texts = line.groupBy("movie_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    folder = new_folder(spark, "scripts")
    files.write_texts(texts.select(F.concat("movie_id", F.lit("_parsed.txt")).alias("name"), "text"), folder).count()
    return files.tagged_scripts(spark, folder).select("movie_id", "line_no", "tag", "content")


@query("SELECT concat('f', p_partkey) AS file_name, CASE WHEN p_partkey % 3 = 0 THEN concat('/d/f', p_partkey, '_parsed.txt') WHEN p_partkey % 3 = 1 THEN concat('/d/f', p_partkey, '.txt') END AS path FROM part")
def s2_tagged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the scripts is there both parsed and raw, a third raw, a third not at all."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), "p_partkey").alias("file_name"))
    at = lambda rows, end: rows.select(F.concat(F.lit("/d/"), "file_name", F.lit(end)).alias("path"))
    listing = at(p.where("p_partkey % 3 = 0"), "_parsed.txt").unionByName(at(p.where("p_partkey % 3 < 2"), ".txt"))
    return files.tagged_paths(p.select("file_name"), listing)


@query("SELECT concat('part', p_partkey) AS key, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN concat('f', p_partkey) END AS file_name, CASE WHEN p_partkey % 3 <> 0 THEN concat('The ', p_name) END AS title, p_type AS overview FROM part")
def s3_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of all movies; movies may lack any field."""
    p = views.table(spark, sf_dir, "part")
    file = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("f"), "p_partkey")).alias("file_name"))
    tmdb = F.struct(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("The "), "p_name")).alias("title"), F.col("p_type").alias("overview"))
    one = p.select(F.concat(F.lit("part"), "p_partkey").alias("key"), F.struct(file.alias("file"), tmdb.alias("tmdb")).alias("m"))
    folder = new_folder(spark, "metadata")
    one.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "m")))).alias("value")).coalesce(1).write.text(folder)
    return files.metadata(spark, folder).select("key", "name", "file_name", "title", "overview")


def _graph_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Entity and relation files of all movies; the first days have no relation file."""
    raw = stored(views.raw_relations(spark, sf_dir), "relations")
    e = views.entities_of(raw).groupBy("movie_id").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("text"), F.col("entity_type").alias("label")))).alias("entities"))
    r = raw.where("movie_id > '2024-01-03'").groupBy("movie_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.struct(F.col("from_name").alias("from"), "from_type", F.col("to_name").alias("to"), "to_type", "label", "evidence").alias("r")))), lambda x: x["r"]).alias("relations"))
    out = []
    for rows, kind in ((e, "entities"), (r, "relations")):
        out.append(new_folder(spark, kind))
        name = F.concat("movie_id", F.lit(f"_{kind}.json"))
        source = [F.concat("movie_id", F.lit("-script.txt")).alias("file")] if kind == "entities" else []
        files.write_texts(rows.select(name.alias("name"), F.to_json(F.struct(*source, kind), {"ignoreNullFields": "false"}).alias("text")), out[-1]).count()
    return out[0], out[1]


@query("SELECT movie_id, 'entity' AS kind, name, entity_type AS type, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS VARCHAR) AS label FROM v_entities UNION ALL SELECT movie_id, 'relation', from_name, from_type, to_name, label FROM v_relations WHERE movie_id > '2024-01-03'", ("v_relations", "v_entities"))
def s4_extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = files.extracted(spark, *_graph_files(spark, sf_dir))
    none = F.lit(None).cast("string")
    a = e.select("movie_id", F.lit("entity").alias("kind"), "name", F.col("entity_type").alias("type"), none.alias("other"), none.alias("label"))
    return a.unionByName(r.select("movie_id", F.lit("relation").alias("kind"), F.col("from_name").alias("name"), F.col("from_type").alias("type"), F.col("to_name").alias("other"), "label"))


@query("SELECT DISTINCT movie_id FROM v_entities", ("v_entities",))
def s4_available_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.available_movie_ids(spark, _graph_files(spark, sf_dir)[0])


@query("SELECT movie_id, movie_title, query, query_type, CAST(row_id % 1000 AS INTEGER) AS scene_idx FROM v_raw_queries", ("v_raw_queries",))
def s5_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two writes and read back."""
    rows = views.raw_queries(spark, sf_dir).withColumn("scene_idx", (F.col("row_id") % 1000).cast("int"))
    folder = new_folder(spark, "lines")
    for part in ("row_id % 2 = 0", "row_id % 2 = 1"):
        files.append_json_lines(rows.where(part).drop("row_id"), folder)
    return files.json_lines(spark, folder)


_EVAL = "ev AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS place, row_id, query, movie_id, movie_title, row_id % 5 = 0 AS leaked FROM v_raw_queries)"


def _eval_file(spark: SparkSession, sf_dir: str, nested: bool) -> str:
    q = views.raw_queries(spark, sf_dir)
    one = F.struct("query", "movie_id", "movie_title", F.struct((F.col("row_id") % 5 == 0).alias("has_leakage")).alias("validation"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_id", one.alias("q")))), lambda x: x["q"]).alias("evaluation_queries")
    row = q.agg(listed)
    folder = new_folder(spark, "evaluation")
    row.select(F.to_json(F.struct("evaluation_queries") if nested else F.col("evaluation_queries")).alias("value")).coalesce(1).write.text(folder)
    return folder


@query(r"SELECT CAST(place AS INTEGER) AS query_id, query, movie_title, movie_id AS movie_key FROM ev WHERE NOT leaked AND regexp_replace(query, '^\s+', '')[1] <> '{'", ("v_raw_queries",), _EVAL)
def s6_eval_queries_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.eval_queries(spark, _eval_file(spark, sf_dir, False))


@query("SELECT CAST(place AS INTEGER) AS query_id, query, movie_title, movie_id AS movie_key FROM ev", ("v_raw_queries",), _EVAL)
def s6_eval_queries_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested files keep leaked queries if asked to."""
    return files.eval_queries(spark, _eval_file(spark, sf_dir, True), clean_only=False)


@query("SELECT concat('doc-', doc_id) AS name, text FROM documents WHERE text <> ''")
def s7_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file of its own; every third one that Latin-1 can hold is written in it."""
    d = views.table(spark, sf_dir, "documents").where("text <> ''")
    latin = (F.col("doc_id") % 3 == 0) & ~F.col("text").rlike("[^\\u0000-\\u00FF]") & F.col("text").rlike("[\\u00C0-\\u00FF](?![\\u0080-\\u00BF])")
    folder = new_folder(spark, "texts")
    data = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    files.write_texts(d.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), data.alias("text")), folder).count()
    return files.whole_texts(spark, folder).select(files.stem(F.col("path")).alias("name"), "text")


@query("SELECT concat('P', user_id) AS person_id, strftime(ts, '%Y-%m-%d') AS query_id, event_type AS engine, CAST(hour(ts) + 1 AS INTEGER) AS rank, concat('movie, \"', user_id % 12, '\"') AS movie_key, CAST(event_id % 5 AS DOUBLE) AS grade FROM events WHERE event_id % 5 IN (0, 1, 2)")
def s8_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded rows as CSV: quotes and commas in fields, blanks and words and numbers out of range among the grades."""
    e = views.table(spark, sf_dir, "events")
    grade = F.when(F.col("event_id") % 5 == 3, F.lit(" ")).when(F.col("event_id") % 10 == 4, F.lit("good")).otherwise((F.col("event_id") % 5).cast("string"))
    rows = e.select(F.concat(F.lit("P"), "user_id").alias("person_id"), F.date_format("ts", "yyyy-MM-dd").alias("query_id"), F.lit("q").alias("query_text"), F.col("event_type").alias("engine"), (F.hour("ts") + 1).cast("string").alias("rank"), F.concat(F.lit('movie, "'), F.col("user_id") % 12, F.lit('"')).alias("movie_key"), F.lit("t").alias("movie_title"), F.lit("o\nv").alias("movie_overview"), grade.alias("relevance_grade"))
    folder = new_folder(spark, "annotations")
    files.write_csv(rows, folder)
    return files.annotations(spark, folder)


@query("SELECT doc_id, text, source FROM documents WHERE text <> ''")
def s9_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    files.write_csv(views.table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", "source"), folder)
    return files.read_csv(spark, folder, "doc_id bigint, text string, source string")


@query("SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY source")
def s10_report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as indented JSON."""
    rows = views.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    folder = new_folder(spark, "report")
    files.write_report(rows, folder)
    return files.read_report(spark, folder, "source string, documents bigint, characters bigint")


@query("SELECT c_custkey, concat('/kg/c', c_custkey % 50, '_relations.json') AS relations_file FROM customer WHERE c_custkey % 50 < 40 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 50 >= 40")
def f18_relations_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation file of a movie by its title in letters and digits."""
    c = views.table(spark, sf_dir, "customer")
    listing = c.where("c_custkey % 50 < 40").select(F.concat(F.lit("/kg/c"), F.col("c_custkey") % 50, F.lit("_relations.json")).alias("path")).distinct()
    asked = c.select("c_custkey", F.concat(F.lit(" C-"), F.col("c_custkey") % 50).alias("title"))
    return lookup.relations_files(asked, listing).select("c_custkey", "relations_file")


@query("SELECT DISTINCT concat('c ', c_custkey % 50) AS title, concat('/kg/c-', c_custkey % 50, '_relations.json') AS path FROM customer")
def f18_discovered_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("k")).distinct()
    listing = c.select(F.concat(F.lit("/kg/c-"), "k", F.lit("_relations.json")).alias("path")).unionByName(c.select(F.concat(F.lit("/kg/c-"), "k", F.lit("_entities.json")).alias("path")))
    return lookup.discovered_movies(listing)


# --- the stored graph -----------------------------------------------------------------------------------------------

_BUILD = (
    "SELECT {0} AS mode, {1} AS requested, (SELECT count(DISTINCT movie_id) FROM v_entities{2}) AS movies, (SELECT count(*) FROM v_entities{2}) AS entities, (SELECT count(*) FROM kept{2}) AS relations, (SELECT count(DISTINCT movie_id) + count(*) FROM v_entities{2}) AS nodes, (SELECT count(*) FROM v_entities{2}) + (SELECT count(*) FROM kept{2}) AS edges, (SELECT count(*) FROM v_relations{2}) - (SELECT count(*) FROM kept{2}) AS dropped"
)
_KEPT = "kept AS (SELECT * FROM v_relations WHERE label IS NOT NULL AND NOT (from_name = to_name AND label IN ('{0}')))"


def _kept_sql() -> str:
    from ..functions.vocabulary import NOT_REFLEXIVE

    return _KEPT.format("', '".join(NOT_REFLEXIVE))


def _built(spark: SparkSession, sf_dir: str) -> tuple[GraphStore, DataFrame, DataFrame, DataFrame]:
    store = GraphStore(spark, Store(spark, new_folder(spark, "graph")))
    raw = stored(views.raw_relations(spark, sf_dir), "relations")
    return store, views.entities_of(raw), raw, store.build(views.entities_of(raw), raw)


@query(_BUILD.format("'full'", "CAST(NULL AS VARCHAR)", ""), ("v_relations", "v_entities"), _kept_sql())
def g22_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of all movies, kept in a store."""
    return _built(spark, sf_dir)[3].select("mode", "requested", "movies", "entities", "relations", "nodes", "edges", "dropped")


@query("SELECT movie_id, 'entity' AS kind, concat(movie_id, ':', lower(entity_type), ':', " + _SLUG.format("name") + ") AS id FROM v_entities WHERE movie_id <> '2024-01-02' UNION ALL SELECT movie_id, 'entity', concat(movie_id, ':person:ann-lee') FROM (SELECT DISTINCT movie_id FROM v_entities WHERE movie_id = '2024-01-02')", ("v_entities",))
def g22_reload_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a full build one movie is built again from other entities; a new store over the same folder reads the result."""
    store, entities, raw, _ = _built(spark, sf_dir)
    fresh = entities.where("movie_id = '2024-01-02'").select("movie_id", F.lit(" Ann  Lee ").alias("name"), F.lit("person").alias("entity_type")).distinct()
    store.build(fresh, raw, "2024-01-02")
    again = GraphStore(spark, Store(spark, store.store.folder))
    return again.table("entities").select("movie_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"))


@query("SELECT 'ready' AS status, " + _BUILD.format("'movie'", "'2024-01-05'", " WHERE movie_id = '2024-01-05'").removeprefix("SELECT ") + ", (SELECT count(DISTINCT movie_id) FROM v_entities) AS all_movies, (SELECT count(*) FROM v_entities) AS all_entities, (SELECT count(*) FROM kept) AS all_relations", ("v_relations", "v_entities"), _kept_sql())
def g24_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the whole graph and the last build, as a store opened anew reports them."""
    store, entities, raw, _ = _built(spark, sf_dir)
    store.build(entities, raw, "2024-01-05")
    h = GraphStore(spark, Store(spark, store.store.folder)).health()
    last, counts = h["last_build"], h["counts"]
    row = [h["status"], *[last[c] for c in ("mode", "requested", "movies", "entities", "relations", "nodes", "edges", "dropped")], counts["movies"], counts["entities"], counts["relations"]]
    return spark.createDataFrame([tuple(row)], "status string, mode string, requested string, movies bigint, entities bigint, relations bigint, nodes bigint, edges bigint, dropped bigint, all_movies bigint, all_entities bigint, all_relations bigint")


@query("SELECT movie_id, replace(CASE WHEN day % 3 = 0 THEN concat('from-the-', movie_id) WHEN day % 3 = 1 THEN concat('told.in-', movie_id) ELSE movie_id END, '-', ' ') AS title FROM (SELECT movie_id, CAST(substr(movie_id, 9) AS INTEGER) AS day FROM v_entities GROUP BY movie_id)", ("v_entities",))
def g16_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity file's source comes before the relation file's, and that before the id."""
    day = F.substring("movie_id", 9, 2).cast("int")
    m = views.raw_entities(spark, sf_dir).select("movie_id").distinct()
    m = m.withColumns({"entity_file": F.when(day % 3 == 0, F.concat(F.lit("/scripts/from-the-"), "movie_id", F.lit(".txt"))), "relation_file": F.when(day % 3 == 1, F.concat(F.lit("told.in-"), "movie_id", F.lit(".pdf"))).when(day % 3 == 0, F.lit("not-this.txt"))})
    return graph.titled(m).select("movie_id", "title")


@query("SELECT doc_id AS movie_id, w AS text FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(source), '-')) AS w FROM documents) WHERE doc_id % 2 = 1 OR contains(w, 's')")
def g6_filtered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that keeps names with an s; it fails for odd documents, whose names then stay."""
    d = views.table(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").alias("movie_id"), F.posexplode(F.array_distinct(F.split(F.lower("source"), "-"))).alias("ord", "text"), F.lit("PERSON").alias("label"))

    def choose(entities: list[dict], odd: bool = False) -> list[dict]:
        if any(x["text"].startswith("#odd") for x in entities):
            raise ValueError("no answer")
        return [x for x in entities if "s" in x["text"] and not x["text"].startswith("#")]

    marked = e.unionByName(d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("movie_id"), F.lit(99).alias("ord"), F.lit("#odd").alias("text"), F.lit("PERSON").alias("label")))
    return graph.filtered_entities(marked, choose).where("text <> '#odd'").select("movie_id", "text")


@query("SELECT doc_id AS movie_id, 'ann' AS from_name, 'LOVES' AS label, source AS to_name FROM documents WHERE doc_id % 3 = 0")
def g8_extracted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor that answers with good, unknown and broken relations in turn."""
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("movie_id"), "source", "doc_id")
    names = d.select("movie_id", F.col("source").alias("text")).unionByName(d.select("movie_id", F.lit("ann").alias("text")))
    texts = d.select("movie_id", F.concat(F.col("doc_id") % 3, F.lit("|"), "source").alias("text"))

    def extract(text: str, names: list[str]) -> str:
        kind, _, other = text.partition("|")
        if kind == "2":
            raise ValueError("no answer")
        good = {"from": "ann", "from_type": "PERSON", "to": other, "to_type": "ORG", "label": "LOVES" if kind == "0" else "EATS", "evidence": "e"}
        return "```json\n" + json.dumps({"relations": [good, good | {"from_type": "ORG"}, good | {"to": "nobody"}]}) + "\n```"

    return graph.extracted_relations(texts, names, extract).select("movie_id", "from_name", "label", "to_name")


# --- generation with a stand-in model -------------------------------------------------------------------------------


def told(kind: str, fields: dict) -> str | None:
    """A model that answers from its prompt: repeats itself, leaks titles, skips and fails now and then."""
    if kind == "synopsis":
        words = fields["overview"].split()
        start = fields["attempt"] * 2
        return json.dumps({"queries": [f"somebody finds {words[i % len(words)]} number {i}" for i in range(start, start + fields["n"])]})
    if kind == "paraphrase":
        return json.dumps({"paraphrases": [f"again {fields['query']}", f"once more {fields['query']}"][: fields["n"]]})
    text = fields["scene_text"]
    if len(text) % 3 == 0:
        raise RuntimeError("busy")
    return json.dumps({"query": f"a scene of {len(text)} characters", "skip": len(text) % 3 == 1})


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part"), "p_partkey").alias("movie_id"), F.lit("Zqx").alias("movie_title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("overview"))


_TOLD = "mv AS (SELECT concat('part', p_partkey) AS movie_id, string_split(p_name, ' ') AS w FROM part WHERE p_partkey % 5 <> 0 AND trim(p_name) <> '')"


@query("SELECT movie_id, concat('somebody finds ', w[i % len(w) + 1], ' number ', i) AS query FROM mv, range(6) r(i)", (), _TOLD)
def m16_synopsis_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four that overlap, in three rounds: six queries a movie; movies without an overview have none."""
    return generate.synopsis_queries(_movies(spark, sf_dir), told).select("movie_id", F.explode("queries").alias("query"))


_SCENES = "lng AS (SELECT source AS movie_id, CAST(row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) - 1 AS INTEGER) AS scene_idx, length(text) AS n FROM documents)"


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(F.col("source").alias("movie_id"), F.lit("Zqx").alias("movie_title"), "text", "doc_id")


@query("SELECT movie_id, scene_idx, concat('a scene of ', n, ' characters') AS query FROM lng WHERE scene_idx < 3 AND n % 3 = 2", (), _SCENES)
def m6_scene_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each of a source's three longest documents, unless the model skips it or fails."""
    return generate.scene_queries(_scenes(spark, sf_dir), told, key="doc_id").select("movie_id", "scene_idx", "query")


@query("SELECT item_id AS query_id, unnest(['again ' || text, 'once more ' || text]) AS paraphrase FROM benchmark")
def m16_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("Zqx").alias("movie_title"))
    return generate.paraphrases(b, told).select("query_id", "paraphrase")


@query("SELECT movie_id, concat('somebody finds ', w[1], ' number 0') AS query FROM mv WHERE len(w) >= 2 AND CAST(substr(movie_id, 5) AS INTEGER) % 3 <> 0", (), _TOLD)
def m10_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for every movie that was not trained on and has an overview of two words or more."""
    m = _movies(spark, sf_dir)
    trained = m.where(F.substring("movie_id", 5, 9).cast("int") % 3 == 0)
    return generate.eval_set(m, trained, told, least=2).select("movie_id", "query")


@query("SELECT movie_id, concat('somebody finds ', w[i % len(w) + 1], ' number ', i) AS query FROM mv, range(2) r(i)", (), _TOLD)
def m17_resumed_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over batches: the first breaks in its second batch, the second finishes, the third finds nothing to do."""
    store, movies, calls = Store(spark, new_folder(spark, "resume")), _movies(spark, sf_dir), []
    every = max(1, movies.count() // 3)

    def step(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the machine stops")
        return generate.synopsis_queries(rows, told, 2).select("movie_id", F.explode("queries").alias("query"))

    try:
        generate.resumed(movies, step, store, "queries", every=every)
    except RuntimeError:
        pass
    generate.resumed(movies, step, store, "queries", every=every)
    done, _, _ = generate.progress(store, "queries", movies.count())
    again = generate.resumed(movies.where("overview IS NOT NULL"), step, store, "queries", every=every)
    if again or not done:
        raise RuntimeError("a finished run found something to do")
    return store.get("queries").select("movie_id", "query")


_POS = "asked AS (SELECT vec_id AS query_id, CAST(vec_id % 4 AS INTEGER) AS scene_idx, movie_id FROM v_sentences), rnk AS (SELECT vec_id, movie_id, CAST(row_number() OVER (PARTITION BY movie_id ORDER BY length(text) DESC, scene_index) - 1 AS INTEGER) AS scene_idx FROM v_scenes)"


@query("SELECT a.query_id, r.vec_id AS positive, 3 AS negatives, 0::BIGINT AS own FROM asked a JOIN rnk r ON a.movie_id = r.movie_id AND a.scene_idx = r.scene_idx WHERE a.scene_idx < 3 AND a.movie_id <> 'movie_1'", ("v_sentences",), _POS)
def m5_scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of type B: the scene of the query's rank by length; movies that are done (J12) are left out; three different
    negatives, none of the own movie."""
    s = views.scenes(spark, sf_dir)
    asked = views.sentences(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "movie_id", F.col("embedding").alias("q"), F.lit("scene_summary").alias("query_type"), (F.col("vec_id") % 4).cast("int").alias("scene_idx"))
    done = spark.createDataFrame([("movie_1",)], "movie_id string")
    none = spark.createDataFrame([], "query_id bigint, vec_id bigint")
    pairs = mine.assemble(asked, none, s, done)
    flat = pairs.select("query_id", "movie_id", "positive", F.explode("negatives").alias("vec_id")).join(s.select("vec_id", F.col("movie_id").alias("of")), "vec_id")
    return flat.groupBy("query_id", "positive").agg(F.countDistinct("vec_id").cast("int").alias("negatives"), F.sum((F.col("of") == F.col("movie_id")).cast("bigint")).alias("own"))
