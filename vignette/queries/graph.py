"""The knowledge graph on the events of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.vocabulary import NOT_REFLEXIVE, PREDICATES
from ..operators import fuse, graph, nearest, search
from ..plans.pattern import Pattern, compile_pattern
from ..sources import views
from ..storage import stored
from .registry import cosine_sql, query


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = stored(views.raw_relations(spark, sf_dir), "relations")
    return graph.documents(views.entities_of(raw), raw)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.normalize_entities(views.raw_entities(spark, sf_dir))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, as every step of a path reads them."""
    return stored(_graph(spark, sf_dir)[1], "graph")


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"
_LIST = "(" + ", ".join(f"'{p}'" for p in PREDICATES) + ")"
_SELF = "(" + ", ".join(f"'{p}'" for p in NOT_REFLEXIVE) + ")"
_NORMAL = f"""
ents AS (SELECT movie_id, concat(movie_id, ':', lower(entity_type), ':', {_SLUG.format('name')}) AS entity_id, name AS canonical_name, entity_type FROM v_entities),
judged AS (SELECT r.*, f.entity_id AS from_id, t.entity_id AS to_id, CASE WHEN label IS NULL OR label NOT IN {_LIST} THEN 'invalid_predicate' WHEN f.entity_id IS NULL THEN 'missing_from_entity' WHEN t.entity_id IS NULL THEN 'missing_to_entity' WHEN from_name = to_name AND label IN {_SELF} THEN 'self_relation' END AS reason FROM v_relations r LEFT JOIN ents f ON r.movie_id = f.movie_id AND r.from_name = f.canonical_name LEFT JOIN ents t ON r.movie_id = t.movie_id AND r.to_name = t.canonical_name),
rels AS (SELECT movie_id, concat(movie_id, ':rel:', substr(sha1(concat_ws('||', movie_id, from_id, label, to_id, evidence)), 1, 16)) AS relation_id, from_id, from_name, from_type, to_id, to_name, to_type, label AS predicate, evidence FROM judged WHERE reason IS NULL)""".strip()


@query("SELECT movie_id, entity_id, canonical_name, entity_type FROM ents", ("v_relations", "v_entities"), _NORMAL)
def g12_normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("movie_id", "entity_id", "canonical_name", "entity_type")


@query("SELECT * FROM rels", ("v_relations", "v_entities"), _NORMAL)
def g15_normalize_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query("SELECT movie_id, event_id, reason FROM judged WHERE reason IS NOT NULL", ("v_relations", "v_entities"), _NORMAL)
def g14_dropped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[2].select("movie_id", "event_id", "reason")


@query("SELECT movie_id, canonical_name, arg_max(entity_id, entity_type) AS entity_id, max(entity_type) AS entity_type FROM ents GROUP BY movie_id, canonical_name", ("v_relations", "v_entities"), _NORMAL)
def g13_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.name_index(_entities(spark, sf_dir)).select("movie_id", "canonical_name", "entity_id", "entity_type")


@query("SELECT movie_id, replace(movie_id, '-', ' ') AS title, count(*) AS entities FROM ents GROUP BY movie_id", ("v_relations", "v_entities"), _NORMAL)
def g16_movie_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = _entities(spark, sf_dir).groupBy("movie_id").agg(F.count("*").alias("entities"))
    return graph.titled(movies).select("movie_id", "title", "entities")


@query("SELECT (SELECT count(DISTINCT movie_id) FROM ents) AS movies, (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM rels) AS relations, (SELECT count(*) FROM ents) + (SELECT count(*) FROM rels) AS edges", ("v_relations", "v_entities"), _NORMAL)
def g19_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, kept, _ = _graph(spark, sf_dir)
    return graph.counts(entities, kept)


@query("SELECT (SELECT count(*) + count(DISTINCT movie_id) FROM ents) AS nodes, (SELECT count(*) FROM ents) + (SELECT count(*) FROM rels) AS edges, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS dropped, (SELECT string_agg(concat(reason, '=', n), ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason)) AS reasons", ("v_relations", "v_entities"), _NORMAL)
def g23_build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.summary(*_graph(spark, sf_dir))
    told = F.transform(F.map_entries("dropped_by_reason"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("nodes", "edges", "dropped", F.array_join(told, ",").alias("reasons"))


_DETAILS = "SELECT '{0}' AS side, from_name, predicate, to_name, relation_id FROM (SELECT * FROM rels WHERE movie_id = (SELECT min(movie_id) FROM ents) ORDER BY {1} LIMIT 25)"


@query(_DETAILS.format("out", "from_name, predicate, to_name, relation_id") + " UNION ALL " + _DETAILS.format("in", "to_name, predicate, from_name, relation_id"), ("v_relations", "v_entities"), _NORMAL)
def g20_movie_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, kept, _ = _graph(spark, sf_dir)
    movie = entities.agg(F.min("movie_id")).first()[0]
    _, outgoing, incoming = graph.movie_details(entities, kept, movie)
    columns = ["from_name", "predicate", "to_name", "relation_id"]
    return outgoing.select(F.lit("out").alias("side"), *columns).unionByName(incoming.select(F.lit("in").alias("side"), *columns))


_TWO = "SELECT a.movie_id, round(2.0::DOUBLE + len(list_distinct([a.from_id, a.to_id, b.to_id])) / 100.0::DOUBLE, 6) AS score, concat_ws(' ', a.from_id, a.to_id, b.to_id) AS nodes, concat_ws(' ', a.relation_id, b.relation_id) AS rels FROM rels a JOIN rels b ON a.movie_id = b.movie_id AND a.to_id = b.from_id WHERE a.predicate = '{0}' AND b.predicate = '{1}'"


def _flat(matches: DataFrame) -> DataFrame:
    return matches.select("movie_id", "score", F.array_join("nodes", " ").alias("nodes"), F.array_join("rels", " ").alias("rels"))


@query("SELECT movie_id, round(1.0::DOUBLE + len(list_distinct([from_id, to_id])) / 100.0::DOUBLE, 6) AS score, concat_ws(' ', from_id, to_id) AS nodes, relation_id AS rels FROM rels WHERE predicate = 'OWES'", ("v_relations", "v_entities"), _NORMAL)
def g21_pattern_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(compile_pattern(Pattern(["owes"]), _relations(spark, sf_dir), top=False))


@query(_TWO.format("TEACHES", "BETRAYS"), ("v_relations", "v_entities"), _NORMAL)
def g21_pattern_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(compile_pattern(Pattern(["TEACHES", "BETRAYS"]), _relations(spark, sf_dir), top=False))


@query("SELECT a.movie_id, round(3.0::DOUBLE + len(list_distinct([a.from_id, a.to_id, b.to_id, c.to_id])) / 100.0::DOUBLE, 6) AS score, concat_ws(' ', a.from_id, a.to_id, b.to_id, c.to_id) AS nodes, concat_ws(' ', a.relation_id, b.relation_id, c.relation_id) AS rels FROM rels a JOIN rels b ON a.movie_id = b.movie_id AND a.to_id = b.from_id JOIN rels c ON b.movie_id = c.movie_id AND b.to_id = c.from_id WHERE a.predicate = 'OWES' AND b.predicate = 'BETRAYS' AND c.predicate = 'TEACHES'", ("v_relations", "v_entities"), _NORMAL)
def g21_pattern_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(compile_pattern(Pattern(["OWES", "BETRAYS", "TEACHES"]), _relations(spark, sf_dir), top=False))


@query(f"SELECT * FROM ({_TWO.format('LOVES', 'OWES')} AND a.from_type IN ('PERSON', 'ORG', 'GPE') AND a.to_type IN ('PERSON', 'ORG', 'GPE') AND b.to_type IN ('PERSON', 'ORG', 'GPE')) ORDER BY score DESC, movie_id, nodes, rels LIMIT 50", ("v_relations", "v_entities"), _NORMAL)
def g21_pattern_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(compile_pattern(Pattern(["LOVES", "OWES"], entity_types=["person", "org", "gpe"], limit=50), _relations(spark, sf_dir)))


@query("SELECT movie_id, entity_id, CASE WHEN movie_id < '2024-01-11' THEN upper(canonical_name) ELSE canonical_name END AS canonical_name, entity_type FROM ents", ("v_relations", "v_entities"), _NORMAL)
def g17_replace_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movies of the first days are replaced by themselves in capitals; the others stay."""
    entities = _entities(spark, sf_dir)
    fresh = entities.where("movie_id < '2024-01-11'").withColumn("canonical_name", F.upper("canonical_name"))
    return graph.replace_movies(entities, fresh).select("movie_id", "entity_id", "canonical_name", "entity_type")


@query("SELECT movie_id, from_name, label, to_name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY movie_id, from_name, label, to_name ORDER BY event_id) AS n FROM v_relations) WHERE n = 1", ("v_relations",))
def g9_first_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graph.first_relations(views.raw_relations(spark, sf_dir), ["movie_id"], "event_id")
    return r.select("movie_id", "from_name", "label", "to_name", "event_id")


@query("SELECT movie_id, event_id FROM v_relations WHERE from_type = 'PERSON' AND label IS NOT NULL", ("v_relations",))
def g8_valid_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.raw_entities(spark, sf_dir).select("movie_id", F.col("name").alias("text"))
    return graph.valid_relations(views.raw_relations(spark, sf_dir), names, ["movie_id"]).select("movie_id", "event_id")


@query("SELECT source AS movie_id, 'missing' AS state FROM documents WHERE lang <> 'fr' GROUP BY source HAVING source NOT IN (SELECT source FROM documents WHERE lang = 'fr') UNION ALL SELECT lang, 'extra' FROM documents GROUP BY lang")
def g2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    have = d.where("lang = 'fr'").select(F.col("source").alias("movie_id")).union(d.select("lang"))
    return graph.coverage(d.select(F.col("source").alias("movie_id")), have)


_WORD = "(SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord FROM documents)"


@query(r"SELECT slug, count(*) AS n FROM (SELECT " + _SLUG.format("trim(w, ' ' || chr(10))") + f" AS slug FROM {_WORD}) GROUP BY slug")
def g10_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(text.slug(F.col("w")).alias("slug")).agg(F.count("*").alias("n"))


@query(r"SELECT noise, count(*) AS n FROM (SELECT trim(regexp_replace(w, '\s+', ' ', 'g')) = '' OR NOT regexp_matches(w, '[\p{L}\p{N}\p{M}]') AS noise FROM " + _WORD + ") GROUP BY noise")
def g11_noise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(text.is_noise_name(F.col("w")).alias("noise")).agg(F.count("*").alias("n"))


@query()
def g5_clean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a document as a name (rows-only: back-references and Unicode classes are not ANSI SQL)."""
    words = views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ord", "text")).withColumn("label", F.lit("PERSON"))
    return graph.clean_entities(words, ["doc_id"])


# --- fusion ----------------------------------------------------------------------------------------------------------

_SEM = f"""
sem AS (SELECT query_id, movie_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM (SELECT q.query_id, s.movie_id, max({cosine_sql('q.q', 's.embedding')}) AS score FROM v_query_vecs q CROSS JOIN v_scenes s GROUP BY ALL)) WHERE rank <= 6),
gra AS (SELECT query_id, concat('movie_', (query_id + i) % 12) AS movie_id, round((1 + (query_id * 7 + i * 3) % 5) / 2.0::DOUBLE, 6) AS score, i AS ord FROM v_query_vecs, range(8) r(i)),
a AS (SELECT query_id, movie_id, score AS semantic_score, score / max(score) OVER (PARTITION BY query_id) AS s0 FROM sem),
b AS (SELECT query_id, movie_id, ord, score AS raw, score / max(score) OVER (PARTITION BY query_id) AS g FROM gra),
c AS (SELECT query_id, movie_id, list(g ORDER BY ord) AS l, arg_max(raw, ord) AS graph_score, count(*) AS m FROM b GROUP BY ALL),
fused AS (SELECT query_id, movie_id, round(CASE WHEN l IS NULL THEN s0 WHEN s0 IS NULL THEN l[-1] ELSE list_reduce(list_prepend(s0, l), lambda x, y: (x + y) / 2) END, 6) AS score, semantic_score, graph_score, CAST(coalesce(m, 0) AS INTEGER) AS matches FROM a FULL OUTER JOIN c USING (query_id, movie_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(graph_score, 0.0::DOUBLE) DESC, coalesce(semantic_score, 0.0::DOUBLE) DESC, movie_id) AS rank FROM fused)""".strip()


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = views.query_vectors(spark, sf_dir)
    semantic = search.scene_pool(q, views.scenes(spark, sf_dir), 6).select("query_id", "movie_id", "score")
    i = F.col("ord")
    match = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ord")).select("query_id", F.concat(F.lit("movie_"), (F.col("query_id") + i) % 12).alias("movie_id"), F.round((1 + (F.col("query_id") * 7 + i * 3) % 5) / 2.0, 6).alias("score"), "ord")
    return q, semantic, match


@query("SELECT query_id, movie_id, score, semantic_score, graph_score, matches, rank FROM ranked WHERE rank <= 10", ("v_query_vecs", "v_scenes"), _SEM)
def a7_merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, semantic, match = _sides(spark, sf_dir)
    return fuse.merge_hits(semantic, match, 10)


@query("SELECT q.query_id, CASE WHEN q.query_id % 4 = 0 THEN 'semantic_only' ELSE 'hybrid' END AS strategy FROM v_query_vecs q", ("v_query_vecs",))
def a8_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, semantic, match = _sides(spark, sf_dir)
    return fuse.strategy(q, semantic, match.where("query_id % 4 <> 0"), semantic)


@query("SELECT query_id, movie_id, round(coalesce(semantic_score, 0.0::DOUBLE) + CASE WHEN matches > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM fused", ("v_query_vecs", "v_scenes"), _SEM)
def a10_linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, semantic, match = _sides(spark, sf_dir)
    return fuse.linear(semantic, match)


_RUNS = "runs AS (SELECT query_id, run, row_number() OVER (PARTITION BY query_id, run ORDER BY score DESC, movie_id) AS rank, movie_id AS movie_key, concat('name ', run) AS movie_name FROM (SELECT query_id, 0 AS run, movie_id, score FROM sem UNION ALL SELECT query_id, 1 AS run, movie_id, max(score) AS score FROM gra GROUP BY ALL))"


@query("SELECT query_id, movie_key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(movie_name, run * 1000 + rank) AS movie_name FROM runs GROUP BY query_id, movie_key", ("v_query_vecs", "v_scenes"), _SEM + ",\n" + _RUNS)
def a11_reciprocal_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    _, semantic, match = _sides(spark, sf_dir)
    best = match.groupBy("query_id", "movie_id").agg(F.max("score").alias("score"))
    rows = semantic.withColumn("run", F.lit(0)).unionByName(best.withColumn("run", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("query_id", "run").orderBy(F.desc("score"), "movie_id"))
    runs = rows.select("query_id", "run", rank.alias("rank"), F.col("movie_id").alias("movie_key"), F.concat(F.lit("name "), "run").alias("movie_name"))
    return fuse.reciprocal_rank(runs).select("query_id", "movie_key", "score", "movie_name")
