"""The engine's tables seen in the star-schema test tables. Every row of a source table takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is a scene, the four after it are its sentences."""
    e = table(spark, sf_dir, "embeddings")
    at = F.floor(F.col("vec_id") / 5)
    return e.where(F.col("vec_id") % 5 == 0).select("vec_id", F.concat(F.lit("movie_"), "label").alias("movie_id"), F.concat(F.lit("Movie "), "label").alias("movie_title"), ids.scene_id(at).alias("scene_id"), at.alias("scene_index"), F.concat(F.lit("scene text "), "vec_id").alias("text"), "embedding")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 5 != 0)
    parent = scenes(spark, sf_dir).select("movie_id", "movie_title", "scene_id", "scene_index")
    kind = F.when(F.col("vec_id") % 5 == 1, "description").when(F.col("vec_id") % 5 == 4, "transition").otherwise("dialogue")
    return e.withColumn("scene_index", F.floor(F.col("vec_id") / 5)).join(parent, "scene_index").select("vec_id", "movie_id", "movie_title", "scene_id", "scene_index", F.concat(F.lit("line "), "vec_id").alias("text"), kind.alias("line_type"), F.col("vec_id").alias("position_in_script"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence is a query whose target is its movie."""
    return sentences(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("movie_id").alias("target_movie"))


FILMS = 37


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes dealt out to FILMS movies, more than the deepest k of any report."""
    return scenes(spark, sf_dir).select("vec_id", F.concat(F.lit("film_"), F.col("scene_index") % FILMS).alias("movie_id"), "scene_id", "scene_index", "embedding")


def film_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence is a query for the film of its scene."""
    return sentences(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.concat(F.lit("film_"), F.col("scene_index") % FILMS).alias("movie_key"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a script: its lines that are not blank, tagged in turn S N C E D T."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("movie_id"), F.posexplode(F.split("text", "\n")).alias("pos", "content")).where(F.trim("content") != "")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("line_no")
    n = d.select("doc_id", "movie_id", "content", number)
    return n.withColumn("tag", F.element_at(F.array(*map(F.lit, "SNCEDT")), (F.col("line_no") % 6 + 1).cast("int")))


PREDICATE_OF = {"click": "TEACHES", "error": "BETRAYS", "purchase": "OWES", "signup": "ALLIES_WITH", "view": "LOVES"}
TYPES = ["PERSON", "EVENT", "ORG", "NORP", "GPE", "LOC", "FAC", "WORK_OF_ART"]


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day are a movie's relations: from a user to the day's next one."""
    e = table(spark, sf_dir, "events").withColumn("movie_id", F.date_format("ts", "yyyy-MM-dd"))
    day = Window.partitionBy("movie_id").orderBy("ts", "event_id")
    kind = lambda c: F.element_at(F.array(*map(F.lit, TYPES)), (c % 8 + 1).cast("int"))
    to = F.lead("user_id").over(day)
    label = F.create_map(*[F.lit(x) for pair in PREDICATE_OF.items() for x in pair])[F.col("event_type")]
    r = e.select("movie_id", "event_id", F.col("user_id").alias("from_user"), to.alias("to_user"), label.alias("label"), "props").where("to_user IS NOT NULL")
    return r.select("movie_id", "event_id", F.concat(F.lit("user "), "from_user").alias("from_name"), kind(F.col("from_user")).alias("from_type"), F.concat(F.lit("user "), "to_user").alias("to_name"), kind(F.col("to_user")).alias("to_type"), "label", F.concat(F.lit("event "), "event_id").alias("evidence"))


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_of(raw_relations(spark, sf_dir))


def entities_of(r: DataFrame) -> DataFrame:
    """The ends of relations."""
    one = lambda side: r.select("movie_id", F.col(f"{side}_name").alias("name"), F.col(f"{side}_type").alias("entity_type"))
    return one("from").union(one("to")).distinct()


def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as generated queries in the shapes that models return them."""
    c = table(spark, sf_dir, "conversations")
    quoted = F.replace(F.col("text"), F.lit('"'), F.lit(""))
    quoted = F.replace(quoted, F.lit("\n"), F.lit(" "))
    shape = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('{"query": "'), quoted, F.lit('"}'))).when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), quoted, F.lit("\n```"))).when(F.col("turn") % 4 == 2, F.concat(F.lit('{"query": "'), quoted)).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.concat(F.lit("movie_"), F.col("conv_id") % 20).alias("movie_id"), F.concat(F.lit("Movie "), F.col("conv_id") % 20).alias("movie_title"), shape.alias("query"), F.when(F.col("role") == "user", "synopsis").otherwise("scene_summary").alias("query_type"))


#: The same views for engines that speak ANSI SQL.
SQL = {
    "v_scenes": "SELECT vec_id, concat('movie_', label) AS movie_id, concat('Movie ', label) AS movie_title, printf('scene_%04d', vec_id // 5) AS scene_id, vec_id // 5 AS scene_index, concat('scene text ', vec_id) AS text, embedding FROM embeddings WHERE vec_id % 5 = 0",
    "v_sentences": "SELECT e.vec_id, s.movie_id, s.movie_title, s.scene_id, s.scene_index, concat('line ', e.vec_id) AS text, CASE e.vec_id % 5 WHEN 1 THEN 'description' WHEN 4 THEN 'transition' ELSE 'dialogue' END AS line_type, e.vec_id AS position_in_script, e.embedding FROM embeddings e JOIN v_scenes s ON e.vec_id // 5 = s.scene_index WHERE e.vec_id % 5 <> 0",
    "v_query_vecs": "SELECT vec_id AS query_id, embedding AS q, movie_id AS target_movie FROM v_sentences",
    "v_films": "SELECT vec_id, concat('film_', scene_index % 37) AS movie_id, scene_id, scene_index, embedding FROM v_scenes",
    "v_film_queries": "SELECT vec_id AS query_id, embedding AS q, concat('film_', scene_index % 37) AS movie_key FROM v_sentences",
    "v_lines0": "SELECT doc_id, source AS movie_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents",
    "v_lines": "SELECT doc_id, movie_id, content, line_no, substr('SNCEDT', CAST(line_no % 6 + 1 AS INTEGER), 1) AS tag FROM (SELECT doc_id, movie_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no FROM v_lines0 WHERE trim(content) <> '')",
    "v_rel0": "SELECT strftime(ts, '%Y-%m-%d') AS movie_id, event_id, user_id AS f, lead(user_id) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS t, CASE event_type WHEN 'click' THEN 'TEACHES' WHEN 'error' THEN 'BETRAYS' WHEN 'purchase' THEN 'OWES' WHEN 'signup' THEN 'ALLIES_WITH' WHEN 'view' THEN 'LOVES' END AS label FROM events",
    "v_relations": "SELECT movie_id, event_id, concat('user ', f) AS from_name, (['PERSON','EVENT','ORG','NORP','GPE','LOC','FAC','WORK_OF_ART'])[f % 8 + 1] AS from_type, concat('user ', t) AS to_name, (['PERSON','EVENT','ORG','NORP','GPE','LOC','FAC','WORK_OF_ART'])[t % 8 + 1] AS to_type, label, concat('event ', event_id) AS evidence FROM v_rel0 WHERE t IS NOT NULL",
    "v_entities": "SELECT DISTINCT movie_id, name, entity_type FROM (SELECT movie_id, from_name AS name, from_type AS entity_type FROM v_relations UNION ALL SELECT movie_id, to_name, to_type FROM v_relations)",
    "v_raw_queries": "SELECT conv_id * 1000 + turn AS row_id, concat('movie_', conv_id % 20) AS movie_id, concat('Movie ', conv_id % 20) AS movie_title, CASE turn % 4 WHEN 0 THEN concat('{\"query\": \"', b, '\"}') WHEN 1 THEN concat('```json', chr(10), b, chr(10), '```') WHEN 2 THEN concat('{\"query\": \"', b) ELSE text END AS query, CASE WHEN role = 'user' THEN 'synopsis' ELSE 'scene_summary' END AS query_type FROM (SELECT *, replace(replace(text, '\"', ''), chr(10), ' ') AS b FROM conversations)",
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and those they need, in order."""
    need = set(names)
    for name in reversed(SQL):
        if name in need:
            need |= {other for other in SQL if other != name and f" {other} " in f" {SQL[name]} "}
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in SQL if name in need)
