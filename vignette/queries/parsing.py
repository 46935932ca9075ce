"""Scripts parsed to scenes and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse
from ..sources import views
from .registry import query

_BY = ["movie_id", "doc_id"]

_STATE = """
p0 AS (SELECT *, CAST(sum(CASE WHEN tag = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) - 1 AS scene_index FROM v_lines),
p1 AS (SELECT *, last_value(CASE WHEN tag = 'C' THEN content END IGNORE NULLS) OVER w AS speaker, last_value(CASE WHEN tag IN ('S', 'C', 'E', 'D') THEN concat(tag, content) END IGNORE NULLS) OVER w AS ev FROM p0 WINDOW w AS (PARTITION BY doc_id, scene_index ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p2 AS (SELECT *, CASE WHEN ev[1] = 'E' AND length(ev) > 1 THEN substr(ev, 2) END AS ext FROM p1)""".strip()


@query("SELECT movie_id, doc_id, printf('scene_%04d', scene_index) AS scene_id, scene_index, content AS text, CASE tag WHEN 'N' THEN 'description' WHEN 'D' THEN 'dialogue' ELSE 'transition' END AS line_type, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS position_in_script, CASE WHEN tag = 'D' THEN speaker END AS character_name FROM p2 WHERE tag IN ('N', 'D', 'T')", ("v_lines",), _STATE)
def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.sentences(views.lines(spark, sf_dir), _BY)


_SCENES = _STATE + """,
p3 AS (SELECT movie_id, doc_id, scene_index, line_no, CASE WHEN tag = 'D' THEN concat(coalesce(speaker, 'None'), CASE WHEN ext IS NOT NULL THEN concat(' (', ext, ')') ELSE '' END, ': ', content) ELSE content END AS shown, CASE WHEN tag = 'D' THEN speaker END AS who FROM p2 WHERE tag IN ('S', 'N', 'D', 'T') AND scene_index >= 0),
p4 AS (SELECT movie_id, doc_id, scene_index, string_agg(shown, chr(10) ORDER BY line_no) AS text, arg_min(shown, line_no) AS scene_title FROM p3 GROUP BY ALL),
p5 AS (SELECT doc_id, scene_index, string_agg(who, '|' ORDER BY f) AS characters FROM (SELECT doc_id, scene_index, who, min(line_no) AS f FROM p3 WHERE who <> '' GROUP BY ALL) GROUP BY ALL)"""


@query("SELECT movie_id, doc_id, printf('scene_%04d', scene_index) AS scene_id, scene_index, text, scene_title, coalesce(characters, '') AS characters FROM p4 LEFT JOIN p5 USING (doc_id, scene_index)", ("v_lines",), _SCENES)
def p7_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parse.scenes(views.lines(spark, sf_dir), _BY)
    return s.select(*_BY, "scene_id", "scene_index", "text", "scene_title", F.array_join("character_names", "|").alias("characters"))


_CORPUS = _SCENES + """,
p6 AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS words FROM p4)"""


@query("SELECT doc_id, printf('scene_%04d', scene_index) AS scene_id, words, o.overview FROM p6 JOIN (SELECT source AS movie_id, concat('about ', source) AS overview FROM documents GROUP BY source) o USING (movie_id) WHERE words >= 40", ("v_lines",), _CORPUS)
def p10_scene_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = views.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("movie_id")).agg(F.first(F.concat(F.lit("about "), "source")).alias("overview"))
    c = parse.corpus(parse.scenes(views.lines(spark, sf_dir), _BY), movies)
    return c.select("doc_id", "scene_id", F.size(F.split(F.trim("text"), r"\s+")).cast("bigint").alias("words"), "overview")


@query("SELECT doc_id, count(*) AS sentences FROM (SELECT p2.doc_id FROM p2 JOIN p6 ON p2.doc_id = p6.doc_id AND p2.scene_index = p6.scene_index WHERE tag IN ('N', 'D', 'T') AND words >= 40) GROUP BY doc_id", ("v_lines",), _CORPUS)
def p11_sentences_of_kept_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.lines(spark, sf_dir)
    movies = views.table(spark, sf_dir, "documents").select(F.col("source").alias("movie_id"), F.lit("").alias("overview")).distinct()
    kept = parse.surviving(parse.sentences(lines, _BY), parse.corpus(parse.scenes(lines, _BY), movies), _BY)
    return kept.groupBy("doc_id").agg(F.count("*").alias("sentences"))


_TRIM = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_TRIM} AS scene FROM (SELECT doc_id, i, n, substr(text, i * 1000 + 1, 1000) AS s FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 1000 + 1)) AS i, (length(text) - 1) // 1000 + 1 AS n FROM documents)) WHERE i < n - 1 AND length({_TRIM}) BETWEEN 200 AND 3000")
def p12_ranking_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(parse.split_scenes(F.col("text"), **parse.RANKING_SCENES)).alias("scene"))


@query("SELECT doc_id, s AS scene FROM (SELECT doc_id, substr(text, i * 800 + 1, 800) AS s FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 800 + 1)) AS i FROM documents)) WHERE length(s) BETWEEN 300 AND 2500")
def p13_generation_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(parse.split_scenes(F.col("text"), **parse.GENERATION_SCENES)).alias("scene"))


@query()
def p14_packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").withColumn("chunks", parse.paragraphs_packed(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))))
    return d.select("doc_id", F.size("chunks").alias("chunks"), F.transform("chunks", F.length).alias("sizes"))


@query()
def p15_random_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.random_scene(parse.scenes(views.lines(spark, sf_dir), _BY), _BY)
