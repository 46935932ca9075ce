"""Training pairs, and the table functions of the data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import hooks
from ..functions import repair
from ..operators import mine
from ..sources import views
from .registry import cosine_sql, query

_PAIRS = f"""
own AS (SELECT q.query_id, s.vec_id, {cosine_sql('q.q', 's.embedding')} AS score FROM v_query_vecs q JOIN v_scenes s ON q.target_movie = s.movie_id),
two AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM own) WHERE rank <= 2),
pos AS (SELECT query_id, vec_id, score, rank FROM two WHERE lead >= 0.35 AND (rank = 1 OR round(lead - score, 6) < 0.05))""".strip()


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.query_vectors(spark, sf_dir).withColumnRenamed("target_movie", "movie_id")


@query("SELECT query_id, vec_id, score, rank FROM pos", ("v_query_vecs", "v_scenes"), _PAIRS)
def m2_assign_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.assign_batch(_asked(spark, sf_dir), views.scenes(spark, sf_dir)).select("query_id", "vec_id", "score", "rank")


@query("SELECT q.query_id, t.vec_id, t.score FROM v_query_vecs q LEFT JOIN (SELECT * FROM two WHERE rank = 1 AND score >= 0.35) t USING (query_id)", ("v_query_vecs", "v_scenes"), _PAIRS)
def m1_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.assign(_asked(spark, sf_dir), views.scenes(spark, sf_dir)).select("query_id", "vec_id", "score")


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.query_id, s.vec_id, {cosine_sql('q.q', 's.embedding')} AS score FROM v_query_vecs q JOIN v_scenes s ON q.target_movie <> s.movie_id)) WHERE rank <= 5", ("v_query_vecs", "v_scenes"))
def m4_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.hard_negatives(_asked(spark, sf_dir), views.scenes(spark, sf_dir)).select("query_id", "vec_id", "score", "rank")


@query("SELECT query_id, 3::BIGINT AS negatives, 3::BIGINT AS different, 0::BIGINT AS own FROM v_query_vecs", ("v_query_vecs",))
def m3_negative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the draw has to keep: three different scenes a query, none of its movie."""
    asked, s = _asked(spark, sf_dir), views.scenes(spark, sf_dir)
    drawn = mine.random_negatives(asked, s).join(s.select("vec_id", F.col("movie_id").alias("of")), "vec_id").join(asked.select("query_id", "movie_id"), "query_id")
    return drawn.groupBy("query_id").agg(F.count("*").alias("negatives"), F.countDistinct("vec_id").alias("different"), F.sum((F.col("of") == F.col("movie_id")).cast("bigint")).alias("own"))


@query()
def m3_random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn by Spark's own hash, which ANSI SQL lacks."""
    return mine.random_negatives(_asked(spark, sf_dir), views.scenes(spark, sf_dir))


_LONG = "lng AS (SELECT doc_id, source AS movie_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS scene_idx FROM documents)"


@query("SELECT doc_id, movie_id, scene_idx FROM lng WHERE scene_idx < 3", (), _LONG)
def m6_longest_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the scenes of their source."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("movie_id"), "text")
    return mine.longest_scenes(d, key="doc_id").select("doc_id", "movie_id", "scene_idx")


@query("SELECT q.doc_id AS query_id, s.doc_id AS positive, q.scene_idx FROM (SELECT doc_id, source AS movie_id, CAST(doc_id % 4 AS INTEGER) AS scene_idx FROM documents) q JOIN lng s ON q.movie_id = s.movie_id AND q.scene_idx = s.scene_idx WHERE s.scene_idx < 3", (), _LONG)
def j19_scene_by_length_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("movie_id"), "text")
    asked = d.select(F.col("doc_id").alias("query_id"), "movie_id", (F.col("doc_id") % 4).cast("int").alias("scene_idx"))
    return asked.join(mine.longest_scenes(d, key="doc_id").select("movie_id", "scene_idx", F.col("doc_id").alias("positive")), ["movie_id", "scene_idx"]).select("query_id", "positive", "scene_idx")


@query("SELECT q.query_id, pos.vec_id AS positive, 3::BIGINT AS negatives, 0::BIGINT AS own FROM v_query_vecs q JOIN pos USING (query_id)", ("v_query_vecs", "v_scenes"), _PAIRS)
def m5_assembled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all synopsis queries, with the number of their negatives and of those from the own movie."""
    asked = _asked(spark, sf_dir).withColumns({"query_type": F.lit("synopsis"), "scene_idx": F.lit(None).cast("int")})
    s = views.scenes(spark, sf_dir)
    pairs = mine.training_columns(mine.assemble(asked, mine.assign_batch(asked, s), s))
    flat = pairs.select("query_id", "movie_id", "positive", F.explode(F.array("negative_0", "negative_1", "negative_2")).alias("vec_id")).join(s.select("vec_id", F.col("movie_id").alias("of")), "vec_id")
    return flat.groupBy("query_id", "positive").agg(F.countDistinct("vec_id").alias("negatives"), F.sum((F.col("of") == F.col("movie_id")).cast("bigint")).alias("own"))


@query("SELECT concat('movie_', conv_id % 20) AS movie_title, coalesce(max(CASE WHEN turn * 33 >= 100 THEN turn * 33 END), 99) + 1 AS next_idx FROM conversations GROUP BY 1")
def a28_next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations").select(F.concat(F.lit(" Movie_"), F.col("conv_id") % 20).alias("movie_title"), (F.col("turn") * 33).alias("scene_idx"))
    return mine.next_scene_idx(c)


_LINES = "nn AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY movie_id) AS c FROM v_relations)"


@query("SELECT movie_id, any_value(c) AS relations, string_agg(concat('  ', from_name, ' --', coalesce(label, '?'), '--> ', to_name, '   (\"', evidence, '\")'), chr(10) ORDER BY n) AS shown FROM nn WHERE n <= 20 AND c >= 10 GROUP BY movie_id", ("v_relations",), _LINES)
def a29_relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.relation_lines(views.raw_relations(spark, sf_dir).withColumnRenamed("event_id", "ord"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 8 AS INTEGER) AS worker FROM documents")
def a30_balanced_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.balanced(views.table(spark, sf_dir, "documents"), 8, "n_chars", "doc_id").select("doc_id", "worker")


@query("SELECT label, CASE WHEN label < 3 THEN 'held' ELSE 'train' END AS half, count(*) AS vectors FROM embeddings GROUP BY label")
def j13_held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    train, held = mine.split(e, e.where("label < 3").select("label"), "label")
    both = train.select("label", F.lit("train").alias("half")).unionByName(held.select("label", F.lit("held").alias("half")))
    return both.groupBy("label", "half").agg(F.count("*").alias("vectors"))


@query("SELECT doc_id, source, text FROM documents WHERE contains(lower(text), 'the') AND n_chars >= 1000 ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def ui1_data_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.grid(views.table(spark, sf_dir, "documents").where("n_chars >= 1000"), contains={"text": "the"}, order=[F.desc("n_chars"), F.col("doc_id")], page=1, size=25).select("doc_id", "source", "text")


_HARD = f"hard AS (SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.query_id, s.vec_id, {cosine_sql('q.q', 's.embedding')} AS score FROM v_query_vecs q JOIN v_scenes s ON q.target_movie <> s.movie_id)) WHERE rank <= 3)"


@query("SELECT query_id, max(CASE WHEN rank = 1 THEN vec_id END) AS negative_0, max(CASE WHEN rank = 2 THEN vec_id END) AS negative_1, max(CASE WHEN rank = 3 THEN vec_id END) AS negative_2 FROM hard GROUP BY query_id", ("v_query_vecs", "v_scenes"), _HARD)
def s13_training_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = mine.hard_negatives(_asked(spark, sf_dir), views.scenes(spark, sf_dir), 3)
    lists = hard.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l"))
    return mine.training_columns(lists.select("query_id", F.transform("l", lambda x: x["vec_id"]).alias("negatives")))


@query("SELECT q.query_id, count(*) AS relevant, min(s.scene_id) AS first_scene FROM v_query_vecs q JOIN v_scenes s ON q.target_movie = s.movie_id GROUP BY q.query_id", ("v_query_vecs", "v_scenes"))
def j20_relevant_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenes of a query's movie; scenes are collected once a movie, not once a query."""
    of = views.scenes(spark, sf_dir).groupBy("movie_id").agg(F.sort_array(F.collect_set("scene_id")).alias("scenes"))
    return _asked(spark, sf_dir).join(of, "movie_id").select("query_id", F.size("scenes").cast("bigint").alias("relevant"), F.element_at("scenes", 1).alias("first_scene"))


@query("SELECT s.scene_id, s.movie_id, CAST(len(e.embedding) AS INTEGER) AS dimension, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_part FROM v_scenes s JOIN embeddings e USING (vec_id)", ("v_scenes",))
def p9_scene_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and their vectors meet by key; a chunk without a vector fails the query."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made = mine.with_vectors(views.scenes(spark, sf_dir).drop("embedding"), e, ["vec_id"])
    return made.select("scene_id", "movie_id", F.size("embedding").alias("dimension"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_part"))


_TEXT = r"""regexp_replace(regexp_replace(text, '["\\\n\r\t]', ' ', 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT conv_id, turn, CASE WHEN {_TEXT} = '' THEN [] ELSE [{_TEXT}, {_TEXT}] END AS items FROM conversations")
def f13_reply_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as a model's reply, whole for even turns and cut off for odd ones."""
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", r'["\\\n\r\t]', " "), F.lit('"'))
    reply = F.concat(F.lit('{"queries": ['), quoted, F.lit(", "), quoted, F.when(F.col("turn") % 2 == 0, "]}").otherwise(', "cut'))
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", repair.string_list(reply).alias("items"))


_BARE = r"regexp_replace(b, '^\s+|\s+$', '', 'g')"
_PLAIN = r"regexp_replace(trim(trim(regexp_replace(regexp_replace(regexp_replace(query, '^\s+|\s+$', '', 'g'), '^```(json)?\s*', ''), '\s*```$', ''), '\"'), chr(39)), '^\s+|\s+$', '', 'g')"
_SUMMARY = "rq AS (SELECT *, row_id % 1000 % 4 AS shape, substr(query, 12, length(query) - 13) AS b FROM v_raw_queries)"


@query(f"SELECT row_id, CASE WHEN shape = 0 THEN nullif({_BARE}, '') WHEN upper({_PLAIN}) <> 'SKIP' AND {_PLAIN} <> '' AND len(regexp_extract_all({_PLAIN}, '[^ \\t\\n\\r\\f]+')) <= 50 THEN {_PLAIN} END AS summary FROM rq", ("v_raw_queries",), _SUMMARY)
def f14_scene_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raw_queries(spark, sf_dir)
    return r.select("row_id", repair.scene_summary(F.col("query")).alias("summary"))


@query()
def g1_capitalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.capitalised_names(views.table(spark, sf_dir, "documents"), "doc_id")
