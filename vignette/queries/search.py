"""Vector search over scenes and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, vectors
from ..operators import index, nearest, search, store
from ..sources import views
from ..storage import new_folder
from .registry import cosine_sql, query

#: The query vector of the single-vector searches: ones and minus ones in turn.
PROBE = [1.0 if i % 2 == 0 else -1.0 for i in range(64)]
_PROBE = "(SELECT list(CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) FROM range(64) r(i))"


def _hits(table: str, k: int, where: str = "") -> str:
    return f"SELECT vec_id, movie_id, scene_id, score FROM (SELECT vec_id, movie_id, scene_id, {cosine_sql('embedding', _PROBE)} AS score FROM {table} {where}) ORDER BY score DESC, vec_id LIMIT {k}"


@query(_hits("v_sentences", 20), ("v_sentences",))
def v1_search_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(views.sentences(spark, sf_dir), PROBE, 20).select("vec_id", "movie_id", "scene_id", "score")


@query(_hits("v_scenes", 20), ("v_scenes",))
def v2_search_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(views.scenes(spark, sf_dir), PROBE, 20).select("vec_id", "movie_id", "scene_id", "score")


@query(_hits("v_sentences", 20, "WHERE movie_id = 'movie_3'"), ("v_sentences",))
def v3_search_in_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(views.sentences(spark, sf_dir), PROBE, 20, movie_id="movie_3").select("vec_id", "movie_id", "scene_id", "score")


@query("SELECT DISTINCT s.movie_id, s.scene_id, s.scene_index, s.text, 0.0::DOUBLE AS score FROM v_scenes s JOIN (SELECT DISTINCT movie_id, scene_id FROM v_sentences WHERE line_type = 'transition') w USING (movie_id, scene_id)", ("v_sentences",))
def v4_fetch_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.sentences(spark, sf_dir).where("line_type = 'transition'").select("movie_id", "scene_id").distinct()
    return store.fetch(views.scenes(spark, sf_dir), wanted, ["movie_id", "scene_id"]).select("movie_id", "scene_id", "scene_index", "text", F.lit(0.0).alias("score"))


_HIER = f"""
low0 AS (SELECT q.query_id, s.movie_id, s.scene_id, s.vec_id, {cosine_sql('q.q', 's.embedding')} AS score FROM v_query_vecs q CROSS JOIN v_sentences s),
low AS (SELECT query_id, movie_id, scene_id, max(score) AS low FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM low0) WHERE n <= %(pool)s GROUP BY ALL),
high0 AS (SELECT q.query_id, s.movie_id, s.scene_id, s.vec_id, {cosine_sql('q.q', 's.embedding')} AS score FROM v_query_vecs q CROSS JOIN v_scenes s),
high AS (SELECT query_id, movie_id, scene_id, max(score) AS high FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM high0) WHERE n <= %(k)s GROUP BY ALL),
merged AS (SELECT query_id, movie_id, scene_id, greatest(coalesce(low, 0.0::DOUBLE), coalesce(high, 0.0::DOUBLE)) AS score FROM low FULL OUTER JOIN high USING (query_id, movie_id, scene_id)),
hits AS (SELECT m.query_id, m.movie_id, m.scene_id, s.scene_index, m.score, m.rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id, scene_id) AS rank FROM merged) m JOIN v_scenes s USING (movie_id, scene_id) WHERE m.rank <= %(k)s)"""


@query("SELECT query_id, movie_id, scene_id, scene_index, score, rank FROM hits", ("v_query_vecs", "v_scenes"), (_HIER % {"pool": 100, "k": 20}).strip())
def v5_hierarchical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hierarchical(views.query_vectors(spark, sf_dir), views.scenes(spark, sf_dir), views.sentences(spark, sf_dir)).select("query_id", "movie_id", "scene_id", "scene_index", "score", "rank")


_ROLL = "SELECT query_id, movie_id, best_scene, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM (SELECT query_id, movie_id, scene_id AS best_scene, score, row_number() OVER (PARTITION BY query_id, movie_id ORDER BY score DESC, scene_index) AS n FROM hits) WHERE n = 1) WHERE rank <= 10"


@query(_ROLL, ("v_query_vecs", "v_scenes"), (_HIER % {"pool": 100, "k": 30}).strip())
def a2_search_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every sentence asks for its movie."""
    return search.search_movies(views.query_vectors(spark, sf_dir), views.scenes(spark, sf_dir), views.sentences(spark, sf_dir)).select("query_id", "movie_id", "best_scene", "score", "rank")


_ONE = f"""
low AS (SELECT movie_id, scene_id, max(score) AS low FROM (SELECT movie_id, scene_id, vec_id, {cosine_sql('embedding', _PROBE)} AS score FROM v_sentences ORDER BY score DESC, vec_id LIMIT 100) GROUP BY ALL),
high AS (SELECT movie_id, scene_id, max(score) AS high FROM (SELECT movie_id, scene_id, vec_id, {cosine_sql('embedding', _PROBE)} AS score FROM v_scenes ORDER BY score DESC, vec_id LIMIT 20) GROUP BY ALL),
merged AS (SELECT movie_id, scene_id, greatest(coalesce(low, 0.0::DOUBLE), coalesce(high, 0.0::DOUBLE)) AS score FROM low FULL OUTER JOIN high USING (movie_id, scene_id))"""


@query("SELECT m.movie_id, m.movie_id AS movie, m.scene_id, s.scene_index, m.score, m.rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, movie_id, scene_id) AS rank FROM merged) m JOIN v_scenes s USING (movie_id, scene_id) WHERE rank <= 20", ("v_sentences",), _ONE.strip())
def a3_search_scenes_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.hierarchical_one(views.scenes(spark, sf_dir), views.sentences(spark, sf_dir), PROBE)
    return hits.select("movie_id", F.col("movie_id").alias("movie"), "scene_id", "scene_index", "score", "rank")


@query(f"SELECT query_id, movie_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM (SELECT q.query_id, s.movie_id, max({cosine_sql('q.q', 's.embedding')}) AS score FROM v_query_vecs q CROSS JOIN v_scenes s GROUP BY ALL)) WHERE rank <= 20", ("v_query_vecs", "v_scenes"))
def a6_scene_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scene_pool(views.query_vectors(spark, sf_dir), views.scenes(spark, sf_dir)).select("query_id", "movie_id", "score", "rank")


@query("SELECT scene_id, movie_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE scene_index END AS scene_index, CASE WHEN vec_id % 2 = 0 THEN 'description' ELSE 'dialogue' END AS line_type, CASE WHEN vec_id % 7 = 0 THEN '' ELSE text END AS text FROM v_scenes", ("v_scenes",))
def v6_payload_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that some payloads lack and others have."""
    s = views.scenes(spark, sf_dir)
    missing = s.withColumns({"line_type": F.when(F.col("vec_id") % 2 != 0, "dialogue"), "text": F.when(F.col("vec_id") % 7 != 0, F.col("text")), "scene_index": F.when(F.col("vec_id") % 3 != 0, F.col("scene_index"))})
    return search.with_defaults(missing).select("scene_id", "movie_id", "scene_index", "line_type", "text")


@query("SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS length, round(u[1], 6) AS first_part FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings)")
def v21_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first_part"))


@query("SELECT vec_id, CAST(len(v) AS INTEGER) AS dimension, round(list_sum(CAST(v AS DOUBLE[])), 5) AS total FROM (SELECT vec_id, coalesce(CASE WHEN label = 0 THEN NULL ELSE embedding END, list_transform(range(64), lambda i: 0.0::FLOAT)) AS v FROM embeddings)")
def v15_zero_vector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").withColumn("v", vectors.or_zeros(F.when(F.col("label") != 0, F.col("embedding")), 64))
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.size("v").alias("dimension"), F.round(total, 5).alias("total"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings")
def v19_checked_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").withColumn("v", vectors.checked(F.col("embedding"), 64))
    return e.select("vec_id", F.size("v").alias("dimension"))


@query()
def v17_ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.ivf(views.table(spark, sf_dir, "embeddings"), lists=8)
    q = views.query_vectors(spark, sf_dir)
    return index.ivf_search(built, q, k=10, probes=index.probes_needed(built, q, 10))


@query()
def v18_int8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    return index.int8_search(e, index.int8_bound(e), PROBE, k=20, rescore=5)


_UUID = "SELECT vec_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '1' THEN '9' WHEN '2' THEN 'a' WHEN '3' THEN 'b' WHEN '4' THEN '8' WHEN '5' THEN '9' WHEN '6' THEN 'a' WHEN '7' THEN 'b' WHEN '8' THEN '8' WHEN '9' THEN '9' WHEN 'a' THEN 'a' WHEN 'b' THEN 'b' WHEN 'c' THEN '8' WHEN 'd' THEN '9' WHEN 'e' THEN 'a' ELSE 'b' END, substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id FROM (SELECT vec_id, sha1(from_hex('a1b2c3d4e5f67890abcdef1234567890') || encode(concat(movie_id, '::', scene_id{more}))) AS h FROM {table})"


@query(_UUID.format(more="", table="v_scenes"), ("v_scenes",))
def v7_scene_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenes(spark, sf_dir).select("vec_id", ids.scene_point_id(F.col("movie_id"), F.col("scene_id")).alias("point_id"))


@query(_UUID.format(more=", '::', position_in_script", table="v_sentences"), ("v_sentences",))
def v7_sentence_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sentences(spark, sf_dir)
    return s.select("vec_id", ids.sentence_point_id(F.col("movie_id"), F.col("scene_id"), F.col("position_in_script")).alias("point_id"))


# --- the store, on scenes as points -------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), "vec_id").alias("id"), F.concat(F.lit("text "), "vec_id").alias("document"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "embedding", "vec_id", "label")


_ROWS = ("id", "document", "metadata", "embedding")


@query("SELECT id, document, label FROM (SELECT concat('p', vec_id) AS id, CASE WHEN label = 3 THEN concat('new ', vec_id) ELSE concat('text ', vec_id) END AS document, CAST(label AS VARCHAR) AS label FROM embeddings UNION ALL SELECT concat('q', vec_id), concat('new ', vec_id), CAST(label AS VARCHAR) FROM embeddings WHERE label = 3)")
def v8_upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a store: the first batch repeats every id, the second some with other contents, of which the last wins; a store
    opened anew reads the result."""
    p = _points(spark, sf_dir)
    changed = p.where("label = 3").withColumn("document", F.concat(F.lit("new "), "vec_id"))
    new = changed.withColumn("id", F.concat(F.lit("q"), "vec_id"))
    stale = changed.withColumn("document", F.lit("stale"))
    kept = store.Store(spark, new_folder(spark, "store"), 64)
    kept.upsert("points", p.select(*_ROWS).unionByName(p.select(*_ROWS)))
    kept.upsert("points", stale.unionByName(new).unionByName(changed).select(*_ROWS))
    merged = store.Store(spark, kept.folder, 64).get("points")
    return merged.select("id", "document", F.col("metadata")["label"].alias("label"))


@query("SELECT concat('p', vec_id) AS id, CASE WHEN label = 1 THEN 'changed' ELSE concat('text ', vec_id) END AS document, CASE WHEN label = 2 THEN NULL ELSE CAST(label AS VARCHAR) END AS label FROM embeddings")
def v12_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    change = p.where("label IN (1, 2)").select("id", F.when(F.col("label") == 1, "changed").alias("document"), F.lit(None).cast("map<string,string>").alias("metadata"), (F.col("label") == 2).alias("metadata_given"), F.lit(None).cast("array<float>").alias("embedding"))
    return store.update(p.select(*_ROWS), change).select("id", "document", F.col("metadata")["label"].alias("label"))


@query("SELECT concat('p', vec_id) AS id FROM embeddings WHERE label <> 4")
def v13_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return store.delete(p.select(*_ROWS), p.where("label = 4").select("id")).select("id")


@query("SELECT concat('p', vec_id) AS id FROM embeddings ORDER BY concat('p', vec_id) LIMIT 50 OFFSET 25")
def v14_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scroll(_points(spark, sf_dir), 50, 25).select("id")


@query("SELECT count(*) AS points, count(*) FILTER (label = 5) AS found FROM embeddings")
def v11_count_and_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    wanted = p.where("label = 5").select("id").unionByName(spark.createDataFrame([("nowhere",)], "id string"))
    return p.agg(F.count("*").alias("points")).crossJoin(store.fetch(p, wanted, ["id"]).agg(F.count("*").alias("found")))


@query("SELECT concat('p', vec_id) AS id, 'known' AS state FROM embeddings WHERE label = 6 UNION ALL SELECT concat('n', vec_id), 'added' FROM embeddings WHERE label = 6 UNION ALL SELECT concat('p', vec_id), 'kept' FROM embeddings")
def v10_add_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with known ids fails as a whole, and so does one that repeats an id; what is new is added."""
    p = _points(spark, sf_dir)
    batch = p.where("label = 6").unionByName(p.where("label = 6").withColumn("id", F.concat(F.lit("n"), "vec_id")))
    known = store.fetch(batch, p, ["id"]).select("id", F.lit("known").alias("state"))
    new = store.absent(batch, p)
    for bad in (batch, new.unionByName(new)):
        try:
            store.add(p, bad)
        except ValueError:
            continue
        raise RuntimeError("a guarded batch was added")
    return known.unionByName(store.add(p, new).select("id", F.when(F.col("id").startswith("n"), "added").otherwise("kept").alias("state")))
