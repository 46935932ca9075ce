"""Two-level search: sentences and scenes, merged by maximum, rolled up to movies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import block_group_best, block_top_k, search

TOP_K, MOST_TOP_K = 10, 25
POOL, MOST_POOL = 100, 300
OVERFETCH = 3


def limits(top_k: int | None = None, pool: int | None = None, most_top_k: int = MOST_TOP_K, most_pool: int = MOST_POOL) -> tuple[int, int]:
    """The request's limits with defaults; out of range is an error."""
    k, p = TOP_K if top_k is None else top_k, POOL if pool is None else pool
    if not 1 <= k <= most_top_k:
        raise ValueError(f"top_k must be in 1..{most_top_k}, got {k}")
    if not 1 <= p <= most_pool:
        raise ValueError(f"sentence_pool must be in 1..{most_pool}, got {p}")
    return k, p


def merge_levels(sentence_hits: DataFrame, scene_hits: DataFrame, top_k: int) -> DataFrame:
    """Inputs (query_id, movie_id, scene_id, score). The maximum of both levels, a missing side counting 0; the top_k of
    each query by score, movie and scene. Scenes are told apart by movie and scene id together."""
    key = ["query_id", "movie_id", "scene_id"]
    low = sentence_hits.groupBy(*key).agg(F.max("score").alias("low"))
    high = scene_hits.groupBy(*key).agg(F.max("score").alias("high"))
    both = low.join(high, key, "full_outer").select(*key, F.greatest(F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "movie_id", "scene_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def with_payload(hits: DataFrame, scenes: DataFrame, *columns: str) -> DataFrame:
    """Hits whose scene exists, with its columns; joined after the cut, so only k rows a query carry text."""
    return hits.join(scenes.select("movie_id", "scene_id", *columns), ["movie_id", "scene_id"])


def hierarchical(queries: DataFrame, scenes: DataFrame, sentences: DataFrame, top_k: int = 20, pool: int = 100) -> DataFrame:
    """(query_id, movie_id, scene_id, scene_index, score, rank) of a batch of queries (query_id, q)."""
    low = block_top_k(queries, sentences, pool).join(sentences.select(F.col("vec_id").alias("corpus_id"), "movie_id", "scene_id"), "corpus_id")
    high = block_top_k(queries, scenes, top_k).join(scenes.select(F.col("vec_id").alias("corpus_id"), "movie_id", "scene_id"), "corpus_id")
    return with_payload(merge_levels(low, high, top_k), scenes, "scene_index")


def hierarchical_one(scenes: DataFrame, sentences: DataFrame, query: Sequence[float], top_k: int = 20, pool: int = 100, movie_id: str | None = None) -> DataFrame:
    """The same for one vector: two top-k scans, no shuffle but that of k rows."""
    one = lambda df: df.select(F.lit(0).alias("query_id"), "movie_id", "scene_id", "score")
    low = one(search(sentences, query, pool, movie_id=movie_id))
    high = one(search(scenes, query, top_k, movie_id=movie_id))
    return with_payload(merge_levels(low, high, top_k), scenes, "scene_index", "movie_title").drop("query_id")


def movies(hits: DataFrame, top_k: int, *carry: str) -> DataFrame:
    """Best scene of every movie, the top_k movies of each query."""
    best = Window.partitionBy("query_id", "movie_id").orderBy(F.desc("score"), "scene_index")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "movie_id")
    one = hits.withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", "movie_id", F.col("scene_id").alias("best_scene"), "score", *carry)
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def search_movies(queries: DataFrame, scenes: DataFrame, sentences: DataFrame, top_k: int | None = None, pool: int | None = None) -> DataFrame:
    k, p = limits(top_k, pool)
    return movies(hierarchical(queries, scenes, sentences, k * OVERFETCH, p), k)


def scene_pool(queries: DataFrame, scenes: DataFrame, top_k: int = 20) -> DataFrame:
    """Every movie's best scene over all scenes: exact, without a candidate cut."""
    per_movie = block_group_best(queries, scenes, "movie_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "movie_id")
    return per_movie.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


PAYLOAD_DEFAULTS = {"movie_id": "", "movie_title": "", "scene_id": "", "scene_index": 0, "text": "", "line_type": "description", "position_in_script": 0}


def with_defaults(hits: DataFrame) -> DataFrame:
    """Missing payload fields filled; title of a scene and speaker stay null, character names become an empty list."""
    out = hits
    for name, value in PAYLOAD_DEFAULTS.items():
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    if "character_names" in out.columns:
        out = out.withColumn("character_names", F.coalesce("character_names", F.array().cast("array<string>")))
    return out
