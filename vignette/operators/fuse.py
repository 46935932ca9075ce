"""Fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_hits(semantic: DataFrame, graph: DataFrame, top_k: int) -> DataFrame:
    """semantic (query_id, movie_id, score), graph (query_id, movie_id, score, ord) in the order of the matches. Both are
    divided by their query's maximum. Each match of a movie that was also found semantically halves the way to its own
    score, in order; a movie that only matched takes its last match. graph_score is the last raw score."""
    q = Window.partitionBy("query_id")
    best = F.max("score").over(q)
    s = semantic.select("query_id", "movie_id", F.col("score").alias("semantic_score"), F.when(best != 0, F.col("score") / best).otherwise(F.col("score")).alias("s0"))
    g = graph.select("query_id", "movie_id", "ord", F.col("score").alias("raw"), F.when(best != 0, F.col("score") / best).otherwise(F.col("score")).alias("g"))
    listed = g.groupBy("query_id", "movie_id").agg(F.array_sort(F.collect_list(F.struct("ord", "g", "raw"))).alias("l"))
    both = s.join(listed, ["query_id", "movie_id"], "full_outer")
    last = F.element_at("l", -1)
    score = F.when(F.col("l").isNull(), F.col("s0")).when(F.col("s0").isNull(), last["g"]).otherwise(F.aggregate("l", F.col("s0"), lambda a, x: (a + x["g"]) / 2))
    out = both.select("query_id", "movie_id", F.round(score, 6).alias("score"), "semantic_score", last["raw"].alias("graph_score"), F.coalesce(F.size("l"), F.lit(0)).alias("matches"))
    out = out.withColumn("matches", F.greatest("matches", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("graph_score", F.lit(0.0))), F.desc(F.coalesce("semantic_score", F.lit(0.0))), "movie_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def strategy(queries: DataFrame, semantic: DataFrame, graph: DataFrame, results: DataFrame, use_semantic: bool = True, use_graph: bool = True) -> DataFrame:
    """(query_id, strategy): what each query's results rest on."""
    has = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    rows = queries.select("query_id").distinct()
    for df, name in ((semantic, "s"), (graph, "g"), (results, "r")):
        rows = rows.join(has(df, name), "query_id", "left")
    s, g = F.col("s").isNotNull(), F.col("g").isNotNull()
    both = s & g & F.lit(use_semantic and use_graph)
    return rows.select("query_id", F.when(F.col("r").isNull(), "no_results").when(both, "hybrid").when(s, "semantic_only").otherwise("graph_only").alias("strategy"))


def linear(semantic: DataFrame, graph: DataFrame, weight: float = 0.5) -> DataFrame:
    """The documented variant: semantic score plus `weight` for any match."""
    s = semantic.select("query_id", "movie_id", "score")
    g = graph.select("query_id", "movie_id").distinct().withColumn("hit", F.lit(weight))
    return s.join(g, ["query_id", "movie_id"], "full_outer").select("query_id", "movie_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("hit", F.lit(0.0)), 6).alias("score"))


def reciprocal_rank(runs: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """runs (query_id, run, rank, movie_key, movie_name): sum of 1 / (k + rank); the name of the first run that has it."""
    summed = runs.groupBy("query_id", "movie_key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min_by("movie_name", F.struct("run", "rank")).alias("movie_name"), F.min(F.struct("run", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "movie_key")
    ranked = summed.withColumn("rank", F.row_number().over(order)).drop("first")
    return ranked if top is None else ranked.where(F.col("rank") <= top)
