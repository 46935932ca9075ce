"""Whole evaluations: a retriever over all queries at once, fused runs, one report row. Rating studies to grading rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse, measure

#: (queries, top_k, run) to (query_id, rank, movie_key, movie_name)
Retriever = Callable[[DataFrame, int, int], DataFrame]

KS, SCENE_KS = (5, 10, 15, 20), (5, 10, 20)


def run_hits(queries: DataFrame, retrieve: Retriever, ks: Sequence[int] = KS, runs: int = 1) -> DataFrame:
    """queries (query_id, movie_key, ...) with the rank of their target; several runs are fused by reciprocal rank, and the
    fused list is not cut."""
    top_k = max(ks)
    if runs == 1:
        results = retrieve(queries, top_k, 0)
    else:
        one = [retrieve(queries, top_k, r).select("query_id", "rank", "movie_key", "movie_name", F.lit(r).alias("run")) for r in range(runs)]
        all_ = one[0]
        for more in one[1:]:
            all_ = all_.unionByName(more)
        results = fuse.reciprocal_rank(all_)
    return measure.first_hits(queries, results.select("query_id", "movie_key", "rank"))


def run_pipeline(queries: DataFrame, retrieve: Retriever, ks: Sequence[int] = KS, runs: int = 1) -> DataFrame:
    """The report row of an evaluation."""
    return measure.report(run_hits(queries, retrieve, ks, runs), ks)


def known_targets(queries: DataFrame, corpus: DataFrame, key: str = "movie_key") -> DataFrame:
    """The queries whose target is in the corpus."""
    return queries.join(corpus.select(key).distinct(), key, "left_semi").select(*queries.columns)


def run_scene_eval(queries: DataFrame, retrieve: Retriever, corpus: DataFrame, ks: Sequence[int] = SCENE_KS) -> DataFrame:
    """One row: the report over the queries whose target the corpus holds, MRR to four digits, and skipped_missing_target.
    Without any such query all counts and averages are 0 and the median is null."""
    valid = known_targets(queries, corpus)
    row = measure.report(measure.first_hits(valid, retrieve(valid, max(ks), 0).select("query_id", "movie_key", "rank")), ks, digits=4, failed_beyond=None)
    zeros = {c: F.coalesce(c, F.lit(0.0)) for c in row.columns if c.startswith("accuracy_at_") or c == "mrr"}
    skipped = queries.join(corpus.select("movie_key").distinct(), "movie_key", "left_anti").agg(F.count("*").alias("skipped_missing_target"))
    return row.withColumns(zeros).crossJoin(F.broadcast(skipped))


def clean_queries(queries: DataFrame, n: int, leaked: str = "leaked", order: str = "query_id") -> DataFrame:
    """The first n queries that give nothing away."""
    return queries.where(~F.coalesce(F.col(leaked), F.lit(False))).orderBy(order).limit(n)


def grading_rows(assignments: DataFrame, queries: DataFrame, results: DataFrame, movies: DataFrame, shown: int = 200) -> DataFrame:
    """What every rater fills in: assignments (person_id, query_id, method) with the query's text and the method's results
    (query_id, method, rank, movie_key, movie_name) for it, and the beginning of each movie's overview. Assignments of
    unknown queries give no row, a movie without a name shows its key, the grade is empty."""
    asked = assignments.join(queries.select("query_id", F.col("query").alias("query_text")), "query_id")
    found = asked.join(results.select("query_id", "method", "rank", "movie_key", "movie_name"), ["query_id", "method"])
    about = movies.select(F.col("key").alias("movie_key"), F.substring("overview", 1, shown).alias("movie_overview"))
    rows = found.join(about, "movie_key", "left")
    return rows.select("person_id", "query_id", "query_text", F.col("method").alias("engine"), "rank", "movie_key", F.coalesce("movie_name", "movie_key").alias("movie_title"), F.coalesce("movie_overview", F.lit("")).alias("movie_overview"), F.lit("").alias("relevance_grade"))
