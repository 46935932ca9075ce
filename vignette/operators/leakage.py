"""Lexical leakage of titles into queries, for whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import leakage as L

MIN_TITLE = 3


def forbidden_titles(movies: DataFrame, name: str = "name") -> DataFrame:
    """(title, first, size): distinct titles in lower case that are long enough and no everyday word, keyed by their first
    word."""
    t = movies.select(F.lower(name).alias("title")).where((F.length("title") >= MIN_TITLE) & ~F.col("title").isin(L.EVERYDAY)).distinct()
    words = L.word_tokens(F.col("title"))
    return t.select("title", F.element_at(words, 1).alias("first")).where("first IS NOT NULL")


def other_titles(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, others): the forbidden titles that stand in a query as whole words, its own left out. An equi-join on the
    title's first word finds the candidates, so queries and titles are never crossed; only ids and words take part in it,
    and the text comes back once a query, with the list of its candidates."""
    asked = queries.select("query_id", F.lower("query").alias("q"), F.lower("movie_title").alias("own"))
    word = asked.select("query_id", F.explode(F.array_distinct(L.word_tokens(F.col("q")))).alias("first"))
    near = word.join(titles, "first").groupBy("query_id").agg(F.collect_set("title").alias("near"))
    whole = lambda t: F.contains("q", t) & F.rlike("q", F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b")))
    found = asked.join(near, "query_id").select("query_id", F.array_sort(F.filter("near", lambda t: (t != F.col("own")) & whole(t))).alias("others"))
    return found.where(F.size("others") > 0)


def check(queries: DataFrame, titles: DataFrame, strictness: str = "medium") -> DataFrame:
    """queries (query_id, query, movie_title) with direct, partial, others, leakage_score, has_leakage and reason."""
    threshold = L.THRESHOLDS[strictness]
    q = F.coalesce("query", F.lit(""))
    title = F.coalesce("movie_title", F.lit(""))
    none = F.array().cast("array<string>")
    rows = queries.join(other_titles(queries, titles), "query_id", "left").withColumns({"direct": F.contains(F.lower(q), F.lower(title)), "partial": L.named_in_title(q, title), "others": F.coalesce("others", none)})
    rows = rows.withColumns({"leakage_score": F.round(L.leakage_score(F.col("direct"), F.col("partial"), F.col("others")), 6), "reason": L.leakage_reason(F.col("direct"), F.col("partial"), F.col("others"))})
    return rows.withColumn("has_leakage", F.col("leakage_score") >= threshold)


def report(checked: DataFrame) -> DataFrame:
    """One row: total, flagged, passed and the mean score (0 of nothing)."""
    flagged = F.coalesce(F.sum(F.col("has_leakage").cast("bigint")), F.lit(0))
    return checked.agg(F.count("*").alias("total"), flagged.alias("flagged"), (F.count("*") - flagged).alias("passed"), F.round(F.coalesce(F.avg("leakage_score"), F.lit(0.0)), 6).alias("avg_leakage_score"))
