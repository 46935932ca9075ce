"""Retrieval metrics over long tables (query_id, rank, movie_key, ...); one pass, no loop over queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hits(targets: DataFrame, results: DataFrame) -> DataFrame:
    """targets (query_id, movie_key, ...) with `rank`, where the target first stands among the results, or null."""
    hit = results.join(targets.select("query_id", "movie_key"), ["query_id", "movie_key"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return targets.join(hit, "query_id", "left")


def upper_median(counted: Column) -> Column:
    """Of an array of struct(rank, n), sorted by rank: the element at half the length of the list in which each rank stands n
    times; null if it is empty."""
    half = F.floor(F.aggregate(counted, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) / 2)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.when(acc["found"].isNull() & (seen > half), x["rank"].cast("int")).otherwise(acc["found"]).alias("found"))

    return F.aggregate(counted, start, step, lambda acc: acc["found"])


def report(hits: DataFrame, ks: Sequence[int] = (5, 10, 15, 20), digits: int = 3, failed_beyond: int | None = 20) -> DataFrame:
    """One row: total_queries, correct_at_k and accuracy_at_k, mrr, median_rank, failed. Averages of nothing are null.
    failed_beyond=None means the largest k. Queries are counted per rank first, so that the row holds a number for each rank
    and not one for each query."""
    beyond = max(ks) if failed_beyond is None else failed_beyond
    n, rank = F.col("n"), F.col("rank")
    total = F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    count = lambda c: F.coalesce(F.sum(F.when(c, n).otherwise(0)), F.lit(0)).cast("bigint")
    correct = [count(rank <= k) for k in ks]
    some = F.when(total > 0, total)
    return hits.groupBy("rank").agg(F.count("*").alias("n")).agg(
        total.alias("total_queries"),
        *[c.alias(f"correct_at_{k}") for c, k in zip(correct, ks)],
        *[F.round(c / some, 6).alias(f"accuracy_at_{k}") for c, k in zip(correct, ks)],
        F.round(F.sum(F.coalesce(n / rank, F.lit(0.0))) / some, digits).alias("mrr"),
        upper_median(F.array_sort(F.collect_list(F.when(rank.isNotNull(), F.struct(rank, n))))).alias("median_rank"),
        count(rank.isNull() | (rank > beyond)).alias("failed"),
    )


def failed(hits: DataFrame, beyond: int = 20) -> DataFrame:
    return hits.where(F.col("rank").isNull() | (F.col("rank") > beyond))


def _gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + F.lit(1.0))


def ndcg(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ndcg) against all judgments (query_id, movie_key, grade) of the query: what is not judged counts 0, what
    was not retrieved still belongs to the ideal. 0 where the ideal is 0."""
    got = results.where(F.col("rank") <= k).join(judgments, ["query_id", "movie_key"], "left").groupBy("query_id").agg(F.sum(_gain(F.coalesce("grade", F.lit(0.0)), F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "movie_key"))
    ideal = judgments.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("place"))).alias("ideal"))
    return got.join(ideal, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"))


def ndcg_retrieved(graded: DataFrame, k: int = 5, by: Sequence[str] = ("query_id", "engine")) -> DataFrame:
    """(by, ndcg): the ideal is the retrieved list (rank, grade) itself, sorted."""
    lists = graded.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "movie_key", "grade"))).alias("l"))
    dcg = lambda grades: F.aggregate(F.transform(F.slice(grades, 1, k), lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    got = lists.select(*by, F.transform("l", lambda x: x["grade"].cast("double")).alias("g"))
    ideal = dcg(F.sort_array("g", asc=False))
    return got.select(*by, F.when(ideal > 0, dcg(F.col("g")) / ideal).otherwise(F.lit(0.0)).alias("ndcg"))


def mean_grades(annotations: DataFrame) -> DataFrame:
    """annotations (person_id, query_id, engine, rank, movie_key, grade) to (query_id, engine, movie_key, grade, rank):
    the mean over raters and the best rank on record."""
    return annotations.groupBy("query_id", "engine", "movie_key").agg(F.avg("grade").alias("grade"), F.min("rank").alias("rank"))


def engines(annotations: DataFrame, k: int = 5) -> DataFrame:
    """(engine, queries, raters, ndcg) averaged over the queries of each engine."""
    each = ndcg_retrieved(mean_grades(annotations), k)
    people = annotations.groupBy("engine").agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("person_id").alias("raters"))
    return people.join(each.groupBy("engine").agg(F.avg("ndcg").alias("ndcg")), "engine")


def interval_alpha(annotations: DataFrame, by: Sequence[str] = ("engine",), item: Sequence[str] = ("query_id", "movie_key")) -> DataFrame:
    """(by, alpha): Krippendorff's agreement with squared differences. Both disagreements have closed forms, so raters
    are never paired: over the items sum of n * sum(x^2) - sum(x)^2, over all values twice that. NaN without any pair,
    1 where all values are equal."""
    x = F.col("grade").cast("double")
    items = annotations.where("grade IS NOT NULL").groupBy(*by, *item).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    total = items.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("d"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    n = F.col("n")
    expected = F.when(n > 1, 2 * (n * F.col("q") - F.col("s") * F.col("s")) / (n * (n - 1)))
    alpha = F.when(F.col("pairs") == 0, F.lit(float("nan"))).when(expected == 0, F.lit(1.0)).otherwise(1 - F.col("d") / F.col("pairs") / expected)
    return total.select(*by, alpha.alias("alpha"))


def scene_retrieval(results: DataFrame, relevant: DataFrame, ks: Sequence[int] = (5, 10, 20), deepest: int = 20) -> DataFrame:
    """One row over results (query_id, rank, hit) and relevant (query_id, n): accuracy, precision and recall at each k; MRR, NDCG
    and MAP at the deepest."""
    order = Window.partitionBy("query_id").orderBy("rank")
    seen = results.where(F.col("rank") <= deepest).withColumn("hits", F.sum(F.col("hit").cast("int")).over(order))
    on = lambda k: F.sum(F.when(F.col("hit") & (F.col("rank") <= k), 1).otherwise(0))
    each = seen.groupBy("query_id").agg(
        *[on(k).alias(f"h{k}") for k in ks],
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit"), F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    all_ = relevant.where("n > 0").join(each, "query_id", "left").na.fill(0)
    most = F.least(F.col("n"), F.lit(deepest))
    ideal = F.aggregate(F.sequence(F.lit(1), most.cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    r = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return all_.agg(
        *[r((F.col(f"h{k}") > 0).cast("double"), f"accuracy_at_{k}") for k in ks],
        *[r(F.col(f"h{k}") / k, f"precision_at_{k}") for k in ks],
        *[r(F.col(f"h{k}") / F.col("n"), f"recall_at_{k}") for k in ks],
        r(F.when(F.col("first") > 0, F.lit(1.0) / F.col("first")).otherwise(0.0), "mrr"),
        r(F.col("dcg") / ideal, "ndcg"),
        r(F.col("ap") / most, "map"),
    )
