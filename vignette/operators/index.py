"""Approximate layouts: inverted lists around k-means centroids, and 8-bit scalar quantisation with rescoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, unit
from ..storage import stored
from .nearest import DIGITS, block_top_k

FIT = 50_000  # rows, by the hash of their id, that the centroids are fitted on; all rows are placed
SAMPLE = 512  # queries whose exact neighbours choose the number of probes
TARGET = 0.95  # part of these neighbours that must lie in the probed lists


def ivf(vectors: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows (id, v, list), centroids (list, c)). Written partitioned by `list`, a search prunes to its probes."""
    rows = stored(vectors.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL").withColumn("f", array_to_vector("v")), "vectors")
    few = stored(rows.orderBy(F.xxhash64("id"), "id").limit(FIT).select("f"), "fit")
    fitted = KMeans(k=lists, seed=seed, featuresCol="f", predictionCol="list", maxIter=10, distanceMeasure="euclidean").fit(few)
    placed = stored(fitted.transform(rows).select("id", "v", "list"), "lists")
    centroids = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())], "list int, c array<double>")
    return placed, centroids


def _nearest_lists(queries: DataFrame, centroids: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, q, list, n): the first `probes` lists, or all, at their places n in the query's order of probing."""
    told = sorted((r["list"], r["c"]) for r in centroids.collect())
    lists, c = np.array([x for x, _ in told], np.int32), np.array([x for _, x in told])
    most = len(lists) if probes is None else min(probes, len(lists))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) @ c.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :most]
            row = pa.array(np.repeat(np.arange(batch.num_rows), most))
            place = np.tile(np.arange(1, most + 1, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(lists[order].ravel()), pa.array(place)], ["query_id", "q", "list", "n"])

    rows = queries.where("q IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    return rows.mapInArrow(run, "query_id bigint, q array<double>, list int, n int")


def probes_needed(built: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, target: float = TARGET) -> int:
    """The smallest number of probes, up to all lists, that catches `target` of the exact neighbours of a sample of the
    queries. Neighbours of score 1, such as the query itself, are hits of any layout and do not count. Ids are numbers."""
    placed, centroids = built
    hashed = queries.select("query_id", unit(F.col("q")).alias("q"), F.xxhash64("query_id").alias("hash"))
    rows = hashed.orderBy("hash", "query_id").limit(SAMPLE).select("query_id", "q").collect()
    sample = placed.sparkSession.createDataFrame(rows, hashed.select("query_id", "q").schema)
    near = block_top_k(sample, placed, k, corpus_id="id", vector="v").where("score < 1").selectExpr("query_id", "corpus_id AS id")
    wanted = near.join(placed.select("id", "list"), "id").join(_nearest_lists(sample, centroids).drop("q"), ["query_id", "list"])
    caught = sorted((r["n"], r["count"]) for r in wanted.groupBy("n").count().collect())
    total, seen = sum(c for _, c in caught), 0
    for n, c in caught:
        seen += c
        if seen >= target * total:
            return n
    return 1


def ivf_search(built: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, id, score, rank). Queries meet the centroids, of which there are few, then blocks of queries meet the blocks
    of their lists by an equi-join on the list number: no theta join with the corpus."""
    placed, centroids = built
    q = queries.select("query_id", unit(F.col("q")).alias("q"))
    chosen = _nearest_lists(q, centroids, probes).select("query_id", "q", "list")
    return block_top_k(chosen, placed, k, corpus_id="id", vector="v", same="list").select("query_id", F.col("corpus_id").alias("id"), "score", "rank")


def int8_bound(vectors: DataFrame, quantile: float = 0.99, vector: str = "embedding") -> float:
    """The absolute value that `quantile` of all components of the unit vectors keep within."""
    parts = vectors.select(F.explode(unit(F.col(vector))).alias("x"))
    return float(parts.agg(F.percentile_approx(F.abs("x"), quantile, 10_000).alias("b")).first()["b"] or 1.0)


def quantised(vector, bound: float):
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * (127.0 / bound)))).cast("tinyint"))


def int8_search(vectors: DataFrame, bound: float, query: Sequence[float], k: int, rescore: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by exact cosine among the k * rescore nearest by quantised dot product."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    coarse = dot(quantised(unit(F.col(vector)), bound), quantised(wanted, max(map(abs, query)) or 1.0))
    some = vectors.withColumn("coarse", coarse).orderBy(F.desc("coarse"), id_col).limit(k * rescore)
    return some.select(id_col, F.round(cosine(F.col(vector), wanted), DIGITS).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
