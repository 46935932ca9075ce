"""Training pairs: positives from a query's own movie, negatives from other movies; shares, splits and studies."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .nearest import block_top_k

MIN_SIMILARITY = 0.35
GAP = 0.05
RANDOM_NEGATIVES = 3


def best_in_movie(queries: DataFrame, scenes: DataFrame, n: int = 2, query_id: str = "query_id", scene: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, score, rank): the n best scenes of each query's own movie; blocks meet by an equi-join on it."""
    return block_top_k(queries, scenes, n, query_id, corpus_id=scene, same="movie_id").withColumnsRenamed({"corpus_id": scene})


def assign(queries: DataFrame, scenes: DataFrame, minimum: float = MIN_SIMILARITY) -> DataFrame:
    """(query_id, vec_id, score): the best scene of the own movie, null below the minimum or without a scene."""
    top = best_in_movie(queries, scenes, 1).where(F.col("score") >= minimum).select("query_id", "vec_id", "score")
    return queries.select("query_id").join(top, "query_id", "left")


def assign_batch(queries: DataFrame, scenes: DataFrame, minimum: float = MIN_SIMILARITY, gap: float = GAP) -> DataFrame:
    """(query_id, vec_id, score, rank): the best scene if it reaches the minimum, and the second if it is less than the gap
    behind; the second itself has no minimum."""
    two = best_in_movie(queries, scenes, 2)
    lead = F.max("score").over(Window.partitionBy("query_id"))
    return two.withColumn("lead", lead).where((F.col("lead") >= minimum) & ((F.col("rank") == 1) | (F.round(F.col("lead") - F.col("score"), 6) < gap))).drop("lead")


def hard_negatives(queries: DataFrame, scenes: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): the n nearest scenes of other movies."""
    return block_top_k(queries, scenes, n, corpus_id="vec_id", other="movie_id").withColumnsRenamed({"corpus_id": "vec_id"})


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `__i`, their place in the order of columns that tell all rows apart. Ranges are counted side by side; one number a
    range goes to the driver."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(laid.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33).cast("int")
    starts, total = [], 0
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((r["p"], total))
        total += r["n"]
    offset = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __start bigint")
    both = placed.withColumn("__p", part).join(F.broadcast(offset), "__p")
    return both.withColumn("__i", F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__p", "__m", "__start")


def random_negatives(queries: DataFrame, scenes: DataFrame, n: int = RANDOM_NEGATIVES, seed: int = 42) -> DataFrame:
    """(query_id, vec_id): n scenes of other movies, all of them if there are no more. Scenes are numbered movie by movie, so
    the others of a movie are the numbers outside its stretch; a query takes n of them, equal steps apart from a start, both
    by its hash, and meets their scenes by the number. No query meets scenes that it does not draw, however many a movie
    has."""
    laid = stored(numbered(scenes.select("vec_id", F.col("movie_id").alias("of")), "of", "vec_id"), "scenes")
    own = laid.groupBy(F.col("of").alias("movie_id")).agg(F.min("__i").alias("first"), F.count("*").alias("own"))
    asked = queries.select("query_id", "movie_id").join(own, "movie_id", "left").crossJoin(F.broadcast(laid.agg(F.count("*").alias("all"))))
    others = F.col("all") - F.coalesce("own", F.lit(0))
    draw = lambda salt, upto: F.pmod(F.xxhash64(F.lit(seed + salt), "query_id"), upto)
    few = F.least(F.lit(n), others)
    rows = asked.withColumns({"others": others, "few": few}).where("few > 0")
    rows = rows.withColumns({"at": draw(0, F.col("others")), "step": 1 + draw(1, F.greatest(F.lit(1), F.floor(F.col("others") / F.col("few"))))})
    drawn = rows.select("query_id", "first", "own", F.explode(F.transform(F.sequence(F.lit(0), (F.col("few") - 1).cast("int")), lambda j: F.pmod(F.col("at") + j * F.col("step"), F.col("others")))).alias("o"))
    skipped = F.when(F.col("own").isNotNull() & (F.col("o") >= F.col("first")), F.col("o") + F.col("own")).otherwise(F.col("o"))
    return drawn.select("query_id", skipped.alias("__i")).join(laid.select("__i", "vec_id"), "__i").select("query_id", "vec_id")


def longest_scenes(scenes: DataFrame, n: int = 3, by: str = "movie_id", text: str = "text", key: str = "scene_index") -> DataFrame:
    """The n longest scenes of each movie with scene_idx 0..n-1; ties by the scene's place."""
    order = Window.partitionBy(by).orderBy(F.length(text).desc(), key)
    return scenes.withColumn("scene_idx", F.row_number().over(order) - 1).where(F.col("scene_idx") < n)


def assemble(queries: DataFrame, positives: DataFrame, scenes: DataFrame, done: DataFrame | None = None, n: int = RANDOM_NEGATIVES) -> DataFrame:
    """(query_id, movie_id, query_type, positive, negatives): synopsis queries (with q) take their positives from `positives`
    (query_id, vec_id), scene queries the scene of their rank by length; movies in `done` are left out."""
    asked = queries if done is None else queries.join(done.select("movie_id").distinct(), "movie_id", "left_anti")
    a = asked.where("query_type = 'synopsis'").join(positives.select("query_id", F.col("vec_id").alias("positive")), "query_id")
    ranked = longest_scenes(scenes).select("movie_id", "scene_idx", F.col("vec_id").alias("positive"))
    b = asked.where("query_type = 'scene_summary'").join(ranked, ["movie_id", "scene_idx"])
    columns = ["query_id", "movie_id", "query_type", "positive"]
    both = a.select(*columns).unionByName(b.select(*columns))
    drawn = random_negatives(asked, scenes, n).groupBy("query_id").agg(F.array_sort(F.collect_list("vec_id")).alias("negatives"))
    return both.join(drawn, "query_id", "left")


def training_columns(pairs: DataFrame, n: int = RANDOM_NEGATIVES) -> DataFrame:
    """The list of negatives as columns negative_0, negative_1, ..."""
    return pairs.select("*", *[F.get("negatives", F.lit(i)).alias(f"negative_{i}") for i in range(n)]).drop("negatives")


def next_scene_idx(queries: DataFrame, base: int = 100) -> DataFrame:
    """(movie_title, next_idx): the first free index from `base` on."""
    extended: Column = F.max(F.when(F.col("scene_idx") >= base, F.col("scene_idx")))
    return queries.groupBy(F.lower(F.trim("movie_title")).alias("movie_title")).agg((F.coalesce(extended, F.lit(base - 1)) + 1).alias("next_idx"))


def relation_lines(relations: DataFrame, minimum: int = 10, most: int = 20) -> DataFrame:
    """(movie_id, relations, shown) of the movies with enough relations; shown holds the first ones as text, for a prompt."""
    line = F.format_string('  %s --%s--> %s   ("%s")', F.coalesce("from_name", F.lit("?")), F.coalesce("label", F.lit("?")), F.coalesce("to_name", F.lit("?")), F.substring(F.replace(F.trim(F.coalesce("evidence", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, 80))
    order = Window.partitionBy("movie_id").orderBy("ord")
    rows = relations.select("movie_id", "ord", line.alias("line")).withColumn("n", F.row_number().over(order))
    listed = F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "line"))))
    made = rows.groupBy("movie_id").agg(F.count("*").alias("relations"), listed.alias("l")).where(F.col("relations") >= minimum)
    return made.select("movie_id", "relations", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("shown"))


def balanced(rows: DataFrame, workers: int, size: str, key: str) -> DataFrame:
    """rows with `worker`: dealt out in turn, the largest first. The order is global, so only (key, size) is sorted, in
    ranges: a row's place is its place in the range plus the sizes of the ranges before."""
    slim = rows.select(F.col(key), F.col(size).alias("__size")).repartitionByRange(F.desc("__size"), F.col(key)).sortWithinPartitions(F.desc("__size"), F.col(key))
    placed = stored(slim.select(key, "__size", F.spark_partition_id().alias("__part")), "placed")
    starts, total = [], 0  # one number a range
    for r in placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        starts.append((r["__part"], total))
        total += r["n"]
    offset = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __start bigint")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("__size"), F.col(key)))
    worker = placed.join(F.broadcast(offset), "__part").select(key, ((F.col("__start") + inside - 1) % workers).cast("int").alias("worker"))
    return rows.join(worker, key)


def split(rows: DataFrame, held_out: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows for training, held-out rows), told apart by the key."""
    keys = held_out.select(key).distinct()
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def grid(rows: DataFrame, equals: dict | None = None, contains: dict | None = None, fuzzy: dict | None = None, order: list | None = None, page: int = 0, size: int = 10, case_sensitive: bool = False, distance: int = 2) -> DataFrame:
    """A page of a filtered and sorted table. contains looks for parts of strings, fuzzy allows `distance` edits."""
    for name, value in (equals or {}).items():
        rows = rows.where(F.col(name) == value)
    for name, value in (contains or {}).items():
        rows = rows.where(F.contains(F.col(name), F.lit(value)) if case_sensitive else F.contains(F.lower(name), F.lit(value.lower())))
    for name, value in (fuzzy or {}).items():
        rows = rows.where(F.levenshtein(F.lower(name), F.lit(value.lower()), distance) >= 0)
    return rows.orderBy(*(order or rows.columns)).offset(page * size).limit(size)


def assignments(queries: list[str], methods: list[str], people: int, each: int, seed: int = 42) -> list[tuple[str, str, str]]:
    """(person, query, method) of a rating study: every pair of a query and a method goes to two people, nobody sees a
    query twice, and everybody gets the methods in equal shares where that is possible. A sequential choice over a few
    hundred pairs, made on the driver."""
    rng = random.Random(seed)
    quota = each // len(methods)
    chosen = queries[: min(len(queries), people * quota // 2)]
    left = [(q, m) for m in methods for q in chosen for _ in range(2)]
    rng.shuffle(left)
    out = []
    for i in range(people):
        mine_: list[tuple[str, str]] = []
        for strict in (True, False):
            keep = []
            for q, m in left:
                fits = len(mine_) < each and all(q != x for x, _ in mine_) and (not strict or sum(y == m for _, y in mine_) < quota)
                (mine_ if fits else keep).append((q, m))
            left = keep
        rng.shuffle(mine_)
        out += [(f"P{i + 1:02d}", q, m) for q, m in mine_]
    return out


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """Chunks joined with their vectors by key; one without a vector fails the query."""
    both = chunks.join(vectors.select(*key, vector), key, "left")
    return both.withColumn(vector, F.when(F.col(vector).isNotNull(), F.col(vector)).otherwise(F.raise_error(F.lit("a chunk has no vector"))))
