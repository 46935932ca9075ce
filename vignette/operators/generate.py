"""Query generation with an injected model. The model is a callable; what it returns is parsed in the JVM.

ask(kind, fields) takes the kind of the prompt and a dict of its fields and returns the reply's text, or None. It is called on
the executors, once a row, and may fail: a failing call counts as no reply after `tries` calls. Movies go in rounds, so a
round is one job over all movies that still lack queries, and no loop runs over rows on the driver."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repair
from ..functions.leakage import leaks_title, leaks_words, title_words
from ..functions.text import content_key, squeeze, strip, word_count
from ..storage import stored
from .mine import longest_scenes
from .parse import random_scene
from .store import Store

Ask = Callable[[str, dict], str | None]

SYNOPSIS_QUERIES, SYNOPSIS_BATCH = 8, 4


def replies(kind: str, ask: Ask, tries: int = 3, **fields: Column) -> Column:
    """The model's replies, null where every call failed or returned nothing."""
    names = list(fields)

    @F.arrow_udf("string")
    def run(row: pa.Array) -> pa.Array:
        out = []
        for values in row.to_pylist():
            reply = None
            for _ in range(tries):
                try:
                    reply = ask(kind, values)
                except Exception:  # a model's client is somebody else's code
                    continue
                if reply:
                    break
            out.append(reply or None)
        return pa.array(out, pa.string())

    return run(F.struct(*[fields[n].alias(n) for n in names]))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once a row: the optimizer does not copy expressions over an explode(), and so
    does not repeat them wherever the columns are read."""
    made = rows.withColumn("__once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.withColumns({n: F.col("__once")[n] for n in columns}).drop("__once")


def _merged(rows: DataFrame, found: str, told: Column, title: Column, most: int) -> DataFrame:
    """rows with the new strings behind those of the column `found`: those that leak the title or repeat one in content words
    are left out. Replies, title words and keys are computed once a row or string, before they are compared."""
    rows = _once(rows, __told=F.coalesce(told, F.array().cast("array<string>")), __words=title_words(title), __known=F.transform(found, content_key))
    fine = F.filter("__told", lambda q: ~leaks_words(q, F.col("__words")))
    rows = _once(rows, __new=F.filter(F.transform(fine, lambda q: F.struct(content_key(q).alias("k"), q.alias("q"))), lambda x: x["k"] != ""))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(F.array_append(acc["l"], x["q"]).alias("l"), F.array_append(acc["k"], x["k"]).alias("k"))
        return F.when(F.array_contains(acc["k"], x["k"]) | (F.size(acc["l"]) >= most), acc).otherwise(new)

    start = F.struct(F.col(found).alias("l"), F.col("__known").alias("k"))
    return rows.withColumn(found, F.aggregate("__new", start, step, lambda acc: acc["l"])).drop("__told", "__words", "__known", "__new")


def synopsis_queries(movies: DataFrame, ask: Ask, n: int = SYNOPSIS_QUERIES, tries: int = 3) -> DataFrame:
    """(movie_id, movie_title, queries): up to n queries about each movie's overview, asked for in batches, without those that
    repeat or give the title away. A movie without an overview is not asked about and has none."""
    none = F.array().cast("array<string>")
    rows = movies.select("movie_id", "movie_title", F.coalesce("overview", F.lit("")).alias("overview"), none.alias("queries"))
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "movie_id")  # calls go to all cores, however few files there are
    for attempt in range(max(2, -(-n // SYNOPSIS_BATCH) + 1)):
        wants = (strip(F.col("overview")) != "") & (F.size("queries") < n)
        open_ = rows.where(wants)
        if attempt and open_.isEmpty():
            break
        number = F.least(F.lit(SYNOPSIS_BATCH), F.lit(n) - F.size("queries"))
        told = open_.withColumn("reply", replies("synopsis", ask, tries, overview=F.col("overview"), n=number, attempt=F.lit(attempt)))
        told = _merged(told, "queries", repair.string_list(F.col("reply"), "queries"), F.coalesce("movie_title", F.lit("")), n).drop("reply")
        rows = stored(told.unionByName(rows.where(~wants)), "synopsis")
    return rows.select("movie_id", "movie_title", "queries")


def scene_queries(scenes: DataFrame, ask: Ask, n: int = 3, tries: int = 3, key: str = "scene_index") -> DataFrame:
    """(movie_id, movie_title, scene_idx, query): one query for each of a movie's n longest scenes, unless the model skips it
    or gives the title away."""
    picked = longest_scenes(scenes, n, key=key)
    told = picked.select("movie_id", "movie_title", "scene_idx", repair.scene_summary(replies("scene_summary", ask, tries, scene_text=F.col("text"))).alias("query"))
    return stored(told, "summaries").where(F.col("query").isNotNull() & ~leaks_title(F.col("query"), F.coalesce("movie_title", F.lit(""))))


def paraphrases(queries: DataFrame, ask: Ask, n: int = 2, tries: int = 3) -> DataFrame:
    """(query_id, paraphrase, ord) of queries (query_id, query, movie_title)."""
    told = queries.select("query_id", "movie_title", repair.string_list(replies("paraphrase", ask, tries, query=F.col("query"), n=F.lit(n)), "paraphrases").alias("l"))
    flat = stored(told, "paraphrases").select("query_id", "movie_title", F.posexplode("l").alias("ord", "paraphrase"))
    return flat.where(~leaks_title(F.col("paraphrase"), F.coalesce("movie_title", F.lit("")))).select("query_id", "paraphrase", "ord")


def raw_queries(movies: DataFrame, scenes: DataFrame, ask: Ask, done: DataFrame | None = None, n: int = SYNOPSIS_QUERIES, scenes_each: int = 3, key: str = "scene_index") -> DataFrame:
    """(movie_id, movie_title, query, query_type, scene_idx) of all movies that are not done."""
    if done is not None:
        movies, scenes = (df.join(done.select("movie_id").distinct(), "movie_id", "left_anti") for df in (movies, scenes))
    a = synopsis_queries(movies, ask, n).select("movie_id", "movie_title", F.explode("queries").alias("query"), F.lit("synopsis").alias("query_type"), F.lit(None).cast("int").alias("scene_idx"))
    b = scene_queries(scenes, ask, scenes_each, key=key).select("movie_id", "movie_title", "query", F.lit("scene_summary").alias("query_type"), F.col("scene_idx").cast("int"))
    return a.unionByName(b)


def eval_set(movies: DataFrame, trained: DataFrame, ask: Ask, least: int = 10, tries: int = 3) -> DataFrame:
    """(movie_id, movie_title, query): one query for every movie that was not trained on and whose overview has `least`
    words or more."""
    open_ = movies.where(word_count(F.coalesce("overview", F.lit(""))) >= least).join(trained.select("movie_id").distinct(), "movie_id", "left_anti")
    told = synopsis_queries(open_, ask, 1, tries)
    return told.where(F.size("queries") > 0).select("movie_id", "movie_title", F.element_at("queries", 1).alias("query"))


def scene_eval_set(scenes: DataFrame, ask: Ask, done: DataFrame | None = None, seed: int = 1, tries: int = 3) -> DataFrame:
    """(movie_id, movie_title, scene_id, query): one query about a random scene of every movie that is not done; what the
    model skips or what gives the title away is left out, and its movie is asked about again next time."""
    left = scenes if done is None else scenes.join(done.select("movie_id").distinct(), "movie_id", "left_anti")
    one = left.join(random_scene(left, ["movie_id"], seed), ["movie_id", "scene_id"])
    told = one.select("movie_id", "movie_title", "scene_id", squeeze(repair.scene_summary(replies("scene_summary", ask, tries, scene_text=F.col("text")))).alias("query"))
    return stored(told, "summaries").where(F.col("query").isNotNull() & ~leaks_title(F.col("query"), F.coalesce("movie_title", F.lit(""))))


def resumed(todo: DataFrame, step: Callable[[DataFrame], DataFrame], store: Store, name: str, key: str = "movie_id", every: int = 1000) -> int:
    """Runs step over the rows of todo that are not done yet, some `every` of them at a time, and keeps what it returns: each
    batch's rows go into the table `name` and the keys that gave rows into `<name>_done`, so that a run that breaks goes on
    where it stopped and keys without rows are tried again. A batch is a hash bucket of the keys; a batch that is written
    but not noted as done is replaced by its second run. Returns the number of keys done by this call."""
    done = f"{name}_done"
    left = todo.join(store.get(done).select(key), key, "left_anti") if store.exists(done) else todo
    left = stored(left, "todo")
    batches, made = max(1, -(-left.count() // every)), 0
    for b in range(batches):
        rows = stored(step(left.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)), "step")
        if rows.isEmpty():
            continue
        keys = rows.select(key).distinct()
        if store.exists(name):
            store.put(name, store.get(name).join(keys, key, "left_anti").select(*rows.columns).unionByName(rows), key)
        else:
            store.put(name, rows, key)
        store.upsert(done, keys, key)
        made += keys.count()
    return made


def progress(store: Store, name: str, total: int, key: str = "movie_id") -> tuple[int, int, float]:
    """(keys done, keys in all, per cent)."""
    done = store.count(f"{name}_done") if store.exists(f"{name}_done") else 0
    return done, total, 100.0 * done / total if total else 0.0
