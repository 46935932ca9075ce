"""The knowledge graph kept in a Store: movies, entities, relations, dropped relations and the builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from . import graph
from .store import Store

TABLES = ("graph_movies", "graph_entities", "graph_relations", "graph_dropped")
BUILDS = "graph_builds"
_BUILT = "number bigint, mode string, requested string, movies bigint, entities bigint, relations bigint, nodes bigint, edges bigint, dropped bigint, dropped_by_reason map<string,bigint>"


class GraphStore:
    """A graph that outlives the session. build() replaces the movies that it is given and leaves the others."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    def build(self, entities: DataFrame, relations: DataFrame, movie_id: str | None = None, rebuild: bool = False) -> DataFrame:
        """The summary row of a build of raw entities (movie_id, name, entity_type) and relations: of all movies, or of one.
        rebuild drops what is there first, and is for all movies only. No entities to build from is an error."""
        if movie_id is not None and rebuild:
            raise ValueError("rebuild is for all movies")
        if movie_id is not None:
            entities, relations = entities.where(F.col("movie_id") == movie_id), relations.where(F.col("movie_id") == movie_id)
        entities = stored(entities, "named")  # every table below is made of them
        if entities.isEmpty():
            raise ValueError("no entities to build from" if movie_id is None else f"no entities of {movie_id}")
        own, kept, dropped = graph.documents(entities, relations)
        made = own, stored(kept, "kept"), dropped  # written and counted
        names = entities.groupBy("movie_id").agg(*[F.min(c).alias(c) for c in ("entity_file", "relation_file") if c in entities.columns], F.lit(1).alias("one"))
        movies = stored(graph.titled(names).select("movie_id", "title", "source_file"), "movies")
        if rebuild:
            self.reset()
        for table, fresh, key in zip(TABLES, (movies, *made), ("movie_id", "entity_id", "relation_id", "movie_id")):
            if self.store.exists(table):  # a movie that lost all its rows loses its old ones too
                old = self.store.get(table).join(movies.select("movie_id"), "movie_id", "left_anti")
                fresh = old.select(*fresh.columns).unionByName(fresh)
            self.store.put(table, fresh, key)
        row = graph.summary(*made).select(F.lit(self._next()).cast("bigint").alias("number"), F.lit("movie" if movie_id else "full").alias("mode"), F.lit(movie_id).cast("string").alias("requested"), "movies", "entities", "relations", "nodes", "edges", "dropped", F.coalesce("dropped_by_reason", F.expr("map()").cast("map<string,bigint>")).alias("dropped_by_reason"))
        told = self.spark.createDataFrame(row.collect(), _BUILT)
        self.store.upsert(BUILDS, told, "number")
        return told

    def _next(self) -> int:
        last = self.last_build()
        return 0 if last is None else last["number"] + 1

    def last_build(self):
        """The summary of the newest build, or None."""
        return self.store.get(BUILDS).orderBy(F.desc("number")).first() if self.store.exists(BUILDS) else None

    def reset(self) -> None:
        """Drops the graph; the record of builds stays."""
        for table in TABLES:
            self.store.reset(table)

    def ready(self) -> bool:
        return all(self.store.exists(t) for t in TABLES)

    def table(self, name: str) -> DataFrame:
        return self.store.get(f"graph_{name}")

    def counts(self) -> DataFrame:
        if not self.ready():
            return self.spark.createDataFrame([(0, 0, 0, 0)], "movies bigint, entities bigint, relations bigint, edges bigint")
        return graph.counts(self.table("entities"), self.table("relations"))

    def health(self) -> dict:
        """status, the counts of the whole graph and the last build."""
        last = self.last_build()
        return {"status": "ready" if self.ready() else "not_ready", "counts": self.counts().first().asDict(), "last_build": last.asDict() if last else None}
