"""The engine as one object: the verbs of the online service over tables, answers as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .hooks import Encoder, Translation, translate
from .operators import fuse, graph, search
from .operators.graph_store import GraphStore
from .operators.store import Store
from .plans.pattern import Pattern, compile_pattern, with_details


class Unavailable(RuntimeError):
    """A part that the request needs is not loaded."""


@dataclass
class Engine:
    """scenes and sentences serve searches, entities and relations graph queries; either side may be missing, and hybrid
    queries then use the other one."""

    spark: SparkSession
    scenes: DataFrame | None = None
    sentences: DataFrame | None = None
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    encoder: Encoder | None = None
    translator: Callable[[str, int], str] | None = None
    settings: Settings = Settings()
    graph_store: GraphStore | None = None

    def health(self) -> dict[str, bool]:
        return {"vectors": self.scenes is not None and self.sentences is not None, "graph": self.entities is not None and self.relations is not None, "encoder": self.encoder is not None}

    def ready(self) -> bool:
        return any(self.health()[k] for k in ("vectors", "graph"))

    def _vector(self, question: str | list[float]) -> list[float]:
        if not isinstance(question, str):
            return list(question)
        if not question.strip():
            raise ValueError("the query is blank")
        if self.encoder is None:
            raise Unavailable("no encoder is set")
        return [float(x) for x in self.encoder([question])[0]]

    def _levels(self) -> tuple[DataFrame, DataFrame]:
        if self.scenes is None or self.sentences is None:
            raise Unavailable("no vectors are loaded")
        return self.scenes, self.sentences

    def _limits(self, top_k: int | None, pool: int | None) -> tuple[int, int]:
        s = self.settings
        return search.limits(s.top_k if top_k is None else top_k, s.pool if pool is None else pool, s.most_top_k, s.most_pool)

    def search_scenes(self, question: str | list[float], top_k: int | None = None, pool: int | None = None) -> DataFrame:
        """(movie_id, scene_id, scene_index, score, rank)."""
        k, p = self._limits(top_k, pool)
        return search.hierarchical_one(*self._levels(), self._vector(question), k, p)

    def search(self, question: str | list[float], top_k: int | None = None, pool: int | None = None) -> DataFrame:
        """(movie_id, best_scene, score, rank): movies by their best scene, from three times as many scenes."""
        k, p = self._limits(top_k, pool)
        hits = search.hierarchical_one(*self._levels(), self._vector(question), k * self.settings.overfetch, p)
        return search.movies(hits.withColumn("query_id", F.lit(0)), k).drop("query_id")

    def pattern(self, request: Pattern) -> DataFrame:
        """(movie_id, score, path, evidences)."""
        if self.entities is None or self.relations is None:
            raise Unavailable("no graph is loaded")
        return with_details(compile_pattern(request, self.relations), self.entities, self.relations)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **parts) -> Engine:
        """An engine over what a store holds; levels and graph that are not there are left out, and answers degrade."""
        store = Store(spark, folder)
        kept = GraphStore(spark, store)
        levels = {n: store.get(n) for n in ("scenes", "sentences") if store.exists(n)}
        tables = {n: kept.table(n) for n in ("entities", "relations")} if kept.ready() else {}
        return cls(spark, **{**levels, **tables, "graph_store": kept, **parts})

    def build_graph(self, entities: DataFrame, relations: DataFrame, movie_id: str | None = None, rebuild: bool = False) -> DataFrame:
        """Builds the stored graph, or one movie of it, and serves it from then on; the summary row."""
        if self.graph_store is None:
            raise Unavailable("no store is set")
        told = self.graph_store.build(entities, relations, movie_id, rebuild)
        self.entities, self.relations = self.graph_store.table("entities"), self.graph_store.table("relations")
        return told

    def graph_health(self) -> dict:
        """status, counts, last_build; not_ready without a store or a build."""
        if self.graph_store is None:
            ready = self.entities is not None and self.relations is not None
            return {"status": "ready" if ready else "not_ready", "counts": graph.counts(self.entities, self.relations).first().asDict() if ready else None, "last_build": None}
        return self.graph_store.health()

    def movie(self, movie_id: str, limit: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self.entities is None or self.relations is None:
            raise Unavailable("no graph is loaded")
        return graph.movie_details(self.entities, self.relations, movie_id, limit)

    def query(self, question: str, vector: list[float] | None = None, top_k: int | None = None, graph_limit: int | None = None) -> tuple[DataFrame, Translation, str]:
        """(movies by fused score, the translation, the strategy: hybrid, semantic_only, graph_only or no_results)."""
        k, _ = self._limits(top_k, None)
        told = translate(question, graph_limit or k, self.translator)
        s = g = None
        if self.health()["vectors"] and (vector is not None or self.encoder is not None):
            s = self.search(vector if vector is not None else question, k).select(F.lit(0).alias("query_id"), "movie_id", "score")
        if told.pattern is not None and self.health()["graph"]:
            g = compile_pattern(told.pattern, self.relations).select(F.lit(0).alias("query_id"), "movie_id", "score", F.monotonically_increasing_id().alias("ord"))
        if s is None and g is None:
            raise Unavailable("neither vectors nor a graph can answer")
        s = self.spark.createDataFrame([], "query_id int, movie_id string, score double") if s is None else s
        g = self.spark.createDataFrame([], "query_id int, movie_id string, score double, ord bigint") if g is None else g
        have_s, have_g = not s.isEmpty(), not g.isEmpty()
        strategy = "hybrid" if have_s and have_g else "semantic_only" if have_s else "graph_only" if have_g else "no_results"
        return fuse.merge_hits(s, g, k).drop("query_id"), told, strategy
