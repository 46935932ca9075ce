"""Path patterns compiled to a plan: one equi-join a predicate, filters on every input, payload after the limit."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import ENTITY_TYPES, PREDICATES


def _words(values: list[str] | None, known: list[str] | None, what: str) -> list[str]:
    found = [v.strip().upper() if known else v.strip() for v in values or [] if v and v.strip()]
    if known and (odd := [v for v in found if v not in known]):
        raise ValueError(f"unknown {what}: {', '.join(odd)}")
    return found


@dataclass(frozen=True)
class Pattern:
    """A chain of predicates inside one movie. entity_types holds for every node, contains_entities for one at least."""

    predicates: list[str]
    entity_types: list[str] | None = None
    movie_ids: list[str] | None = None
    contains_entities: list[str] | None = None
    limit: int = 10
    distinct_edges: bool = False
    words: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        chain = _words(self.predicates, PREDICATES, "predicates")
        if not chain:
            raise ValueError("a pattern needs a predicate")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be in 1..100")
        self.words.update(predicates=chain, types=_words(self.entity_types, ENTITY_TYPES, "entity types"), movies=_words(self.movie_ids, None, ""), names=_words(self.contains_entities, None, ""))


def compile_pattern(pattern: Pattern, relations: DataFrame, top: bool = True) -> DataFrame:
    """(movie_id, score, path, evidences): score = predicates + distinct nodes / 100; ordered by score, movie and the
    path's ids, then cut to the limit (top=False leaves all matches)."""
    w = pattern.words
    edges = relations.select("movie_id", "relation_id", "from_id", "to_id", "from_name", "to_name", "from_type", "to_type", "predicate")
    if w["movies"]:
        edges = edges.where(F.col("movie_id").isin(w["movies"]))
    if w["types"]:
        edges = edges.where(F.col("from_type").isin(w["types"]) & F.col("to_type").isin(w["types"]))
    found = None
    for i, predicate in enumerate(w["predicates"]):
        step = edges.where(F.col("predicate") == predicate).select("movie_id", F.col("from_id").alias(f"n{i}"), F.col("to_id").alias(f"n{i + 1}"), F.col("relation_id").alias(f"r{i}"), F.col("from_name").alias(f"a{i}"), F.col("to_name").alias(f"b{i}"))
        found = step if found is None else found.join(step, ["movie_id", f"n{i}"])
    k = len(w["predicates"])
    if pattern.distinct_edges and k > 1:
        found = found.where(F.size(F.array_distinct(F.array(*[f"r{i}" for i in range(k)]))) == k)
    if w["names"]:
        found = found.where(reduce(lambda a, b: a | b, [F.col("a0").isin(w["names"]), *[F.col(f"b{i}").isin(w["names"]) for i in range(k)]]))
    nodes = F.array(*[f"n{i}" for i in range(k + 1)])
    found = found.select("movie_id", F.round(F.lit(float(k)) + F.size(F.array_distinct(nodes)) / F.lit(100.0), 6).alias("score"), nodes.alias("nodes"), F.array(*[f"r{i}" for i in range(k)]).alias("rels"))
    if top:
        found = found.orderBy(F.desc("score"), "movie_id", F.array_join("nodes", " "), F.array_join("rels", " ")).limit(pattern.limit)
    return found


def with_details(matches: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Matches with path and evidences as nested rows; joined after the limit, so a few rows meet each table."""
    n = matches.withColumn("m", F.monotonically_increasing_id())
    steps = n.select("m", "movie_id", F.posexplode("nodes").alias("p", "entity_id")).join(entities, ["movie_id", "entity_id"])
    path = steps.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "entity_id", F.col("canonical_name").alias("entity_name"), "entity_type"))), lambda x: x.dropFields("p")).alias("path"))
    proofs = n.select("m", "movie_id", F.posexplode("rels").alias("p", "relation_id")).join(relations.select("movie_id", "relation_id", "predicate", "evidence"), ["movie_id", "relation_id"])
    proof = proofs.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "relation_id", "predicate", "evidence"))), lambda x: x.dropFields("p")).alias("evidences"))
    return n.join(path, "m").join(proof, "m").select("movie_id", "score", "path", "evidences")
