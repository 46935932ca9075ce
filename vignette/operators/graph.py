"""Entities and relations of a movie: cleaning, normalisation with reasons for what is dropped, counts and details."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.text import strip_fences
from ..functions.vocabulary import ENTITY_TYPES, NOT_REFLEXIVE, PREDICATES
from ..storage import stored

# --- rule-based cleaning of extracted entities -----------------------------------------------------------------------

_TIMES = "AFTERNOON CONTINUOUS DAWN DAY DUSK EVENING FLASH FLASHBACK LATER MORNING NIGHT".split()
_DIRECTIONS = "ANGLE CAMERA CLOSE CUT FADE POV PULL PUSH RACK SMASH VOICE WIDE".split()
_HEADING_TIMES = "|".join("AFTERNOON CONTINUOUS DAWN DAY DUSK EVENING LATER MORNING NIGHT".split())


def clean_name(name: Column) -> Column:
    """One line, no parentheticals, no screenplay notes, no trailing dash or possessive."""
    s = text.squeeze(name)
    s = text.strip(F.regexp_replace(s, r"(?U)\s*\([^)]*\)\s*", " "))
    s = F.regexp_replace(s, r"(?iU)\b(?:CONT'?D|INTERCUT|O\.S\.?|PRELAP|PRE-LAP|V\.O\.?|VISUALS)\b", "")
    s = F.btrim(s, F.lit(" .()"))
    s = text.strip(F.regexp_replace(s, "[-\u2013\u2014]+$", ""))
    return text.strip(F.regexp_replace(s, "(?i)['\u2019]s?$", ""))


def is_noise(name: Column) -> Column:
    upper = F.upper(name)
    return (
        (F.length(name) <= 1)
        | name.rlike(r"(?U)^\d")
        | upper.rlike(rf"(?U)^[A-Z\s'\-]+\s+-\s+(?:{_HEADING_TIMES})$")
        | name.rlike(r"(?iU)^(?:INT|EXT|I/E|E/I)(?:[./\s]|$)")
        | upper.isin(*_TIMES, "THE", "A", "AN", *_DIRECTIONS)
        | ((name == F.lower(name)) & (name != upper) & ~name.contains(" "))
        | name.contains('"')
        | name.contains("\\")
        | name.rlike(r"(?iU)^(\w+)-\1-")
        | name.rlike(r"(?iU)\b(?:a|an|and|at|by|for|in|of|on|or|the|to|with)$")
    )


#: A word in small letters, with or without a mark behind it: cleaned it is itself, the mark or nothing, all of which is noise.
SMALL_WORD = r"^\p{Ll}*[a-z]\p{Ll}*[.,;:!?]?$"


def clean_entities(entities: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """(by, text, label, order): known labels, cleaned names, no noise; of names that differ in case only the first,
    or the first not in capitals if that one is, in the first one's place."""
    # explode() keeps the optimizer from pushing the filters below the cleaning, which would repeat it in every predicate
    able = entities.where(F.col("label").isin(ENTITY_TYPES) & ~F.col("text").rlike(SMALL_WORD))  # most words of a text need no cleaning
    rows = able.select(*by, "label", order, F.explode(F.array(clean_name(F.col("text")))).alias("text"))
    rows = rows.where((F.col("text") != "") & ~is_noise(F.col("text"))).withColumn("__key", F.lower("text"))
    shouted = (F.col("text") == F.upper("text")) & (F.col("text") != F.lower("text"))
    one = rows.groupBy(*by, "__key").agg(F.min_by(F.struct("text", "label"), F.struct(shouted, order)).alias("e"), F.min(order).alias(order))
    return one.select(*by, "e.text", "e.label", order)


def first_relations(relations: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """The first relation of every (from, label, to)."""
    first = Window.partitionBy(*by, "from_name", "label", "to_name").orderBy(order)
    return relations.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def valid_relations(relations: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """What an extractor returned, as far as it keeps to the rules: a known predicate, a person who acts, known names."""
    names = entities.select(*by, F.col("text").alias("name")).distinct()
    rows = relations.where(F.col("label").isin(PREDICATES) & (F.col("from_type") == "PERSON"))
    for side in ("from_name", "to_name"):
        rows = rows.join(names.withColumnRenamed("name", side), [*by, side], "left_semi")
    return rows.select(*relations.columns)


def coverage(scripts: DataFrame, entity_files: DataFrame, key: str = "movie_id") -> DataFrame:
    """(key, state): scripts without entities are missing, entities without a script are extra."""
    a, b = scripts.select(key).distinct(), entity_files.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("extra")))


# --- normalisation ---------------------------------------------------------------------------------------------------


def normalize_entities(raw: DataFrame) -> DataFrame:
    """raw (movie_id, name, entity_type) to (movie_id, entity_id, canonical_name, entity_type), one per id."""
    rows = raw.select("movie_id", text.squeeze(F.coalesce("name", F.lit(""))).alias("canonical_name"), F.upper(text.squeeze(F.coalesce("entity_type", F.lit("")))).alias("entity_type"))
    rows = rows.where(~text.is_noise_squeezed(F.col("canonical_name")) & F.col("entity_type").isin(ENTITY_TYPES))
    rows = rows.withColumn("entity_id", ids.entity_id(F.col("movie_id"), F.col("entity_type"), F.col("canonical_name")))
    return rows.groupBy("movie_id", "entity_id").agg(F.min("canonical_name").alias("canonical_name"), F.first("entity_type").alias("entity_type"))


def name_index(entities: DataFrame) -> DataFrame:
    """(movie_id, canonical_name, entity_id, entity_type): a name that several types share means the last type."""
    best = F.max_by(F.struct("entity_id", "entity_type"), F.struct("entity_type", "entity_id")).alias("e")
    return entities.groupBy("movie_id", "canonical_name").agg(best).select("movie_id", "canonical_name", "e.entity_id", "e.entity_type")


def judged_relations(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """raw (movie_id, from_name, from_type, to_name, to_type, label, evidence) with its resolved ends and the first
    reason to drop it, null if it stays."""
    tidy = lambda c: text.squeeze(F.coalesce(F.col(c), F.lit("")))
    malformed = F.col("from_name").isNull() & F.col("to_name").isNull() & F.col("label").isNull() & F.col("evidence").isNull()
    rows = raw.withColumns({"__malformed": malformed, "__from": tidy("from_name"), "__to": tidy("to_name"), "evidence": tidy("evidence"), "predicate": F.upper(tidy("label")), "__ft": F.upper(tidy("from_type")), "__tt": F.upper(tidy("to_type"))})
    known = name_index(entities)
    for side in ("from", "to"):
        end = known.select("movie_id", F.col("canonical_name").alias(f"__{side}"), F.col("entity_id").alias(f"{side}_id"), F.col("entity_type").alias(f"{side}_entity_type"))
        rows = rows.join(end, ["movie_id", f"__{side}"], "left")
    reason = (
        F.when(F.col("__malformed"), "malformed_relation")
        .when(text.is_noise_squeezed(F.col("__from")) | text.is_noise_squeezed(F.col("__to")), "blank_entity_name")
        .when(F.col("evidence") == "", "empty_evidence")
        .when(~F.col("predicate").isin(PREDICATES), "invalid_predicate")
        .when(~F.col("__ft").isin(ENTITY_TYPES) | ~F.col("__tt").isin(ENTITY_TYPES), "invalid_entity_type")
        .when(F.col("from_id").isNull(), "missing_from_entity")
        .when(F.col("to_id").isNull(), "missing_to_entity")
        .when((F.col("__from") == F.col("__to")) & F.col("predicate").isin(NOT_REFLEXIVE), "self_relation")
    )
    return rows.withColumn("reason", reason).withColumnsRenamed({"__from": "from_canonical", "__to": "to_canonical"}).drop("__malformed", "__ft", "__tt")


def split_judged(rows: DataFrame, raw_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept relations, one per relation_id; dropped relations with their reason) of judged_relations()."""
    dropped = rows.where("reason IS NOT NULL").select(*raw_columns, "reason")
    made = ids.relation_id(F.col("movie_id"), F.col("from_id"), F.col("predicate"), F.col("to_id"), F.col("evidence"))
    kept = rows.where("reason IS NULL").select("movie_id", made.alias("relation_id"), "from_id", F.col("from_canonical").alias("from_name"), F.col("from_entity_type").alias("from_type"), "to_id", F.col("to_canonical").alias("to_name"), F.col("to_entity_type").alias("to_type"), "predicate", "evidence")
    return kept.dropDuplicates(["relation_id"]), dropped


def normalize_relations(raw: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept relations, one per relation_id; dropped relations with their reason)."""
    return split_judged(judged_relations(raw, entities), raw.columns)


def documents(raw_entities: DataFrame, raw_relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, kept relations, dropped relations) of raw ones. Entities and judged relations are stored, as all three
    results and every step of a path read them."""
    entities = stored(normalize_entities(raw_entities), "entities")
    kept, dropped = split_judged(stored(judged_relations(raw_relations, entities), "judged"), raw_relations.columns)
    return entities, kept, dropped


def filtered_entities(entities: DataFrame, choose: Callable[[list[dict]], list[dict]] | None, by: str = "movie_id", order: str = "ord") -> DataFrame:
    """(by, text, label, order): what a model leaves of a movie's entities. choose takes a movie's entities ({text, label}, in
    order) and returns those that stay, corrected ones too; without it, or where it fails, the movie's entities stay as
    they are. A movie's entities are one call, so they meet in one task."""
    rows = entities.select(by, "text", "label", F.col(order).cast("bigint").alias(order))
    if choose is None:
        return rows

    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(order), F.lit(2**63 - 1)).alias("at"), "text", "label", order))).alias("listed")
    one = rows.groupBy(by).agg(listed)
    kept = F.transform("listed", lambda x: F.struct(x["text"], x["label"], x[order]))

    @F.arrow_udf("array<struct<text:string,label:string,ord:bigint>>")
    def ask(listed: pa.Array) -> pa.Array:
        out = []
        for entities in listed.to_pylist():
            try:
                told = choose([{"text": e["text"], "label": e["label"]} for e in entities])
                made = [(e["text"], e["label"], i) for i, e in enumerate(told)]
                pa.array([x for e in made for x in e[:2]], pa.string())  # what is no text is no answer
                out.append([{"text": t, "label": n, "ord": i} for t, n, i in made])
            except Exception:  # a filter is somebody else's code
                out.append(None)
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("ord", pa.int64())])))

    return one.select(by, ask("listed").alias("told"), kept.alias("kept")).select(by, F.explode(F.coalesce("told", "kept")).alias("e")).select(by, "e.text", "e.label", F.col("e.ord").alias(order))


def extracted_relations(texts: DataFrame, entities: DataFrame, extract: Callable[[str, list[str]], str], by: str = "movie_id", text: str = "text") -> DataFrame:
    """(by, from_name, from_type, to_name, to_type, label, evidence, ord): what a model reads from the texts (by, text), as far
    as it keeps to the rules of valid_relations(). extract takes a text and the movie's names and returns JSON, an object
    with `relations` or a list; a reply that is no JSON, or a call that fails, gives no relation."""
    names = entities.groupBy(by).agg(F.array_sort(F.collect_set("text")).alias("names"))
    asked = texts.select(by, F.col(text).alias("text")).join(names, by)

    @F.arrow_udf("string")
    def ask(text: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for t, n in zip(text.to_pylist(), names.to_pylist()):
            try:
                out.append(extract(t, n))
            except Exception:  # an extractor is somebody else's code
                out.append(None)
        return pa.array(out, pa.string())

    one = "struct<from:string,from_type:string,to:string,to_type:string,label:string,evidence:string>"
    reply = strip_fences(F.col("reply"))
    told = asked.select(by, ask("text", "names").alias("reply")).select(by, F.coalesce(F.from_json(reply, f"struct<relations:array<{one}>>")["relations"], F.from_json(reply, f"array<{one}>")).alias("l"))
    flat = told.select(by, F.posexplode("l").alias("ord", "r")).where("r.label IS NOT NULL")
    rows = flat.select(by, F.col("r.from").alias("from_name"), "r.from_type", F.col("r.to").alias("to_name"), "r.to_type", "r.label", "r.evidence", "ord")
    return valid_relations(rows, entities, [by])


def titled(movies: DataFrame, key: str = "movie_id") -> DataFrame:
    """movies with source_file and title. The file is the one that the entities name, else the relations (columns
    entity_file and relation_file, as far as there are any), else <key>.txt; the title is its stem with spaces for dashes."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)) if c in movies.columns else F.lit(None).cast("string")
    rows = movies.withColumn("source_file", F.coalesce(blank("entity_file"), blank("relation_file"), F.concat(F.col(key), F.lit(".txt"))))
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    return rows.withColumn("title", F.replace(stem, F.lit("-"), F.lit(" ")))


# --- the graph as two tables -----------------------------------------------------------------------------------------


def counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: movies, entities, relations, and edges with the movies' own edges to their entities."""
    e = entities.agg(F.countDistinct("movie_id").alias("movies"), F.count("*").alias("entities"))
    return e.crossJoin(relations.agg(F.count("*").alias("relations"))).withColumn("edges", F.col("entities") + F.col("relations"))


def summary(entities: DataFrame, relations: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per build: nodes, edges, and the histogram of drop reasons in the order of their names."""
    histogram = dropped.groupBy("reason").count().agg(F.array_sort(F.collect_list(F.struct("reason", "count"))).alias("h"))
    c = counts(entities, relations)
    return c.crossJoin(histogram).select("movies", "entities", "relations", (F.col("movies") + F.col("entities")).alias("nodes"), "edges", F.coalesce(F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + x["count"]), F.lit(0)).alias("dropped"), F.map_from_entries("h").alias("dropped_by_reason"))


def movie_details(entities: DataFrame, relations: DataFrame, movie_id: str, limit: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, outgoing, incoming) of a movie; an unknown id is an error. Both lists hold all its relations, sorted
    by (from, predicate, to) and (to, predicate, from), then cut."""
    own = entities.where(F.col("movie_id") == movie_id)
    if own.isEmpty():
        raise KeyError(movie_id)
    mine = relations.where(F.col("movie_id") == movie_id)
    return own.orderBy("entity_type", "canonical_name"), mine.orderBy("from_name", "predicate", "to_name", "relation_id").limit(limit), mine.orderBy("to_name", "predicate", "from_name", "relation_id").limit(limit)


def replace_movies(graph: DataFrame, fresh: DataFrame, key: str = "movie_id") -> DataFrame:
    """The table with all rows of the fresh movies replaced by theirs."""
    return graph.join(fresh.select(key).distinct(), key, "left_anti").select(*graph.columns).unionByName(fresh.select(*graph.columns))
