"""One key per movie: aliases of titles and file names, conflicts settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key

ARTICLES = ("the", "a", "an")


def aliases(movies: DataFrame) -> DataFrame:
    """movies (key, name, title, file_name) to distinct (alias, key): the key, both titles, these without a trailing and
    with a leading article, and the file name."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    cut = lambda c: F.trim(F.regexp_replace(blank(c), r"(?i),?\s+(the|a|an)$", ""))
    made = [F.col("key"), *[alnum_key(blank(c)) for c in ("name", "title", "file_name")], *[alnum_key(cut(c)) for c in ("name", "title")]]
    made += [alnum_key(F.concat(F.lit(f"{a} "), blank(c))) for a in ARTICLES for c in ("name", "title")]
    # dealt out first: an aggregate of strings sorts all aliases of a task, and a table in one file would be one task
    dealt = movies.repartition(int(movies.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    return dealt.select("key", F.explode(F.array_distinct(F.array(*made))).alias("alias")).where("alias <> ''").select("alias", "key")


def build(movies: DataFrame) -> DataFrame:
    """(alias, key, conflict): an alias of several movies means the one whose key it is, else the one with the shortest
    key, then the first by name."""
    best = F.min_by(F.struct("key"), F.struct((F.col("key") != F.col("alias")).alias("x"), F.length("key").alias("n"), F.col("key").alias("k")))
    return aliases(movies).groupBy("alias").agg(best.alias("b"), (F.count("*") > 1).alias("conflict")).select("alias", "b.key", "conflict")


def normalized(rows: DataFrame, lookup: DataFrame, column: str = "title") -> DataFrame:
    """rows with movie_key, null where no alias fits."""
    return rows.withColumn("alias", alnum_key(F.col(column))).join(lookup.select("alias", F.col("key").alias("movie_key")), "alias", "left").drop("alias")


def id_from_title(rows: DataFrame, movies: DataFrame, column: str = "title") -> DataFrame:
    """rows with movie_id: the movie whose name agrees in letters and digits, else one made of the title itself."""
    known = movies.groupBy(alnum_key(F.col("name")).alias("n")).agg(F.min("key").alias("found"))
    made = F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9_]", "_"), "^_+|_+$", "")
    return rows.withColumn("n", alnum_key(F.col(column))).join(known, "n", "left").withColumn("movie_id", F.coalesce("found", made)).drop("n", "found")


def relations_files(rows: DataFrame, listing: DataFrame, column: str = "title") -> DataFrame:
    """rows with relations_file: the listed <title>_relations.json (path) that agrees with the title in letters and digits,
    null if there is none; of several the first."""
    known = discovered_movies(listing).groupBy(alnum_key(F.col("title")).alias("n")).agg(F.min("path").alias("relations_file"))
    return rows.withColumn("n", alnum_key(F.col(column))).join(known, "n", "left").drop("n")


def discovered_movies(listing: DataFrame) -> DataFrame:
    """(title, path) of the relation files in a listing (path); dashes in a name are spaces in the title."""
    name = F.regexp_extract("path", r"([^/]*)_relations\.json$", 1)
    return listing.where(F.col("path").endswith("_relations.json")).select(F.replace(name, F.lit("-"), F.lit(" ")).alias("title"), "path")
