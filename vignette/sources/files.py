"""Readers and writers of the file formats that the engine exchanges. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alnum_key, strip, word_count
from ..operators import parse

SPLITS = 32  # of whole files that a task reads at most
LINE_QUERY = "movie_id string, movie_title string, query string, query_type string, scene_idx int"
FLAT_EVAL = "array<struct<query:string,movie_id:string,movie_title:string,movie_name:string,validation:struct<has_leakage:boolean>>>"
META = "map<string,struct<file:struct<name:string,file_name:string,source:string>,tmdb:struct<title:string,overview:string,id:bigint,release_date:string>,parsed:struct<tagged:string>>>"
ENTITIES = "array<struct<text:string,label:string>>"
RELATIONS = "array<struct<from:string,from_type:string,to:string,to_type:string,label:string,evidence:string>>"
ANNOTATION = "person_id string, query_id string, query_text string, engine string, rank string, movie_key string, movie_title string, movie_overview string, relevance_grade string"


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): UTF-8 where the bytes are valid, else Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    # a split counts every file with the cost of opening it, so that small files make a task of some thirty each
    splits = raw._jdf.queryExecution().toRdd().getNumPartitions()
    raw = raw.coalesce(max(1, min(splits, max(4 * spark.sparkContext.defaultParallelism, splits // SPLITS))))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(good, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def write_texts(rows: DataFrame, folder: str) -> DataFrame:
    """Writes every row (name, text) as a file of its own and returns (path); text is a string, written as UTF-8, or binary.
    Files go through pyarrow's file system of the folder's scheme, so the folder may be on any storage that all executors
    reach. A task that runs again writes the same files again."""

    def run(batches):
        from pyarrow import fs

        remote = re.match(r"[a-z][a-z0-9+.-]*:", folder) and not folder.startswith("file:")
        if remote:
            where, base = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))
        else:
            where, base = fs.LocalFileSystem(), re.sub(r"^file:(//(?=/))?", "", folder)
        where.create_dir(base)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with where.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(text.encode() if isinstance(text, str) else text or b"")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in batch.column(0).to_pylist()], pa.string())], ["path"])

    return rows.select("name", "text").mapInArrow(run, "path string")


def tagged_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(movie_id, line_no, tag, content) of tagged files; bytes that are not UTF-8 become replacement characters."""
    raw = spark.read.text(path, wholetext=True).select(F.make_valid_utf8("value").alias("value"), F.input_file_name().alias("path"))
    return parse.tagged_lines(raw.withColumn("movie_id", F.regexp_replace(stem(F.col("path")), "_parsed$", "")), "movie_id")


def tagged_paths(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_name, path): <name>_parsed.txt if it is listed, else <name>.txt, else null."""
    have = listing.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "path")
    first = names.withColumn("file", F.concat("file_name", F.lit("_parsed.txt"))).join(have.withColumnRenamed("path", "p1"), "file", "left").drop("file")
    both = first.withColumn("file", F.concat("file_name", F.lit(".txt"))).join(have.withColumnRenamed("path", "p2"), "file", "left").drop("file")
    return both.withColumn("path", F.coalesce("p1", "p2")).drop("p1", "p2")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("v"), F.input_file_name().alias("path"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, file_name, source, title, overview) of a metadata file, one JSON object of movies."""
    rows = _json(spark, path, META).select(F.explode("v").alias("key", "m"))
    return rows.select("key", "m.file.name", "m.file.file_name", "m.file.source", "m.tmdb.title", "m.tmdb.overview")


def extracted(spark: SparkSession, entities: str, relations: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities (movie_id, name, entity_type, ord), relations (movie_id, from_name, ..., ord)) of JSON files named after
    their movie. Without relation files there are no relations."""
    e = _json(spark, entities, f"struct<entities:{ENTITIES}>").select(F.regexp_replace(stem(F.col("path")), "_entities$", "").alias("movie_id"), F.posexplode("v.entities").alias("ord", "e"))
    found = e.select("movie_id", F.col("e.text").alias("name"), F.col("e.label").alias("entity_type"), "ord")
    columns = "movie_id string, from_name string, from_type string, to_name string, to_type string, label string, evidence string, ord int"
    if relations is None:
        return found, spark.createDataFrame([], columns)
    r = _json(spark, relations, f"struct<relations:{RELATIONS}>").select(F.regexp_replace(stem(F.col("path")), "_relations$", "").alias("movie_id"), F.posexplode("v.relations").alias("ord", "r"))
    return found, r.select("movie_id", F.col("r.from").alias("from_name"), "r.from_type", F.col("r.to").alias("to_name"), "r.to_type", "r.label", "r.evidence", "ord")


def available_movie_ids(spark: SparkSession, entities: str) -> DataFrame:
    """(movie_id) of the entity files in a folder; their contents are not read."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*_entities.json").load(entities).select("path")
    return paths.select(F.regexp_replace(stem(F.col("path")), "_entities$", "").alias("movie_id")).orderBy("movie_id")


def json_lines(spark: SparkSession, path: str, schema: str = LINE_QUERY, lenient: bool = False) -> DataFrame:
    """Rows of a JSONL file; a malformed line fails the read, or is left out if lenient. Blank lines do not count."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def eval_queries(spark: SparkSession, path: str, lookup: DataFrame | None = None, clean_only: bool = True) -> DataFrame:
    """(query_id, query, movie_title, movie_key) of an evaluation file, flat or nested under evaluation_queries.
    Flat files: queries that begin with a brace, leaked ones and those of unknown movies are left out; the id is the place
    in the file. Nested files lose leaked queries only if clean_only."""
    text = spark.read.text(path, wholetext=True)
    bare = text.select(F.posexplode(F.from_json("value", FLAT_EVAL)).alias("query_id", "q"), F.lit(True).alias("flat")).where("q IS NOT NULL AND q.query IS NOT NULL")
    nested = text.select(F.posexplode(F.from_json("value", f"struct<evaluation_queries:{FLAT_EVAL}>")["evaluation_queries"]).alias("query_id", "q"), F.lit(False).alias("flat"))
    rows = bare.unionByName(nested).select("query_id", "flat", "q.query", "q.movie_id", F.coalesce("q.movie_title", "q.movie_name").alias("movie_title"), F.coalesce("q.validation.has_leakage", F.lit(False)).alias("leaked"))
    rows = rows.where(~(F.col("leaked") & (F.col("flat") | F.lit(clean_only))) & ~(F.col("flat") & strip(F.col("query")).startswith("{")))
    if lookup is None:
        return rows.select("query_id", "query", "movie_title", F.col("movie_id").alias("movie_key"))
    known = rows.withColumn("alias", alnum_key(F.coalesce("movie_id", "movie_title"))).join(lookup.select("alias", F.col("key").alias("movie_key")), "alias", "left")
    return known.where(~F.col("flat") | F.col("movie_key").isNotNull()).select("query_id", "query", "movie_title", "movie_key")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Graded rows of a CSV with a header: those with a blank, a word or anything but 0, 1 and 2 as their grade go."""
    rows = read_csv(spark, path, ANNOTATION)
    grade = F.expr("try_cast(trim(relevance_grade) AS double)")
    return rows.select("person_id", "query_id", "engine", F.expr("try_cast(rank AS int)").alias("rank"), "movie_key", grade.alias("grade")).where(F.col("grade").isin(0.0, 1.0, 2.0))


#: Fields as they are: every string in quotes, quotes doubled, no space trimmed, lines told apart by a line feed alone.
CSV = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": "\uffff", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**CSV, quoteAll=True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV with a header; fields may hold line breaks. An empty field is null."""
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a report; every row is an object of several lines, one after the other."""
    text = spark.read.text(path, wholetext=True)
    objects = F.split(F.trim("value"), r"\n(?=\{)")
    return text.where(F.trim("value") != "").select(F.explode(objects).alias("o")).select(F.from_json("o", schema).alias("r")).select("r.*")


def eval_candidates(movies: DataFrame, least: int = 10) -> DataFrame:
    """Movies whose overview is long enough to ask about."""
    return movies.where(word_count(F.coalesce("overview", F.lit(""))) >= least)
