"""BM25 over scene texts, pooled to movies.

A document's terms stay in one row. Queries are packed into blocks of term weights; a batch of documents meets a block as
one matrix product, so that no posting is shuffled and a score leaves the task whole. Corpus statistics are a single row.
Nothing is collected. A doc_id names one document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RETRIEVAL_STOPS, retrieval_tokens, retrieval_words, strip
from ..storage import bounded_batches, stored
from .parse import RANKING_SCENES, split_scenes


@dataclass(frozen=True)
class Okapi:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25  # share of the mean idf that terms in more than half of the documents get


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # doc_id, movie_key
    postings: DataFrame  # doc_id, term, tf
    terms: DataFrame  # term, idf
    stats: DataFrame  # n, avgdl
    lengths: DataFrame  # doc_id, dl
    words: DataFrame  # doc_id, movie_key, dl, words (with blanks between them)


BLOCK_WEIGHTS, BLOCK_QUERIES = 1 << 16, 256  # of a block, on average
CELLS = 1 << 20  # documents times terms that a worker holds as one matrix


def _terms(rows: DataFrame, text: str, *carry: str) -> DataFrame:
    """One row per retrieval token. Words are exploded first, so that the tests on them are plain compiled filters."""
    words = rows.select(*carry, F.explode(retrieval_words(F.coalesce(text, F.lit("")))).alias("term"))
    return words.where((F.length("term") > 1) & ~F.col("term").isin(RETRIEVAL_STOPS))


def build(docs: DataFrame, okapi: Okapi = Okapi(), doc_id: str = "doc_id", movie: str = "movie_key", text: str = "text") -> Index:
    """An index over (doc_id, movie_key, text). Documents without a token count in the statistics. The words of a document
    and the counts of terms are stored once and everything else is made of them; texts are read once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(movie).alias("movie_key"), F.col(text).alias("text"))
    held = rows.select("doc_id", "movie_key", retrieval_tokens(F.coalesce("text", F.lit(""))).alias("list"))
    words = stored(held.select("doc_id", "movie_key", F.size("list").alias("dl"), F.array_join("list", " ").alias("words")), "words")
    some = words.where("dl > 0")
    tf = some.select("doc_id", F.explode(F.split("words", " ")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("tf"))
    stats = words.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("double").alias("t")).select("n", F.when(F.col("n") > 0, F.col("t") / F.col("n")).alias("avgdl"))
    often = stored(some.select(F.explode(F.array_distinct(F.split("words", " "))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    found = often.crossJoin(F.broadcast(stats.select("n")))
    raw = found.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * okapi.epsilon).alias("floor"))
    terms = raw.crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return Index(words.select("doc_id", "movie_key"), tf, terms, stats, some.select("doc_id", "dl"), words)


def corpus(metadata: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, movie_key, movie_name, text), missing (movie_key)): the scenes of every movie of the metadata (key,
    name, file_name) whose script is among the texts (file_name, text), or the whole script where no scene is found. A movie
    without a file name is left out; one whose script is not there or blank is missing."""
    named = metadata.where("file_name IS NOT NULL AND file_name <> ''").select(F.col("key").alias("movie_key"), F.coalesce("name", "key").alias("movie_name"), "file_name")
    both = named.join(texts.select("file_name", "text"), "file_name", "left").withColumn("there", F.coalesce(strip(F.col("text")) != "", F.lit(False)))
    scenes = split_scenes(F.col("text"), **RANKING_SCENES)
    cut = both.where("there").select("movie_key", "movie_name", F.posexplode(F.when(F.size(scenes) > 0, scenes).otherwise(F.array("text"))).alias("i", "text"))
    return cut.select(F.concat("movie_key", F.lit("#"), "i").alias("doc_id"), "movie_key", "movie_name", "text"), both.where("NOT there").select("movie_key")


def _weights(index: Index, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Blocks of queries: (asked, terms, weights), an element for each query and term."""
    asked = _terms(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("asked")), "asked", "query_id").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighed = stored(asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")), "weights")
    size = weighed.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("q")).first()
    blocks = max(1, -(-size["n"] // BLOCK_WEIGHTS), -(-size["q"] // BLOCK_QUERIES))
    packed = weighed.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "term", "w")).alias("x"))
    return stored(packed.select("block", F.col("x.query_id").alias("asked"), F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), "blocks")


def _pack(batches):
    """A batch of documents as one row."""
    for batch in batches:
        if batch.num_rows:
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in batch.columns], batch.schema.names)


def scores(index: Index, queries: DataFrame, okapi: Okapi = Okapi(), query_id: str = "query_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a term with the query; a repeated term counts again. carry:
    movie_key, for the document's movie."""
    bounded_batches(queries.sparkSession)
    blocks = _weights(index, queries, query_id, text)
    docs = index.words.where("dl > 0").crossJoin(F.broadcast(index.stats.select("avgdl"))).select("doc_id", *carry, (F.col("dl") / F.col("avgdl")).alias("length"), "words")
    packed = docs.mapInArrow(_pack, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in docs.schema]))
    names = ["query_id", "doc_id", *carry, "score"]
    kinds = [blocks.schema["asked"].dataType.elementType, *(docs.schema[c].dataType for c in ("doc_id", *carry)), T.DoubleType()]

    def product(batches):
        number = None
        for batch in batches:
            for r in range(batch.num_rows):
                block, asked, terms, weights, *keys, length, words = (batch.column(i)[r] for i in range(batch.num_columns))
                if block.as_py() != number:
                    number, asked, terms = block.as_py(), asked.values.dictionary_encode("encode"), terms.values.dictionary_encode()
                    query, known = asked.dictionary, terms.dictionary
                    weight = np.zeros((len(known), len(query)))
                    weight[terms.indices.to_numpy(), asked.indices.to_numpy()] = weights.values.to_numpy()
                    there = np.zeros(weight.shape, np.float32)
                    there[terms.indices.to_numpy(), asked.indices.to_numpy()] = 1
                length, keys = length.values.to_numpy(), [k.values for k in keys]
                step = max(1, CELLS // max(1, len(known)))
                for a in range(0, len(length), step):
                    some = pc.split_pattern(words.values.slice(a, step), " ")
                    at = pc.fill_null(pc.index_in(some.flatten(), value_set=known), -1).to_numpy()
                    of = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
                    of, at = of[at >= 0], at[at >= 0]
                    tf = np.bincount(of * len(known) + at, minlength=len(some) * len(known)).reshape(len(some), len(known)).astype(np.float64)
                    part = tf * (okapi.k1 + 1) / (tf + okapi.k1 * (1 - okapi.b + okapi.b * length[a : a + step, None]))
                    doc, q = np.nonzero((tf > 0).astype(np.float32) @ there)
                    score = (part @ weight)[doc, q]
                    doc = pa.array(doc + a)
                    yield pa.RecordBatch.from_arrays([query.take(pa.array(q)), *[k.take(doc) for k in keys], pa.array(score)], names)

    return packed.crossJoin(blocks).select(*blocks.columns, *docs.columns).mapInArrow(product, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def movies(index: Index, queries: DataFrame, top_k: int | None = None, okapi: Okapi = Okapi(), query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, movie_key, score, rank): every movie by its best document, those without a hit with 0."""
    best = scores(index, queries, okapi, query_id, text, ("movie_key",)).groupBy("query_id", "movie_key").agg(F.max("score").alias("score"))
    everyone = queries.select(F.col(query_id).alias("query_id")).crossJoin(index.docs.select("movie_key").distinct())
    ranked = everyone.join(best, ["query_id", "movie_key"], "left").select("query_id", "movie_key", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "movie_key"))
    ranked = ranked.withColumn("rank", rank)
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)
