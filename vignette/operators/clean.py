"""Cleaning of generated queries: repair, score, decide, drop duplicates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import repair as R
from ..functions.text import content_tokens, strip, strip_fences, straight_quotes, word_count
from ..storage import bounded_batches, stored

NEAR = 0.85


def repaired(rows: DataFrame, query: str = "query") -> DataFrame:
    """rows with cleaned_query (null if beyond repair), repair_method, repair_flags and structural_reason."""
    step = rows.withColumn("__text", strip(straight_quotes(F.coalesce(F.col(query), F.lit("")))))
    step = step.withColumns({"__bare": strip_fences(F.col("__text")), "__fence": F.col("__text").startswith("```")})
    step = step.withColumns({"__json": R.unwrapped_json(F.col("__bare")), "__part": R.salvaged_json(F.col("__bare")), "__plain": R.tidy(F.btrim(F.btrim(F.col("__bare"), F.lit('"')), F.lit("'")))})
    plain = F.col("__plain")
    step = step.withColumn(
        "structural_reason",
        F.when(F.col("__text") == "", "empty_query").when(F.col("__json").isNotNull() | F.col("__part").isNotNull(), None).when(R.wrapped(plain), "json_wrapper_artifact").when(R.truncated(plain), "likely_truncated").when(word_count(plain) < R.MIN_WORDS, "too_short"),
    )
    fence, json, part = F.col("__fence"), F.col("__json").isNotNull(), F.col("__part").isNotNull()
    bad = F.col("structural_reason").isNotNull()
    method = (
        F.when(F.col("__text") == "", "empty")
        .when(json, F.when(fence, "parsed_fenced_json_wrapper").otherwise("parsed_json_wrapper"))
        .when(part, "salvaged_partial_json")
        .when(~bad & (plain != F.col("__text")), "normalized_plain_text")
        .when(fence, "stripped_markdown_fence")
        .otherwise("as_is")
    )
    flags = F.array(F.when(fence, "markdown_fence"), F.when(json | part, "had_json_wrapper"), F.when(~json & part, "partial_json_salvaged"), F.when(bad & (F.col("__text") != ""), F.col("structural_reason")))
    cleaned = F.when(F.col("__text") == "", None).otherwise(F.coalesce("__json", "__part", F.when(~bad, plain)))
    made = step.withColumns({"cleaned_query": cleaned, "repair_method": method, "repair_flags": F.array_compact(flags)})
    return made.drop("__text", "__bare", "__fence", "__json", "__part", "__plain")


def scored(rows: DataFrame, query: str = "cleaned_query", title: str = "movie_title", kind: str = "query_type", names: str | None = None) -> DataFrame:
    """rows with quality_score (0 where there is no query) and quality_flags."""
    found = R.faults(F.col(query), F.coalesce(F.col(title), F.lit("")), F.col(kind), F.col(names) if names else None)
    step = rows.withColumns({f"__f{i}": F.coalesce(c, F.lit(False)) for i, (_, _, c) in enumerate(found)})
    lost = sum((F.when(F.col(f"__f{i}"), F.lit(p)).otherwise(F.lit(0.0)) for i, (_, p, _) in enumerate(found)), F.lit(0.0))
    flags = F.array_compact(F.array(*[F.when(F.col(f"__f{i}"), name) for i, (name, _, _) in enumerate(found)]))
    none = F.col(query).isNull()
    made = step.withColumns({"quality_score": F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round(1 - lost, 4))), "quality_flags": F.when(none, F.array().cast("array<string>")).otherwise(flags)})
    return made.drop(*[f"__f{i}" for i in range(len(found))])


def decided(rows: DataFrame, can_regenerate: Column | None = None) -> DataFrame:
    """rows with action keep, regenerate or reject. Without a generator nothing is regenerated."""
    least = F.when(F.col("query_type") == "scene_summary", R.KEEP_FROM["scene_summary"]).otherwise(R.KEEP_FROM["synopsis"])
    keep = F.col("cleaned_query").isNotNull() & (F.col("quality_score") >= least)
    again = F.lit(False) if can_regenerate is None else F.coalesce(can_regenerate, F.lit(False))
    return rows.withColumn("action", F.when(keep, "keep").when(again, "regenerate").otherwise("reject"))


def regenerated(rows: DataFrame, generate: Callable[[DataFrame], DataFrame], names: str | None = None) -> DataFrame:
    """rows where those with the action regenerate carry what `generate` made of them. generate takes those rows and
    returns (row_id, query); a query that falls short of the threshold, or none, is a rejection with its reason."""
    wait = rows.where("action = 'regenerate'")
    fresh = generate(wait).select("row_id", F.col("query").alias("cleaned_query"))
    again = scored(wait.drop("cleaned_query", "quality_score", "quality_flags").join(fresh, "row_id", "left"), names=names)
    again = decided(again).withColumn("reject_reason", F.when(F.col("cleaned_query").isNull(), "regeneration_failed").when(F.col("action") == "reject", "regenerated_below_quality"))
    again = again.withColumn("action", F.when(F.col("action") == "keep", "regenerate").otherwise("reject")).withColumn("was_regenerated", F.col("action") == "regenerate")
    rest = rows.where("action <> 'regenerate'").withColumns({"reject_reason": F.lit(None).cast("string"), "was_regenerated": F.lit(False)})
    return rest.unionByName(again.select(*rest.columns))


# --- greedy removal of near duplicates ------------------------------------------------------------------------------


SLOTS = 1 << 18  # counters that order the tokens
WORDS = 4  # of 64 bits, in a set's parities


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """How many tokens fall into each of SLOTS counters. It only orders tokens: what shares a counter with a frequent token
    counts as frequent, which costs candidates and loses none."""
    slot = tokens.select(F.explode(F.split("tokens", " ")).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(SLOTS)).cast("int").alias("slot"))
    count = np.zeros(SLOTS, np.int64)
    rows = slot.groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    count[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return count


def _prefixes(sets: DataFrame, least: float, scope: list[str]) -> DataFrame:
    """sets (sid, scope, n, tokens) with two things instead of the tokens. `first`: the hashes of a set's rarest tokens, so
    many that two sets with a similarity of `least` share one. b0, b1...: bits that say which hashes are there an odd number of
    times; two sets differ in no more bits than tokens. A set is read in one row, so nothing is shuffled."""
    spark = sets.sparkSession
    bounded_batches(spark)
    count = spark.sparkContext.broadcast(_frequencies(sets))
    hashed = sets.select("sid", *scope, "n", F.transform(F.split("tokens", " "), lambda t: F.xxhash64(t)).alias("first"))
    bits = [f"b{i}" for i in range(WORDS)]

    def cut(batches):
        often = count.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            hashes, edge = column.flatten().to_numpy(), column.offsets.to_numpy()
            n = np.diff(edge)
            edge = edge - edge[0]
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((hashes, often[np.mod(hashes, len(often))], of))
            length = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            stays = np.arange(len(of)) - edge[:-1][of] < length[of]
            ends = np.concatenate([[0], np.cumsum(np.minimum(length, n))]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[order][stays]))
            bit = (hashes >> 32) % (64 * WORDS)
            odd = np.bincount(of * (64 * WORDS) + bit, minlength=len(n) * 64 * WORDS) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(n), WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made, *[pa.array(words[:, i].copy()) for i in range(WORDS)]], [*batch.schema.names, *bits])

    return hashed.mapInArrow(cut, T.StructType([*hashed.schema, *(T.StructField(b, T.LongType()) for b in bits)]))


def _pairs(keyed: DataFrame, sets: DataFrame, scope: list[str], least: float) -> DataFrame:
    """(a, b): set ids of one scope with a Jaccard similarity of `least` or more, a < b. Two such sets share a token among the
    first few of each, rare ones first, so only these are joined, as hashes; what stands behind the shared token on
    either side bounds the overlap, and pairs that cannot reach it, or whose bits differ too much, go before the sets are
    compared, token by token. tokens: with blanks between them, which takes a third of what an array takes when it is shuffled."""
    some = keyed.where("n > 0").select(F.col("row_id").alias("sid"), *scope, "n", "tokens")
    coded = stored(_prefixes(some, least, scope).join(sets.select("sid"), "sid", "left_semi"), "coded")
    prefix = coded.select("sid", *scope, "n", F.posexplode("first").alias("p", "t"))
    left = prefix.select(*scope, "t", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    right = prefix.select(*scope, "t", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    overlap = F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = left.join(right, [*scope, "t"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb")) & (reach >= overlap)).select("a", "b").distinct()
    bits = [f"b{i}" for i in range(WORDS)]
    side = lambda x: coded.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), *[F.col(b).alias(f"{x}{b}") for b in bits])
    apart = sum((F.bit_count(F.col(f"a{b}").bitwiseXOR(F.col(f"b{b}"))) for b in bits), F.lit(0))
    near = near.join(side("a"), "a").join(side("b"), "b").where(apart <= (F.col("na") + F.col("nb")) * F.lit((1 - least) / (1 + least)) + 1e-6).select("a", "b")
    full = some.select("sid", "tokens", "n").hint("merge")  # by its files, the table looks smaller than its tokens are
    both = near.join(full.withColumnsRenamed({"sid": "a", "tokens": "ia", "n": "na"}), "a").join(full.withColumnsRenamed({"sid": "b", "tokens": "ib", "n": "nb"}), "b")
    shared = F.size(F.array_intersect(F.split("ia", " "), F.split("ib", " ")))
    return both.where(shared / (F.col("na") + F.col("nb") - shared) >= least).select("a", "b")


def _digest(text: Column) -> Column:
    """32 bytes that stand for a text where texts are only compared for equality."""
    return F.unhex(F.sha2(text, 256))


def greedy_survivors(rows: DataFrame, scope: list[str], priority: list[Column], query: str = "cleaned_query", row_id: str = "row_id", least: float = NEAR) -> DataFrame:
    """(row_id, verdict): survivor, exact or near, as if the rows of each scope were taken in the order of `priority` and
    each was dropped that resembles a survivor. The result is the first maximal independent set of the graph of
    near pairs, found in rounds: a row that waits for no better neighbour survives, and its neighbours go. Rows of one token set resolve as one, so
    that many copies cost one row each. A round is one stored table, of the sets that are gone."""
    words = rows.select(F.col(row_id).alias("row_id"), *scope, content_tokens(F.col(query)).alias("words"), F.struct(*priority, F.col(row_id).alias("__id")).alias("p"))
    listed = words.withColumn("set", F.array_sort(F.array_distinct("words")))
    joined = listed.select("row_id", *scope, F.array_join("words", " ").alias("key"), F.size("set").alias("n"), F.array_join("set", " ").alias("tokens"), "p")
    keyed = stored(joined.select("row_id", *scope, _digest(F.col("key")).alias("key"), _digest(F.col("tokens")).alias("set"), "n", "tokens", "p"), "keyed")
    sets = stored(keyed.groupBy(*scope, "set").agg(F.min("p").alias("p"), F.min_by("row_id", "p").alias("sid")), "sets")
    rank = sets.select("sid", "p")
    near = _pairs(keyed, sets, scope, least)
    ranked = near.join(rank.withColumnsRenamed({"sid": "a", "p": "pa"}), "a").join(rank.withColumnsRenamed({"sid": "b", "p": "pb"}), "b")
    first = F.col("pa") < F.col("pb")
    edges = stored(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lo")), "edges")
    gone = None
    while True:  # a round loses at least the neighbours of the best row that is still open
        open_ = edges if gone is None else edges.join(gone.select(F.col("sid").alias("lo")), "lo", "left_anti").join(gone.select(F.col("sid").alias("hi")), "hi", "left_anti")
        safe = open_.join(open_.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
        lost = safe.select(F.col("lo").alias("sid"), F.lit(True).alias("new")).distinct()
        now = stored(lost if gone is None else lost.unionByName(gone.withColumn("new", F.lit(False))), "gone")
        if now.where("new").isEmpty():
            break
        gone = now.select("sid")
    lead = sets.select("sid")
    if gone is not None:
        lead = lead.join(gone, "sid", "left_anti")
    kept = keyed.join(lead.select(F.col("sid").alias("row_id")), "row_id", "left_semi").select("row_id", *scope, "key")
    same = kept.select(*scope, "key").distinct().withColumn("twin", F.lit(True))
    told = keyed.select("row_id", *scope, "key").join(same, [*scope, "key"] if scope else "key", "left").join(kept.select("row_id", F.lit(True).alias("stays")), "row_id", "left")
    return told.select(F.col("row_id").alias(row_id), F.when(F.col("stays"), "survivor").when(F.col("twin"), "exact").otherwise("near").alias("verdict"))


def deduplicated(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Kept and regenerated rows first compete within (movie, type), then all survivors together; what loses is
    rejected as duplicate_within_movie or duplicate_global, with `duplicate` exact or near. Better scores come first, at
    equal scores originals before regenerated rows, then the smaller row id."""
    rows = rows if "was_regenerated" in rows.columns else rows.withColumn("was_regenerated", F.lit(False))
    rows = rows if "reject_reason" in rows.columns else rows.withColumn("reject_reason", F.lit(None).cast("string"))
    order = [(-F.col("quality_score")).alias("s"), F.col("was_regenerated").alias("w")]
    rows = stored(rows, "cleaned")
    kept = rows.where("action IN ('keep', 'regenerate') AND cleaned_query IS NOT NULL AND cleaned_query <> ''")
    one = stored(greedy_survivors(kept, ["movie_id", "query_type"], order, row_id=row_id), "within")
    left = kept.join(one.where("verdict = 'survivor'").select(row_id), row_id, "left_semi")
    all_ = greedy_survivors(left, [], order, row_id=row_id)
    lost = one.where("verdict <> 'survivor'").select(row_id, F.col("verdict").alias("duplicate"), F.lit("duplicate_within_movie").alias("why")).unionByName(all_.where("verdict <> 'survivor'").select(row_id, F.col("verdict").alias("duplicate"), F.lit("duplicate_global").alias("why")))
    out = rows.join(lost, row_id, "left")
    return out.withColumns({"action": F.when(F.col("why").isNotNull(), "reject").otherwise(F.col("action")), "reject_reason": F.coalesce("why", "reject_reason")}).drop("why")


def cleaned(rows: DataFrame, names: str | None = None, can_regenerate: Column | None = None, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The whole job on (row_id, movie_id, movie_title, query, query_type): every row with its action and reasons."""
    told = decided(scored(repaired(rows), names=names), can_regenerate if generate else None)
    told = told.withColumn("reject_reason", F.when(F.col("action") == "reject", F.coalesce("structural_reason", F.lit("below_quality"))))
    told = stored(told, "judged")  # else filters on the action are pushed down and repeat the whole repair in every predicate
    if generate:
        told = regenerated(told.drop("reject_reason"), generate, names)
    return deduplicated(told)


def first_movies(rows: DataFrame, n: int | None, order: str = "row_id") -> DataFrame:
    """The rows of the n movies that come first."""
    if n is None:
        return rows
    first = rows.where("movie_id <> ''").groupBy("movie_id").agg(F.min(order).alias("o")).orderBy("o").limit(n)
    return rows.join(first.select("movie_id"), "movie_id", "left_semi")


def outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean rows, audit of all rows, rejected rows)."""
    clean = rows.where("action <> 'reject'").select("row_id", "movie_id", "movie_title", F.col("cleaned_query").alias("query"), "query_type")
    audit = rows.select("row_id", "movie_id", "movie_title", "query_type", F.col("query").alias("original_query"), "cleaned_query", "action", "repair_method", "quality_score", F.concat("repair_flags", "quality_flags").alias("flags"), "reject_reason", "was_regenerated")
    return clean, audit, audit.where("action = 'reject'").withColumn("query", F.col("original_query"))


def report(rows: DataFrame) -> DataFrame:
    """(query_type, keep, regenerate, reject, movies) with a total in the row where query_type is null."""
    n = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0)).cast("bigint").alias(a)
    agg = [n("keep"), n("regenerate"), n("reject"), F.countDistinct("movie_id").alias("movies")]
    return rows.groupBy("query_type").agg(*agg).unionByName(rows.agg(*agg).withColumn("query_type", F.lit(None).cast("string")))


def reject_reasons(rows: DataFrame, top: int = 10) -> DataFrame:
    return rows.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "reject_reason").limit(top)


