"""Tagged scripts to scenes and sentences, as windows over the lines of a script; and splitters of raw scripts.

Input lines: (script key..., line_no, tag, content). line_no carries the order; `by` names the columns of one script.
All windows share the partitioning by script, so one shuffle serves the whole parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text


def tagged_lines(raw: DataFrame, by: str = "path", value: str = "value") -> DataFrame:
    """(by, line_no, tag, content) of whole texts: lines without ': ' are dropped, the first one splits."""
    line = raw.select(by, F.posexplode(F.split(value, r"\r\n|\n|\r")).alias("line_no", "line"))
    line = line.select(by, "line_no", text.strip(F.col("line")).alias("line")).where(F.col("line").contains(": "))
    at = F.instr("line", ": ")
    return line.select(by, "line_no", F.substring("line", F.lit(1), at - 1).alias("tag"), F.expr("substring(line, instr(line, ': ') + 2)").alias("content"))


def annotated(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines with scene_index (-1 before the first scene), speaker and extension as they hold at each line."""
    script = Window.partitionBy(*by).orderBy("line_no")
    numbered = lines.withColumn("scene_index", F.sum(F.when(F.col("tag") == "S", 1).otherwise(0)).over(script.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    scene = Window.partitionBy(*by, "scene_index").orderBy("line_no")
    before = scene.rowsBetween(Window.unboundedPreceding, -1)
    speaker = F.last(F.when(F.col("tag") == "C", F.col("content")), ignorenulls=True).over(before)
    event = F.last(F.when(F.col("tag").isin("S", "C", "E", "D"), F.struct("tag", "content")), ignorenulls=True).over(before)
    return numbered.withColumn("speaker", speaker).withColumn("__event", event).withColumn("extension", F.when((F.col("__event.tag") == "E") & (F.col("__event.content") != ""), F.col("__event.content"))).drop("__event")


def _shown() -> Column:
    who = F.coalesce("speaker", F.lit("None"))
    said = F.when(F.col("extension").isNotNull(), F.concat(who, F.lit(" ("), "extension", F.lit("): "), "content")).otherwise(F.concat(who, F.lit(": "), "content"))
    return F.when(F.col("tag") == "D", said).otherwise(F.col("content"))


def sentences(lines: DataFrame, by: list[str]) -> DataFrame:
    """One row per description, dialogue and transition line; positions count these only, from the script's start."""
    kind = F.when(F.col("tag") == "N", "description").when(F.col("tag") == "D", "dialogue").when(F.col("tag") == "T", "transition")
    rows = annotated(lines, by).withColumn("line_type", kind).where("line_type IS NOT NULL")
    position = F.row_number().over(Window.partitionBy(*by).orderBy("line_no")) - 1
    return rows.select(*by, ids.scene_id(F.col("scene_index")).alias("scene_id"), "scene_index", F.col("content").alias("text"), "line_type", position.alias("position_in_script"), F.when(F.col("tag") == "D", F.col("speaker")).alias("character_name"))


def scenes(lines: DataFrame, by: list[str]) -> DataFrame:
    """One row per scene: its title, its text in order, and who speaks in it, in the order of first speech."""
    rows = annotated(lines, by).where(F.col("tag").isin("S", "N", "D", "T") & (F.col("scene_index") >= 0))
    speaks = F.when((F.col("tag") == "D") & (F.col("speaker") != ""), F.col("speaker"))
    grouped = rows.groupBy(*by, "scene_index").agg(F.array_sort(F.collect_list(F.struct("line_no", _shown().alias("shown"), speaks.alias("who")))).alias("l"))
    names = F.array_distinct(F.array_compact(F.transform("l", lambda x: x["who"])))
    return grouped.select(*by, ids.scene_id(F.col("scene_index")).alias("scene_id"), "scene_index", F.array_join(F.transform("l", lambda x: x["shown"]), "\n").alias("text"), F.col("l")[0]["shown"].alias("scene_title"), names.alias("character_names"))


def corpus(scene_rows: DataFrame, movies: DataFrame, by: str = "movie_id", least_words: int = 40, most_movies: int | None = None, seed: int = 42) -> DataFrame:
    """Scenes of least_words or more with their movie's overview; of most_movies movies in the order of a seeded hash."""
    long = scene_rows.where(text.word_count(F.col("text")) >= least_words)
    if most_movies is not None:
        picked = long.select(by).distinct().orderBy(F.xxhash64(F.lit(seed), by), by).limit(most_movies)
        long = long.join(picked, by, "left_semi")
    return long.join(movies.select(by, "overview"), by)


def surviving(sentence_rows: DataFrame, scene_rows: DataFrame, by: list[str]) -> DataFrame:
    return sentence_rows.join(scene_rows.select(*by, "scene_id"), [*by, "scene_id"], "left_semi")


def with_embeddings(records: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Records with their vectors, joined by key; a record without a vector fails the query."""
    joined = records.join(vectors.select(*key, "embedding"), key, "left")
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a record has no embedding"))).otherwise(F.col("embedding")))


_MARK = "\u0001"
_HEADING = r"(?i)(^|\n)([ \t]*(?:INT|EXT|INT\./EXT|I/E)[./])"


def _pieces(value: Column, pattern: str, replacement: str) -> Column:
    """The stretches between starts of the pattern: what precedes the first start is not one."""
    marked = F.regexp_replace(value, pattern, replacement)
    parts = F.split(marked, _MARK)
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["i"] > 0)


def _fixed(value: Column, size: int) -> Column:
    return F.transform(F.when(F.length(value) > 0, F.sequence(F.lit(0), F.floor((F.length(value) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.substring(value, i * size + 1, F.lit(size)).alias("p"), (i + 1).alias("i")))


def split_scenes(value: Column, cuts: str = "CUT TO:", fixed: int = 1000, least: int = 200, most: int = 3000, keep_last: bool = False) -> Column:
    """Scenes of a raw script: between headings; with less than three of them between cut marks; with less than three
    of those in pieces of fixed size. Only scenes of least..most characters. Without keep_last the last stretch is
    dropped; with it, pieces of fixed size keep their outer white space."""
    headed = _pieces(value, _HEADING, rf"{_MARK}$1$2")
    cut = _pieces(value, rf"(?i)({cuts})", rf"{_MARK}$1")
    is_fixed = (F.size(headed) < 3) & (F.size(cut) < 3)
    chosen = F.when(F.size(headed) >= 3, headed).when(F.size(cut) >= 3, cut).otherwise(_fixed(value, fixed))
    if not keep_last:
        chosen = F.slice(chosen, F.lit(1), F.greatest(F.size(chosen) - 1, F.lit(0)))
    found = F.transform(chosen, lambda x: F.when(is_fixed, x["p"]).otherwise(text.strip(x["p"])) if keep_last else text.strip(x["p"]))
    return F.filter(found, lambda s: (F.length(s) >= least) & (F.length(s) <= most))


#: The two parameter sets in use: for ranking, and for query generation.
RANKING_SCENES = {}
GENERATION_SCENES = {"cuts": r"\n(?U:\s*)(?:CUT TO:|FADE (?:IN|OUT)|DISSOLVE TO:)", "fixed": 800, "least": 300, "most": 2500, "keep_last": True}


def paragraphs_packed(value: Column, most: int = 4000) -> Column:
    """Paragraphs packed greedily into chunks: a new one starts where the next paragraph would pass `most`."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def fold(acc: Column, part: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(part) > most) & (acc["now"] != "")
        return F.when(full, F.struct(F.array_append(acc["done"], text.strip(acc["now"])).alias("done"), part.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n\n"), part).alias("now")))

    return F.aggregate(F.split(value, "\n\n"), start, fold, lambda acc: F.when(text.strip(acc["now"]) != "", F.array_append(acc["done"], text.strip(acc["now"]))).otherwise(acc["done"]))


def random_scene(scene_rows: DataFrame, by: list[str], seed: int = 1) -> DataFrame:
    """One scene of every script, drawn by a seeded hash."""
    return scene_rows.groupBy(*by).agg(F.min_by("scene_id", F.struct(F.xxhash64(F.lit(seed), *by, "scene_id"), "scene_id")).alias("scene_id"))
