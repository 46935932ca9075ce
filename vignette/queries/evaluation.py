"""BM25, metrics, agreement, leakage, lookup and cleaning on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import leakage as L
from ..functions import repair as R
from ..functions import text
from ..functions.text import LEAK_STOPS, QUERY_STOPS, RETRIEVAL_STOPS
from ..operators import clean, evaluate, leakage, lexical, lookup, measure, nearest, search
from ..sources import views
from ..storage import stored
from .registry import cosine_sql, query


def _in(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(column: str, stops: list[str]) -> str:
    return rf"list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+') AND length(w) > 1 AND NOT list_contains({_in(stops)}, w))"


# --- BM25 ------------------------------------------------------------------------------------------------------------

_BM25 = f"""
d AS (SELECT doc_id, source AS movie_key, {_tokens('text', RETRIEVAL_STOPS)} AS tokens FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM d),
po AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + CAST(0.5 AS DOUBLE)) - ln(count(*) + CAST(0.5 AS DOUBLE)) AS raw FROM po CROSS JOIN st GROUP BY term, n),
te AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * CAST(0.25 AS DOUBLE) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_tokens('text', RETRIEVAL_STOPS)}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(times * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS score FROM qt JOIN te USING (term) JOIN po USING (term) CROSS JOIN st GROUP BY ALL),
mv AS (SELECT query_id, movie_key, max(score) AS score FROM sc JOIN d USING (doc_id) GROUP BY ALL),
rk AS (SELECT query_id, movie_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_key) AS rank FROM (SELECT q.query_id, m.movie_key, round(coalesce(mv.score, 0.0::DOUBLE), 6) AS score FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN (SELECT DISTINCT source AS movie_key FROM documents) m LEFT JOIN mv ON q.query_id = mv.query_id AND m.movie_key = mv.movie_key))""".strip()


def _bm25(spark: SparkSession, sf_dir: str) -> tuple[lexical.Index, DataFrame]:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("movie_key"), "text")
    return lexical.build(docs), views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("SELECT query_id, movie_key, score, rank FROM rk", (), _BM25)
def a13_bm25_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage ranks every source by its best document."""
    index, asked = _bm25(spark, sf_dir)
    return lexical.movies(index, asked).select("query_id", "movie_key", "score", "rank")


@query("SELECT query_id, doc_id, round(score, 6) AS score FROM sc", (), _BM25)
def a12_bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _bm25(spark, sf_dir)
    return lexical.scores(index, asked).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("SELECT term, round(idf, 6) AS idf FROM te", (), _BM25)
def a12_bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)[0].terms.select("term", F.round("idf", 6).alias("idf"))


# --- metrics on the dense ranking of movies --------------------------------------------------------------------------

_RANKED = f"""
res AS (SELECT query_id, movie_id AS movie_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM (SELECT q.query_id, s.movie_id, max({cosine_sql('q.q', 's.embedding')}) AS score FROM v_query_vecs q CROSS JOIN v_scenes s GROUP BY ALL)),
hit AS (SELECT q.query_id, q.target_movie AS movie_key, min(r.rank) AS rank FROM v_query_vecs q LEFT JOIN (SELECT * FROM res WHERE rank <= 20) r ON q.query_id = r.query_id AND q.target_movie = r.movie_key GROUP BY ALL)""".strip()


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.query_vectors(spark, sf_dir)
    results = search.scene_pool(q, views.scenes(spark, sf_dir)).select("query_id", F.col("movie_id").alias("movie_key"), "rank")
    return measure.first_hits(q.select("query_id", F.col("target_movie").alias("movie_key")), results)


@query("SELECT query_id, movie_key, rank, CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE / rank, 6) END AS reciprocal FROM hit", ("v_query_vecs", "v_scenes"), _RANKED)
def a15_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "movie_key", "rank", F.round(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal"))


def _report_sql(ks: tuple[int, ...], digits: int, beyond: int) -> str:
    correct = ", ".join(f"CAST(coalesce(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct_at_{k}, round(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS accuracy_at_{k}" for k in ks)
    return f"SELECT count(*) AS total_queries, {correct}, round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / rank END), {digits}) AS mrr, list_sort(list(rank) FILTER (rank IS NOT NULL))[count(rank) // 2 + 1] AS median_rank, CAST(sum(CASE WHEN rank IS NULL OR rank > {beyond} THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM hit"


_FILMS = f"""
res AS (SELECT query_id, movie_id AS movie_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM (SELECT q.query_id, s.movie_id, max({cosine_sql('q.q', 's.embedding')}) AS score FROM v_film_queries q CROSS JOIN v_films s GROUP BY ALL)),
hit AS (SELECT q.query_id, q.movie_key, min(r.rank) AS rank FROM v_film_queries q LEFT JOIN res r ON q.query_id = r.query_id AND q.movie_key = r.movie_key GROUP BY ALL)""".strip()


def _film_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.film_queries(spark, sf_dir)
    results = search.scene_pool(q, views.films(spark, sf_dir), views.FILMS).select("query_id", F.col("movie_id").alias("movie_key"), "rank")
    return measure.first_hits(q.select("query_id", "movie_key"), results)


@query(_report_sql((5, 10, 15, 20), 3, 20), ("v_film_queries", "v_films"), _FILMS)
def a16_accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among more movies than the deepest k, so that every k counts and queries fail."""
    return measure.report(_film_hits(spark, sf_dir))


@query(_report_sql((5, 10, 20), 4, 20), ("v_film_queries", "v_films"), _FILMS)
def a17_accuracy_report_finetuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.report(_film_hits(spark, sf_dir), (5, 10, 20), digits=4, failed_beyond=None)


@query("SELECT query_id, movie_key, rank FROM hit WHERE rank IS NULL OR rank > 20", ("v_film_queries", "v_films"), _FILMS)
def a16_failed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.failed(_film_hits(spark, sf_dir)).select("query_id", "movie_key", "rank")


# --- whole evaluations ----------------------------------------------------------------------------------------------

_CUT = "SELECT query_id, {0} AS run, movie_key, rank FROM (SELECT query_id, movie_id AS movie_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM (SELECT q.query_id, s.movie_id, max(" + cosine_sql("q.q", "s.embedding") + ") AS score FROM v_film_queries q CROSS JOIN (SELECT * FROM v_films WHERE {1}) s GROUP BY ALL)) WHERE rank <= 20"
_FUSED = f"""
runs AS ({_CUT.format(0, 'true')} UNION ALL {_CUT.format(1, 'scene_index % 2 = 1')}),
fused AS (SELECT query_id, movie_key, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, min(run * 1000 + rank), movie_key) AS rank FROM runs GROUP BY query_id, movie_key),
hit AS (SELECT q.query_id, q.movie_key, min(r.rank) AS rank FROM v_film_queries q LEFT JOIN fused r ON q.query_id = r.query_id AND q.movie_key = r.movie_key GROUP BY ALL)""".strip()


def _film_retriever(spark: SparkSession, sf_dir: str, known: int = views.FILMS) -> evaluate.Retriever:
    """Films by their best scene; a second run looks at every other scene only."""
    scenes = views.films(spark, sf_dir).where(F.substring("movie_id", 6, 9).cast("int") < known)

    def retrieve(queries: DataFrame, top_k: int, run: int) -> DataFrame:
        found = search.scene_pool(queries, scenes.where("scene_index % 2 = 1") if run else scenes, top_k)
        return found.select("query_id", "rank", F.col("movie_id").alias("movie_key"), F.col("movie_id").alias("movie_name"))

    return retrieve


@query(_report_sql((5, 10, 15, 20), 3, 20), ("v_film_queries", "v_films"), _FUSED)
def m18_run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a retriever, fused and reported."""
    return evaluate.run_pipeline(views.film_queries(spark, sf_dir), _film_retriever(spark, sf_dir), runs=2)


_KNOWN = "CAST(substr({0}, 6) AS INTEGER) < 30"
_SCENE_EVAL = f"""
hit AS (SELECT q.query_id, q.movie_key, min(r.rank) AS rank FROM v_film_queries q LEFT JOIN ({_CUT.format(0, _KNOWN.format('movie_id'))}) r ON q.query_id = r.query_id AND q.movie_key = r.movie_key WHERE {_KNOWN.format('q.movie_key')} GROUP BY ALL)""".strip()


@query(f"SELECT *, (SELECT count(*) FROM v_film_queries WHERE NOT {_KNOWN.format('movie_key')}) AS skipped_missing_target FROM ({_report_sql((5, 10, 20), 4, 20)})", ("v_film_queries", "v_films"), _SCENE_EVAL)
def m18_run_scene_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that lacks some films: queries for these are skipped and counted."""
    corpus = views.films(spark, sf_dir).where(F.substring("movie_id", 6, 9).cast("int") < 30).select(F.col("movie_id").alias("movie_key"))
    return evaluate.run_scene_eval(views.film_queries(spark, sf_dir), _film_retriever(spark, sf_dir, 30), corpus)


@query("SELECT 0::BIGINT AS total_queries, 0::BIGINT AS correct_at_5, 0::BIGINT AS correct_at_10, 0::BIGINT AS correct_at_20, 0.0::DOUBLE AS accuracy_at_5, 0.0::DOUBLE AS accuracy_at_10, 0.0::DOUBLE AS accuracy_at_20, 0.0::DOUBLE AS mrr, CAST(NULL AS INTEGER) AS median_rank, 0::BIGINT AS failed, (SELECT count(*) FROM v_film_queries) AS skipped_missing_target", ("v_film_queries",))
def m18_zero_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No target is in the corpus."""
    corpus = views.films(spark, sf_dir).select(F.concat(F.lit("other "), "movie_id").alias("movie_key"))
    return evaluate.run_scene_eval(views.film_queries(spark, sf_dir), _film_retriever(spark, sf_dir), corpus)


@query(f"SELECT query_id, movie_key FROM v_film_queries WHERE {_KNOWN.format('movie_key')}", ("v_film_queries",))
def j14_known_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = views.films(spark, sf_dir).where(F.substring("movie_id", 6, 9).cast("int") < 30).select(F.col("movie_id").alias("movie_key"))
    return evaluate.known_targets(views.film_queries(spark, sf_dir).select("query_id", "movie_key"), corpus)


_STUDY = """
asg AS (SELECT DISTINCT concat('P', user_id % 16) AS person_id, event_id % 45 AS query_id, event_type AS method FROM events),
fnd AS (SELECT query_id, method, movie_key, movie_name, row_number() OVER (PARTITION BY query_id, method ORDER BY doc_id) AS rank FROM (SELECT doc_id, doc_id % 40 AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'click' ELSE 'view' END AS method, source AS movie_key, CASE WHEN doc_id % 5 <> 0 THEN upper(source) END AS movie_name FROM documents)),
ovw AS (SELECT source AS key, min(text) AS overview FROM documents WHERE source < 'src-1' GROUP BY source)""".strip()


@query("SELECT a.person_id, a.query_id, b.text AS query_text, a.method AS engine, f.rank, f.movie_key, coalesce(f.movie_name, f.movie_key) AS movie_title, coalesce(substr(o.overview, 1, 200), '') AS movie_overview, '' AS relevance_grade FROM asg a JOIN benchmark b ON a.query_id = b.item_id JOIN fnd f ON a.query_id = f.query_id AND a.method = f.method LEFT JOIN ovw o ON f.movie_key = o.key WHERE f.rank <= 5", (), _STUDY)
def m12_grading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = views.table(spark, sf_dir, "events"), views.table(spark, sf_dir, "documents")
    assigned = e.select(F.concat(F.lit("P"), F.col("user_id") % 16).alias("person_id"), (F.col("event_id") % 45).alias("query_id"), F.col("event_type").alias("method")).distinct()
    asked = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = d.select("doc_id", (F.col("doc_id") % 40).alias("query_id"), F.when(F.col("doc_id") % 3 == 0, "click").otherwise("view").alias("method"), F.col("source").alias("movie_key"), F.when(F.col("doc_id") % 5 != 0, F.upper("source")).alias("movie_name"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "method").orderBy("doc_id"))).where("rank <= 5")
    movies = d.where("source < 'src-1'").groupBy(F.col("source").alias("key")).agg(F.min("text").alias("overview"))
    return evaluate.grading_rows(assigned, asked, found, movies)


_SCRIPTS = r"""
meta AS (SELECT concat('movie', doc_id) AS movie_key, CASE WHEN doc_id % 4 <> 0 THEN concat('Movie ', doc_id) ELSE concat('movie', doc_id) END AS movie_name, text, doc_id % 5 <> 1 AND trim(text) <> '' AS there FROM documents WHERE doc_id % 7 <> 0),
pcs AS (SELECT movie_key, i, n, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM (SELECT movie_key, i, n, substr(text, i * 1000 + 1, 1000) AS s FROM (SELECT movie_key, text, unnest(range((length(text) - 1) // 1000 + 1)) AS i, (length(text) - 1) // 1000 + 1 AS n FROM meta WHERE there)) WHERE i < n - 1),
good AS (SELECT movie_key, s FROM pcs WHERE length(s) BETWEEN 200 AND 3000)""".strip()


def _scripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as scripts: some movies have no file name, the scripts of some are not there."""
    d = views.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("script-"), "doc_id")
    meta = d.select(F.concat(F.lit("movie"), "doc_id").alias("key"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Movie "), "doc_id")).alias("name"), F.when(F.col("doc_id") % 7 != 0, name).alias("file_name"))
    return lexical.corpus(meta, d.where("doc_id % 5 <> 1").select(name.alias("file_name"), "text"))


@query("SELECT movie_key, movie_name, s AS text FROM good JOIN meta USING (movie_key) UNION ALL SELECT movie_key, movie_name, text FROM meta WHERE there AND movie_key NOT IN (SELECT movie_key FROM good)", (), _SCRIPTS)
def a14_bm25_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir)[0].select("movie_key", "movie_name", "text")


@query("SELECT movie_key FROM meta WHERE NOT there", (), _SCRIPTS)
def a14_missing_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir)[1]


_DEEP = f"""
pair AS (SELECT q.query_id, s.vec_id, q.target_movie = s.movie_id AS hit, {cosine_sql('q.q', 's.embedding')} AS score FROM v_query_vecs q CROSS JOIN v_scenes s),
deep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 20),
cum AS (SELECT *, sum(hit::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM deep),
rel AS (SELECT query_id, count(*) AS n FROM pair WHERE hit GROUP BY query_id),
each AS (SELECT query_id, {', '.join(f'sum(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END) AS h{k}' for k in (5, 10, 20))}, min(CASE WHEN hit THEN rank END) AS first, sum(CASE WHEN hit THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN hit THEN hits::DOUBLE / rank ELSE 0 END) AS ap FROM cum GROUP BY query_id)""".strip()


@query(
    "SELECT " + ", ".join(f"round(avg(CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy_at_{k}, round(avg(h{k}::DOUBLE / {k}), 6) AS precision_at_{k}, round(avg(h{k}::DOUBLE / n), 6) AS recall_at_{k}" for k in (5, 10, 20))
    + ", round(avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(n, 20) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))), 6) AS ndcg, round(avg(ap / least(n, 20)), 6) AS map FROM rel JOIN each USING (query_id)",
    ("v_query_vecs", "v_scenes"),
    _DEEP,
)
def a25_scene_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevant scenes of a query are all scenes of its movie."""
    q, s = views.query_vectors(spark, sf_dir), views.scenes(spark, sf_dir)
    top = nearest.block_top_k(q, s, 20).join(s.select(F.col("vec_id").alias("corpus_id"), "movie_id"), "corpus_id").join(q.select("query_id", "target_movie"), "query_id")
    relevant = q.join(s.groupBy(F.col("movie_id").alias("target_movie")).agg(F.count("*").alias("n")), "target_movie").select("query_id", "n")
    return measure.scene_retrieval(top.select("query_id", "rank", (F.col("movie_id") == F.col("target_movie")).alias("hit")), relevant)


_JUDGED = """
jud AS (SELECT d.source AS query_id, l.doc_id AS movie_key, CAST(l.quality + 1 - l.toxic AS DOUBLE) AS grade FROM labels l JOIN documents d USING (doc_id)),
lst AS (SELECT source AS query_id, doc_id AS movie_key, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
got AS (SELECT query_id, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg FROM lst LEFT JOIN jud USING (query_id, movie_key) WHERE rank <= 5 GROUP BY query_id),
ide AS (SELECT query_id, sum(grade / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, movie_key) AS place FROM jud) WHERE place <= 5 GROUP BY query_id),
nd AS (SELECT query_id, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0::DOUBLE END AS ndcg FROM got LEFT JOIN ide USING (query_id))""".strip()


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = views.table(spark, sf_dir, "documents")
    grades = views.table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    results = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("movie_key"), rank.alias("rank"))
    return results, grades.select(F.col("source").alias("query_id"), F.col("doc_id").alias("movie_key"), (F.col("quality") + 1 - F.col("toxic")).cast("double").alias("grade"))


@query("SELECT query_id, round(ndcg, 6) AS ndcg FROM nd", (), _JUDGED)
def a19_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of a source as its results, graded by their labels."""
    return measure.ndcg(*_judged(spark, sf_dir)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("SELECT round(avg(ndcg), 4) AS ndcg, count(*) AS queries FROM nd", (), _JUDGED)
def a20_mean_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.ndcg(*_judged(spark, sf_dir)).agg(F.round(F.avg("ndcg"), 4).alias("ndcg"), F.count("*").alias("queries"))


_ANN = """
ann AS (SELECT user_id AS person_id, strftime(ts, '%Y-%m-%d') AS query_id, event_type AS engine, hour(ts) + 1 AS rank, concat('movie_', user_id % 12) AS movie_key, CAST(event_id % 3 AS DOUBLE) AS grade FROM events),
mg AS (SELECT query_id, engine, movie_key, avg(grade) AS grade, min(rank) AS rank FROM ann GROUP BY ALL),
lists AS (SELECT query_id, engine, list(grade ORDER BY rank, movie_key) AS g, list(grade ORDER BY grade DESC) AS i FROM mg GROUP BY ALL),
dcgs AS (SELECT query_id, engine, list_sum(list_transform(g[1:5], lambda x, n: x / log2(n + 1))) AS dcg, list_sum(list_transform(i[1:5], lambda x, n: x / log2(n + 1))) AS ideal FROM lists),
nd AS (SELECT query_id, engine, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0::DOUBLE END AS ndcg FROM dcgs),
items AS (SELECT engine, query_id, movie_key, count(*) AS n, sum(grade) AS s, sum(grade * grade) AS q FROM ann GROUP BY ALL)""".strip()


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as grades: a user rates the movie that the user belongs to, for the query of the day and the engine of its type."""
    e = views.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("person_id"), F.date_format("ts", "yyyy-MM-dd").alias("query_id"), F.col("event_type").alias("engine"), (F.hour("ts") + 1).alias("rank"), F.concat(F.lit("movie_"), F.col("user_id") % 12).alias("movie_key"), (F.col("event_id") % 3).cast("double").alias("grade"))


@query("SELECT query_id, engine, movie_key, round(grade, 6) AS grade, CAST(rank AS INTEGER) AS rank FROM mg", (), _ANN)
def a22_mean_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.mean_grades(annotations(spark, sf_dir)).withColumn("grade", F.round("grade", 6))


@query("SELECT query_id, engine, round(ndcg, 6) AS ndcg FROM nd", (), _ANN)
def a21_ndcg_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.ndcg_retrieved(measure.mean_grades(annotations(spark, sf_dir))).select("query_id", "engine", F.round("ndcg", 6).alias("ndcg"))


@query("SELECT engine, queries, raters, round(ndcg, 6) AS ndcg FROM (SELECT engine, count(DISTINCT query_id) AS queries, count(DISTINCT person_id) AS raters FROM ann GROUP BY engine) JOIN (SELECT engine, avg(ndcg) AS ndcg FROM nd GROUP BY engine) USING (engine)", (), _ANN)
def a24_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.engines(annotations(spark, sf_dir)).withColumn("ndcg", F.round("ndcg", 6))


@query("SELECT engine, round(1 - d / pairs / (2 * (n * q - s * s) / (n * (n - 1))), 6) AS alpha FROM (SELECT engine, sum(n)::DOUBLE AS n, sum(s) AS s, sum(q) AS q, sum(n * q - s * s) AS d, sum(n * (n - 1) / 2.0::DOUBLE) AS pairs FROM items GROUP BY engine)", (), _ANN)
def a23_interval_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.interval_alpha(annotations(spark, sf_dir)).select("engine", F.round("alpha", 6).alias("alpha"))


# --- titles ----------------------------------------------------------------------------------------------------------

_META = "meta AS (SELECT concat('part', p_partkey) AS key, p_name AS name, concat('The ', p_name) AS title, replace(p_name, ' ', '-') AS file_name FROM part)"
_ALIAS = (
    _META
    + r""",
n AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n0, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t0, regexp_replace(lower(file_name), '[^a-z0-9]', '', 'g') AS f0, regexp_replace(lower(trim(regexp_replace(name, ',?\s+(the|a|an)$', '', 'i'))), '[^a-z0-9]', '', 'g') AS n1, regexp_replace(lower(trim(regexp_replace(title, ',?\s+(the|a|an)$', '', 'i'))), '[^a-z0-9]', '', 'g') AS t1 FROM meta),
al AS (SELECT DISTINCT key, unnest([key, n0, t0, f0, n1, t1, concat('the', n0), concat('a', n0), concat('an', n0), concat('the', t0), concat('a', t0), concat('an', t0)]) AS alias FROM n),
look AS (SELECT alias, arg_min(key, concat(CASE WHEN key = alias THEN '0' ELSE '1' END, lpad(CAST(length(key) AS VARCHAR), 6, '0'), key)) AS key, count(*) > 1 AS conflict FROM al WHERE alias <> '' GROUP BY alias)"""
)


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return views.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("key"), name.alias("name"), F.concat(F.lit("The "), name).alias("title"), F.replace(name, F.lit(" "), F.lit("-")).alias("file_name"))


@query("SELECT alias, key, conflict FROM look", (), _ALIAS)
def f16_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.build(_movies(spark, sf_dir))


@query("SELECT p.p_partkey, look.key AS movie_key FROM part p LEFT JOIN look ON regexp_replace(lower(concat('A ', p.p_name)), '[^a-z0-9]', '', 'g') = look.alias", (), _ALIAS)
def f17_normalized_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("A "), "p_name").alias("title"))
    return lookup.normalized(asked, lookup.build(_movies(spark, sf_dir))).select("p_partkey", "movie_key")


@query("SELECT c.c_custkey, regexp_replace(regexp_replace(lower(c.c_name), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS movie_id FROM customer c UNION ALL SELECT -p.p_partkey, (SELECT min(m.key) FROM meta m WHERE regexp_replace(lower(m.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(p.p_name), '[^a-z0-9]', '', 'g')) FROM part p", (), _META)
def f18_id_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title")).unionByName(views.table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("c_custkey"), F.col("p_name").alias("title")))
    return lookup.id_from_title(asked, _movies(spark, sf_dir)).select("c_custkey", "movie_id")


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
_LEAK = f"""
asked AS (SELECT doc_id AS query_id, text AS query, concat('The ', source, ' of ', lang) AS movie_title FROM documents),
names AS (SELECT DISTINCT source AS title FROM documents UNION SELECT DISTINCT lower(r_name) FROM region UNION SELECT DISTINCT lower(n_name) FROM nation),
ttl AS (SELECT DISTINCT lower(title) AS title FROM names WHERE length(title) >= 3 AND NOT list_contains({_in(L.EVERYDAY)}, lower(title))),
qw AS (SELECT query_id, lower(query) AS q, lower(movie_title) AS own, {_WORDS.format('query')} AS w, {_WORDS.format('movie_title')} AS tw FROM asked),
oth AS (SELECT query_id, list_sort(list(title)) AS others FROM qw JOIN ttl ON title <> own AND contains(q, title) AND regexp_matches(concat(' ', q, ' '), concat('[^\\p{{L}}\\p{{N}}\\p{{M}}_]', regexp_escape(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]')) GROUP BY query_id),
chk AS (SELECT query_id, contains(q, own) AS direct, len(list_filter(w, lambda x: length(x) > 2 AND list_contains(tw, x) AND NOT list_contains({_in(L.EVERYDAY)}, x))) AS partial, coalesce(len(others), 0) AS others FROM qw LEFT JOIN oth USING (query_id)),
lk AS (SELECT *, round(CASE WHEN direct THEN 1.0::DOUBLE WHEN partial > 0 THEN least(0.8::DOUBLE, partial * 0.3::DOUBLE) WHEN others > 0 THEN least(0.6::DOUBLE, others * 0.2::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS leakage_score FROM chk)""".strip()


def _leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("The "), "source", F.lit(" of "), "lang").alias("movie_title"))
    names = d.select(F.col("source").alias("name")).union(views.table(spark, sf_dir, "region").select("r_name")).union(views.table(spark, sf_dir, "nation").select("n_name"))
    return leakage.check(asked, leakage.forbidden_titles(names))


@query("SELECT query_id, direct, CAST(partial AS INTEGER) AS partial, CAST(others AS INTEGER) AS others, leakage_score, leakage_score >= 0.5 AS has_leakage FROM lk", (), _LEAK)
def f6_lexical_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leak(spark, sf_dir).select("query_id", "direct", F.size("partial").alias("partial"), F.size("others").alias("others"), "leakage_score", "has_leakage")


@query("SELECT count(*) AS total, CAST(sum(CASE WHEN leakage_score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, CAST(sum(CASE WHEN leakage_score >= 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS passed, round(avg(leakage_score), 6) AS avg_leakage_score FROM lk", (), _LEAK)
def a27_leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(_leak(spark, sf_dir))


@query("SELECT title FROM ttl", (), _LEAK)
def f7_forbidden_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    names = d.select(F.col("source").alias("name")).union(views.table(spark, sf_dir, "region").select("r_name")).union(views.table(spark, sf_dir, "nation").select("n_name"))
    return leakage.forbidden_titles(names).select("title")


def _leaks_sql(q: str, t: str) -> str:
    words = rf"list_filter(regexp_split_to_array(trim(regexp_replace(lower({t}), '[^a-z0-9\s]', '', 'g')), '\s+'), lambda w: w <> '' AND NOT list_contains({_in(LEAK_STOPS)}, w))"
    return rf"coalesce(len(list_filter({words}, lambda w: contains(regexp_replace(lower({q}), '[^a-z0-9\s]', '', 'g'), w))) / CAST(nullif(len({words}), 0) AS DOUBLE) > 0.5, false)"


@query(f"SELECT doc_id, {_leaks_sql('text', 'source')} AS leaks FROM documents")
def f5_title_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", L.leaks_title(F.col("text"), F.col("source")).alias("leaks"))


# --- token functions -------------------------------------------------------------------------------------------------

_QTOK = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda w: NOT list_contains({_in(QUERY_STOPS)}, w))"


@query(f"SELECT doc_id, CAST(len({_tokens('text', RETRIEVAL_STOPS)}) AS INTEGER) AS tokens, array_to_string({_tokens('text', RETRIEVAL_STOPS)}, ' ') AS listed FROM documents")
def f1_retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", text.retrieval_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("tokens"), F.array_join("t", " ").alias("listed"))


@query(f"SELECT doc_id, array_to_string({_QTOK.format('text')}, ' ') AS key FROM documents")
def f2_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text")).alias("key"))


_PREV = f"j AS (SELECT doc_id, list_distinct({_QTOK.format('text')}) AS a, lag(list_distinct({_QTOK.format('text')})) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents)"


@query("SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS similarity FROM j WHERE b IS NOT NULL", (), _PREV)
def f3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it in its source."""
    t = text.content_tokens(F.col("text"))
    # the order of a source is found from ids alone and the words meet by row, so that no task holds the words of a source
    d = stored(views.table(spark, sf_dir, "documents").select("doc_id", "source", F.array_distinct(t).alias("a"), F.monotonically_increasing_id().alias("row")), "words")
    before = F.lag("row").over(Window.partitionBy("source").orderBy("doc_id", "row"))
    linked = d.select("row", before.alias("last")).where("last IS NOT NULL")
    d = d.join(linked, "row").join(d.select(F.col("row").alias("last"), F.col("a").alias("b")), "last")
    return d.where("b IS NOT NULL").select("doc_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def f4_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", text.alnum_key(F.col("p_name")).alias("key"))


@query("SELECT doc_id, substr(text, 1, 200) AS overview, replace(source, '-', ' ') AS title FROM documents")
def f19_overview_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring("text", 1, 200).alias("overview"), F.replace("source", F.lit("-"), F.lit(" ")).alias("title"))


# --- cleaning --------------------------------------------------------------------------------------------------------

_SCORE = f"""
c AS (SELECT conv_id * 1000 + turn AS row_id, text AS q, lower(text) AS l, concat('Movie ', conv_id % 20) AS title, CASE WHEN role = 'user' THEN 'synopsis' ELSE 'scene_summary' END AS kind FROM conversations),
w AS (SELECT *, len(regexp_extract_all(q, '[^ \\t\\n\\r\\f]+')) AS words, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS s FROM c),
f AS (SELECT row_id, [CASE WHEN regexp_matches(l, '^(?:\\{{|query:)|"query":') THEN 'json_wrapper_artifact' END,
 CASE WHEN s = '' OR length(s) - length(replace(s, '{{', '')) <> length(s) - length(replace(s, '}}', '')) OR (length(s) - length(replace(s, '"', ''))) % 2 = 1 OR regexp_matches(s, '\\\\[ntr]') OR list_contains({_in(R.UNFINISHED)}, regexp_extract(lower(s), '([a-z]+)[^a-z]*$', 1)) OR regexp_matches(s, '(?:\\.\\.\\.|…)$') THEN 'likely_truncated' END,
 CASE WHEN kind = 'synopsis' AND regexp_matches(l, '^(?:{'|'.join(R.META_PREFIXES)})') THEN 'banned_synopsis_prefix' END,
 CASE WHEN {_leaks_sql('q', 'title')} THEN 'title_leakage' END,
 CASE WHEN len(list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))) > 1 THEN 'character_name_leakage' END,
 CASE WHEN regexp_matches(l, '{'|'.join(R.VAGUE)}') AND NOT regexp_matches(l, '{'|'.join(R.EVENTS)}') THEN 'generic_low_information' END,
 CASE WHEN words < 7 THEN 'soft_too_short' END,
 CASE WHEN words > CASE WHEN kind = 'scene_summary' THEN 35 ELSE 28 END THEN 'too_long' END,
 CASE WHEN length(q) - length(replace(q, ',', '')) + length(q) - length(replace(q, ';', '')) + (length(q) - length(replace(q, ' and ', ''))) // 5 >= 3 THEN 'overstuffed_clauses' END,
 CASE WHEN regexp_matches(l, '{'|'.join(R.ABSTRACT)}') THEN 'abstract_theme_wording' END,
 CASE WHEN len({_QTOK.format('q')}) < 4 THEN 'low_content_density' END,
 CASE WHEN regexp_matches(l, '^(?:what happens when |why does )') THEN 'question_meta_style' END] AS flags FROM w)""".strip()
_COSTS = "map(['json_wrapper_artifact','likely_truncated','banned_synopsis_prefix','title_leakage','character_name_leakage','generic_low_information','soft_too_short','too_long','overstuffed_clauses','abstract_theme_wording','low_content_density','question_meta_style'], CAST([0.6,0.45,0.25,0.2,0.2,0.2,0.15,0.15,0.15,0.1,0.1,0.1] AS DOUBLE[]))"


@query(f"SELECT row_id, array_to_string(list_filter(flags, lambda x: x IS NOT NULL), ',') AS flags, greatest(0.0::DOUBLE, round(1 - coalesce(list_sum(list_transform(list_filter(flags, lambda x: x IS NOT NULL), lambda x: {_COSTS}[x])), 0.0::DOUBLE), 4)) AS score FROM f", (), _SCORE)
def f10_query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a query."""
    c = views.table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("cleaned_query"), F.concat(F.lit("Movie "), F.col("conv_id") % 20).alias("movie_title"), F.when(F.col("role") == "user", "synopsis").otherwise("scene_summary").alias("query_type"))
    return clean.scored(rows).select("row_id", F.array_join("quality_flags", ",").alias("flags"), F.col("quality_score").alias("score"))


@query()
def f8_repaired_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON parsing and salvage have no ANSI form; the tests compare with a brute-force version."""
    r = clean.repaired(views.raw_queries(spark, sf_dir))
    return r.select("row_id", "cleaned_query", "repair_method", F.array_join("repair_flags", ",").alias("flags"), "structural_reason")


@query()
def m7_cleaned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = clean.cleaned(views.raw_queries(spark, sf_dir))
    return r.select("row_id", "action", "cleaned_query", "quality_score", "reject_reason", "duplicate")


@query()
def m8_greedy_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as queries of their source; longer ones come first."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    return clean.greedy_survivors(d, ["source"], [(-F.col("n_chars")).alias("s")], "text", "doc_id")


@query()
def a26_cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.report(clean.cleaned(views.raw_queries(spark, sf_dir)))


@query("SELECT row_id, regexp_replace(regexp_replace(replace(query, chr(10), ' '), '^```(json)? ', ''), ' ```$', '') AS bare FROM v_raw_queries", ("v_raw_queries",))
def f15_without_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raw_queries(spark, sf_dir)
    return r.select("row_id", F.replace(text.strip_fences(F.col("query")), F.lit("\n"), F.lit(" ")).alias("bare"))
