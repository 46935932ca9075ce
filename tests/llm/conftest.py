from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "The keeper of the lighthouse wrote down every ship that passed, and at night the lamp turned over a calm grey sea. "
GERMAN = "Der Wärter des alten Turmes schrieb jedes Schiff auf, das vorüberfuhr, und nachts drehte sich die Lampe über dem Meer. "
#: Columns whose names the operators might use themselves.
CLASHING = ["v", "id", "row", "keep", "rank", "node", "hi", "lo", "shared", "rows", "list", "tree", "total", "shard", "margin", "probability", "__masked", "count", "group_id", "is_kept"]


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, clashing: bool = False):
        full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
        df = spark.createDataFrame(full, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("other") for c in CLASHING})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, one-word, very long and repeated texts, a repeated id, ties."""
    import random

    rng = random.Random(2)
    words = [w for w in (PROSE + GERMAN).split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(120)
    return [(1, None, "en"), (2, "", "en"), (3, "word", None), (4, text(120_000), "en"), (5, same, "en"), (5, same, "en"), (6, same, None), (None, same, "de"), (None, None, None), (7, " \n\t ", "en"), (8, "é漢字🙂" * 3, "de"), (9, text(90), "de")]


def table(sf: str, name: str):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '/root/testdata/{sf}/{name}.parquet'").df()
