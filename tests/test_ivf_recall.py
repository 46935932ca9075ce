from __future__ import annotations

import pytest

from vignette.operators import index, nearest
from vignette.queries import search
from vignette.sources import views


def test_registered_query_finds_the_exact_neighbours(spark):
    """The query itself is left out on both sides."""
    folder = "/root/testdata/sf0.01"
    exact = nearest.block_top_k(views.query_vectors(spark, folder), views.table(spark, folder, "embeddings"), 10)
    want = {(r["query_id"], r["corpus_id"]) for r in exact.collect() if r["query_id"] != r["corpus_id"]}
    got = {(r["query_id"], r["id"]) for r in search.v17_ivf_search(spark, folder).collect()}
    assert len(want & got) / len(want) >= 0.9


@pytest.mark.parametrize(("target", "want"), [(0.5, 1), (1.0, 2)])
def test_probes_go_up_to_all_lists(spark, target, want):
    placed = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.8, 0.6], 0), (3, [0.6, -0.8], 1)], "id bigint, v array<double>, list int")
    centroids = spark.createDataFrame([(0, [0.9, 0.3]), (1, [0.6, -0.8])], "list int, c array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, q array<float>")
    assert index.probes_needed((placed, centroids), q, 3, target) == want
    assert index.probes_needed((placed, centroids), q.limit(0), 3, target) == 1
