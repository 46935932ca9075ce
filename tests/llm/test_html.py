from __future__ import annotations

import itertools
import random

from compare import SMALL
from pyspark.sql import functions as F

from vignette.llm import htmlcut, queries


def cost(labels, gain, joined) -> float:
    return sum(-g if g < 0 and x else g if g > 0 and not x else 0 for x, g in zip(labels, gain)) + sum(c for a, b, c in joined if labels[a] != labels[b])


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 9)
        gain = [rng.choice([0.0, rng.uniform(-3, 3)]) for _ in range(n)]
        joined = [(a, b, rng.uniform(0.1, 1.5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        best = min(cost(x, gain, joined) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(htmlcut.cut(gain, joined), gain, joined) - best) < 1e-6


def test_query_equals_brute_force(spark):
    """Labels of every page against a slow maximum flow (augmenting paths over a matrix)."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = htmlcut.fit(pages)
    truth = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, SMALL).collect()}
    assert set(got) == set(truth)
    for i, html in truth.items():
        page = htmlcut.blocks(html)
        gain = (htmlcut.features(page) @ weights).clip(-6, 6).tolist()
        joined = htmlcut.edges(page)
        n = len(page)
        room = [dict() for _ in range(n + 2)]

        def add(a, b, c, room=room):
            room[a][b] = room[a].get(b, 0) + c
            room[b].setdefault(a, 0)

        for k, g in enumerate(gain):
            add(*((n, k, g) if g > 0 else (k, n + 1, -g)))
        for a, b, c in joined:
            add(a, b, c)
            add(b, a, c)
        while True:
            before, queue = {n: None}, [n]
            for u in queue:
                for v, c in room[u].items():
                    if c > 1e-9 and v not in before:
                        before[v] = u
                        queue.append(v)
            if n + 1 not in before:
                break
            path, v = [], n + 1
            while before[v] is not None:
                path.append((before[v], v))
                v = before[v]
            push = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= push
                room[b][a] += push
        labels = [k in before for k in range(n)]
        assert got[i]["content"] == "\n".join(b.text for b, x in zip(page, labels) if x)
        assert got[i]["content_blocks"] == sum(labels) and got[i]["blocks"] == n


def test_main_text_stays_and_menus_go(spark):
    para = "The harbour town had waited all winter for the first ship, and when it came the whole street ran down to see it land. "
    menu = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))
    html = f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><ul>{menu}</ul><div><h1>The first ship</h1><p>{para * 2}</p><p>{para}</p><p>{para * 3}</p></div><div><a href='/a'>Privacy</a> <a href='/b'>Terms</a> © 2024</div></body></html>"
    weights = htmlcut.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    content, n, kept = htmlcut.extract(html, weights)
    assert content.count("harbour town") == 6 and "Link 3" not in content and "Privacy" not in content and "var a" not in content and 0 < kept < n


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "no tags at all"), (4, "<div><p>open<b>cross</p></b>" * 4000), (5, "<"), (6, "<!-- open"), (None, "<p>x</p>"), (3, "no tags at all")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumns({"content": F.lit(1), "blocks": F.lit("x")})
    weights = htmlcut.fit(pages)
    got = htmlcut.contents(pages, weights).collect()
    assert len(got) == len(rows)
    told = {r["page_id"]: r for r in got}
    assert told[1]["content"] is None and told[1]["blocks"] == 0 and told[2]["content"] == "" and told[3]["blocks"] == 1
    assert htmlcut.contents(pages.limit(0), weights).count() == 0 and htmlcut.contents(pages.limit(0)).count() == 0
