from __future__ import annotations

import time

import pytest

from vignette.llm import htmlcut


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>t</title><body><p>Article</p></body></html>", ["Article"]),
        ("<html><head><title>a <p> b</title><meta charset=x><p>Article</p>", ["Article"]),
        ("<head><title>t<body><p>Article</p>", ["Article"]),
        ("<head><title>t</title>Article", ["Article"]),
        ("<head><style>p {}</style><noscript><link href=x></head><body><p>Article</p>", ["Article"]),
        ("<head><title>t</title><script>var a = '<p>no</p>'</script></head><body>Article", ["Article"]),
        ("<div>a<noscript>no<p>no</p></div><p>Article</p>", ["a", "Article"]),
        ("<p><span>a<template>no</span> b</p><p>Article</p>", ["a b", "Article"]),
        ("<div><svg><text>no</text></div><p>Article</p>", ["Article"]),
        ("<svg><text>no</text><p>Article</p>", ["Article"]),
        ("<svg/><p>Article</p>", ["Article"]),
        ("<div>a<template><div>no<template>no</template></div>no</template> b</div>", ["a b"]),
        ("<div>a<noscript><p>no</p></noscript> b</div>", ["a b"]),
    ],
)
def test_unclosed_elements_lose_no_text(html, want):
    assert [b.text for b in htmlcut.blocks(html)] == want


@pytest.mark.parametrize("unit", ['<a b="x> t ', "<div>x", "<a ", "<a \"'\" ", "<title <b '", "<template>", "</ul><ul>"])
@pytest.mark.parametrize("end", ["", "'", ">", "</ul>"])
def test_hostile_pages_take_linear_time(unit, end):
    def seconds(n):
        page = unit * n + end * n
        began = time.process_time()
        htmlcut.extract(page, htmlcut.PRIOR)
        return time.process_time() - began

    seconds(500)
    assert min(seconds(16_000) for _ in range(2)) < 0.05 + 9 * max(seconds(4_000) for _ in range(3))  # squares would be 16


def test_tags_without_an_end_are_text():
    assert [b.text for b in htmlcut.blocks('<p>one</p><a href="x>two</p><p>three')] == ["one", '<a href="x>two', "three"]
    assert [b.text for b in htmlcut.blocks("<p>a <b x='1'>b</b> < c</p>d <")] == ["a b < c", "d <"]
    deep = htmlcut.blocks("<div>x" * 3000 + "</div>" * 3000 + "<p>y")
    assert len(deep) == 3001 and deep[2999].depth == 3000 and deep[3000].depth == 0
    assert htmlcut.edges(deep)[-1][:2] == (2999, 3000)
