"""Does a query give its movie's title away? Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEAK_STOPS, strip

THRESHOLDS = {"low": 0.8, "medium": 0.5, "high": 0.3}
#: Titles that are everyday words say nothing when they occur in a query.
EVERYDAY = sorted(
    "the and but for are can did has had how let may not our own say see too use war who why you bit cut end eye far few got hit hot job joy key law lie low man map mix net pay put ran run sad set sin sit sun tax tea tie top try van win yet"
    " a an as at be by do go he if in is it me my no of on or so to up us we all any bad big day her him new now off old one out red she six ten two way yes down over they them under".split()
)


def title_words(title: Column) -> Column:
    plain = strip(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""))
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(LEAK_STOPS))


def leaks_title(query: Column, title: Column) -> Column:
    """More than half of the title's telling words occur in the query, also inside other words."""
    return leaks_words(query, title_words(title))


def leaks_words(query: Column, words: Column) -> Column:
    """The same for the title's telling words."""
    plain = strip(F.regexp_replace(F.lower(query), r"[^a-z0-9\s]", ""))
    found = F.size(F.filter(words, lambda w: F.contains(plain, w)))
    return F.when(F.size(words) == 0, F.lit(False)).otherwise(found / F.size(words) > 0.5)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def named_in_title(query: Column, title: Column) -> Column:
    """The query's words of three letters or more that the title has too, in order, repeats included."""
    of_title = word_tokens(title)
    return F.filter(word_tokens(query), lambda w: (F.length(w) > 2) & ~w.isin(EVERYDAY) & F.array_contains(of_title, w))


def leakage_score(direct: Column, partial: Column, others: Column) -> Column:
    """direct: bool; partial and others: arrays of matches. An empty title counts as named directly."""
    return F.when(direct, F.lit(1.0)).when(F.size(partial) > 0, F.least(F.lit(0.8), F.size(partial) * F.lit(0.3))).when(F.size(others) > 0, F.least(F.lit(0.6), F.size(others) * F.lit(0.2))).otherwise(F.lit(0.0))


def leakage_reason(direct: Column, partial: Column, others: Column) -> Column:
    return (
        F.when(direct, "the title itself")
        .when(F.size(partial) > 0, F.concat(F.lit("words of the title: "), F.array_join(partial, ", ")))
        .when(F.size(others) > 0, F.concat(F.lit("other titles: "), F.array_join(others, ", ")))
        .otherwise("none")
    )
