"""Text expressions. Everything here is a Column built from Spark's own functions, so it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that carry no content in queries; RETRIEVAL_STOPS serves ranking, LEAK_STOPS title matching.
_SHARED = "a about an and are as at be been but by can could did do does for from had has have he his her how i if in into is it its may might no not of on or out shall should she so than that the their then they this to up was we were what when where which while who why will with would you after across before during over through under"
_RETRIEVAL = "a about an and are as at be been being but by can could did do does for from had has have he her his i if in into is it its may might my no not of on or our out s shall she should so t than that the their then they this to up was we were what when which who will with would you your"
QUERY_STOPS = sorted(_SHARED.split())
RETRIEVAL_STOPS = sorted(_RETRIEVAL.split())
LEAK_STOPS = sorted(set(_RETRIEVAL.split()) - set("being her his my our their your".split()))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs to one space, ends stripped."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "\u201c\u201d\u2018\u2019", "\"\"''")


def alnum_key(text: Column) -> Column:
    """Lower case, letters a-z and digits only: the key under which titles are compared."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "unknown").otherwise(made)


def is_noise_name(text: Column) -> Column:
    """True for null, empty and sign-only names; Unicode letters count as letters."""
    return is_noise_squeezed(squeeze(F.coalesce(text, F.lit(""))))


def is_noise_squeezed(name: Column) -> Column:
    """The same for a name that squeeze() has been through."""
    return (name == "") | name.rlike(r"(?U)^[\W_]+$")


def retrieval_words(text: Column) -> Column:
    """Lower-case a-z0-9 words between word boundaries."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z0-9]+)\b"), 1)


def retrieval_tokens(text: Column) -> Column:
    """Those words without stop words and single characters."""
    return F.filter(retrieval_words(text), lambda w: (F.length(w) > 1) & ~w.isin(RETRIEVAL_STOPS))


def content_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(QUERY_STOPS))


def content_key(text: Column) -> Column:
    return F.array_join(content_tokens(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def occurrences(text: Column, part: str) -> Column:
    """How often `part` stands in text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strip_fences(text: Column) -> Column:
    """Without a markdown fence around it; text that does not begin with one is only stripped."""
    s = strip(text)
    inner = F.regexp_replace(F.regexp_replace(s, r"^```(json)?(?U:\s*)", ""), r"(?U:\s*)```$", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)
