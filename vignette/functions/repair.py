"""Generated queries: what a model wrapped around them comes off, and what is left gets a score. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .leakage import leaks_title
from .text import content_tokens, occurrences, squeeze, straight_quotes, strip, strip_fences, word_count

MIN_WORDS, SOFT_MIN_WORDS = 5, 7
MAX_WORDS = {"scene_summary": 35, "synopsis": 28}
KEEP_FROM = {"scene_summary": 0.75, "synopsis": 0.85}
UNFINISHED = sorted("after and because before but from into or than then when where which while who whose with".split())
META_PREFIXES = ("a film about", "a movie where", "film scenes", "looking for", "scenes of")
VAGUE = ("a couple", "a family", "a group", "a man", "a woman", "friends", "somebody", "someone")
EVENTS = sorted("abuse|accident|affair|arrest|arrested|betrayal|betrays|blackmail|confesses|confession|confrontation|confronts|courtroom|death reveal|discovers|discovery|double life|escape|escapes|fake illness|hostage|kidnapped|kidnapping|mistaken identity|murder|proposal|proposes|reunion|reunites|reveals|secret|seizure|testimony|trial".split("|"))
ABSTRACT = sorted("dynamics|explores|exploring|family dynamics|identity|redemption|relationship dynamic|strained family|theme|themes|unlikely allies".split("|"))


def any_of(text: Column, parts: tuple[str, ...] | list[str]) -> Column:
    """One regular expression instead of a scan per part."""
    return text.rlike("|".join(parts))


def tidy(text: Column) -> Column:
    return squeeze(straight_quotes(text))


def wrapped(text: Column) -> Column:
    return F.lower(text).rlike(r'^(?:\{|query:)|"query":')


def truncated(text: Column) -> Column:
    """Unbalanced braces or quotes, escapes left over, or an end that asks for more."""
    s = strip(text)
    last = F.regexp_extract(F.lower(s), "([a-z]+)[^a-z]*$", 1)
    return (s == "") | (occurrences(s, "{") != occurrences(s, "}")) | (occurrences(s, '"') % 2 == 1) | s.rlike(r"\\[ntr]") | last.isin(UNFINISHED) | s.rlike(r"(?:\.\.\.|…)$")


def _variant_text(v: Column, path: str) -> Column:
    """The string at path, null if there is none or it is of another type."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def unwrapped_json(text: Column) -> Column:
    """The query of a JSON object {"query": ...} or of a JSON string; null if it is neither, or marked to be skipped."""
    v = F.try_parse_json(text)
    skip = F.coalesce(F.try_variant_get(v, "$.skip", "string"), F.lit("false"))
    usable = F.coalesce(F.try_variant_get(v, "$.is_usable", "boolean"), F.lit(True))
    of_object = F.when(F.lower(skip).isin("false", "0", "") & usable, _variant_text(v, "$.query"))
    return tidy(F.coalesce(F.when(text.startswith("{"), of_object), F.when(text.startswith('"'), _variant_text(v, "$"))))


def salvaged_json(text: Column) -> Column:
    """What follows "query": " in broken JSON, up to the next quote, if it is a query of its own."""
    rest = F.regexp_extract(text, r'(?is)"query"\s*:\s*"(.*)$', 1)
    rest = F.replace(rest, F.lit('\\"'), F.lit('"'))
    part = F.when(rest.contains('"'), F.substring_index(rest, '"', 1)).otherwise(F.regexp_replace(rest, "[ ,}]+$", ""))
    c = tidy(part)
    fine = text.rlike(r'(?is)"query"\s*:\s*"') & (word_count(c) >= MIN_WORDS) & ~c.contains("{") & ~c.contains("}") & ~F.lower(c).contains('"query":')
    return F.when(fine, c)


def salvaged_list(raw: Column, keys: tuple[str, ...] = ("queries", "paraphrases", "items", "results")) -> Column:
    """The whole strings of a JSON array cut off somewhere: of the first of the keys that has one, or of a bare array.
    The patterns are possessive: a backtracking group would recurse once a character."""
    s = strip_fences(raw)
    starts = [F.when(s.rlike(rf'(?i)"{k}"\s*:\s*\['), F.regexp_extract(s, rf'(?is)"{k}"\s*:\s*\[(.*)$', 1)) for k in keys]
    body = F.coalesce(*starts, F.when(s.startswith("["), F.substring(s, 2, 2**31 - 1)))
    upto = F.regexp_extract(body, r'(?s)^((?:[^"\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)', 1)
    found = F.regexp_extract_all(upto, F.lit(r'(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), 1)
    plain = F.transform(found, lambda x: strip(F.regexp_replace(x, r"(?s)\\(.)", "$1")))
    return F.coalesce(F.filter(plain, lambda x: x != ""), F.array().cast("array<string>"))


def string_list(raw: Column, preferred: str | None = None) -> Column:
    """The strings of a reply: a JSON array, or an object with one under the preferred or a usual key; of broken JSON
    what is whole."""
    s = strip_fences(raw)
    v = F.try_parse_json(s)
    keys = tuple(dict.fromkeys([*([preferred] if preferred else []), "queries", "paraphrases", "items", "results"]))
    listed = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<string>") for k in keys], F.try_variant_get(v, "$", "array<string>"))
    clean = F.filter(F.transform(listed, strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(v.isNull(), salvaged_list(raw, keys)).otherwise(F.coalesce(clean, F.array().cast("array<string>")))


def scene_summary(raw: Column) -> Column:
    """The query of a reply about a scene: {"query", "skip"} as JSON, else plain text of up to 50 words; null if skipped."""
    s = strip_fences(raw)
    v = F.try_parse_json(s)
    skip = F.lower(F.coalesce(F.try_variant_get(v, "$.skip", "string"), F.lit("false")))
    told = strip(_variant_text(v, "$.query"))
    plain = strip(F.btrim(F.btrim(s, F.lit('"')), F.lit("'")))
    fallback = F.when((F.upper(plain) != "SKIP") & (plain != "") & (word_count(plain) <= 50), plain)
    return F.when(v.isNotNull() & s.startswith("{"), F.when(skip.isin("false", "0", "") & (told != ""), told)).otherwise(fallback)


def without_controls(raw: Column) -> Column:
    """A reply without its fence and without control characters that JSON forbids."""
    return F.regexp_replace(strip_fences(raw), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def names_character(query: Column, names: Column | None) -> Column:
    """Two capitalised words, or all parts of one of the scene's names."""
    capitals = F.regexp_count(query, F.lit(r"(?U)\b[A-Z][a-z]+\b")) > 1
    if names is None:
        return capitals
    q = F.lower(query)
    parts = lambda n: F.filter(F.regexp_extract_all(F.lower(n), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)
    return capitals | F.coalesce(F.exists(names, lambda n: (F.size(parts(n)) > 0) & F.forall(parts(n), lambda t: F.contains(q, t))), F.lit(False))


def faults(query: Column, title: Column, kind: Column, names: Column | None = None) -> list[tuple[str, float, Column]]:
    """(flag, penalty, condition) in the order in which flags are listed."""
    low = F.lower(query)
    words = word_count(query)
    most = F.when(kind == "scene_summary", MAX_WORDS["scene_summary"]).otherwise(MAX_WORDS["synopsis"])
    return [
        ("json_wrapper_artifact", 0.60, wrapped(query)),
        ("likely_truncated", 0.45, truncated(query)),
        ("banned_synopsis_prefix", 0.25, (kind == "synopsis") & low.rlike("^(?:" + "|".join(META_PREFIXES) + ")")),
        ("title_leakage", 0.20, leaks_title(query, title)),
        ("character_name_leakage", 0.20, names_character(query, names)),
        ("generic_low_information", 0.20, any_of(low, VAGUE) & ~any_of(low, EVENTS)),
        ("soft_too_short", 0.15, words < SOFT_MIN_WORDS),
        ("too_long", 0.15, words > most),
        ("overstuffed_clauses", 0.15, occurrences(query, ",") + occurrences(query, ";") + occurrences(query, " and ") >= 3),
        ("abstract_theme_wording", 0.10, any_of(low, ABSTRACT)),
        ("low_content_density", 0.10, F.size(content_tokens(query)) < 4),
        ("question_meta_style", 0.10, low.rlike("^(?:what happens when |why does )")),
    ]
