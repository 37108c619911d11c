"""Column expressions over text: tokens, search text, triggers, categories, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost import schema as S


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_space(c: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def doc_tokens(text: Column) -> Column:
    """Tokens of a catalog entry: at least two characters."""
    return F.filter(F.split(F.lower(text), S.TOKEN_SPLIT), lambda t: F.length(t) > 1)


def query_terms(text: Column) -> Column:
    """Terms of a query: at least three characters, repeats kept."""
    return F.filter(F.split(F.lower(text), S.TOKEN_SPLIT), lambda t: F.length(t) > 2)


def query_words(text: Column) -> Column:
    """Words of a query split on white space alone, as triggers see them; repeats kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 1)


def search_text(
    name: Column,
    description: Column,
    category: Column,
    provider: Column,
    boost_keywords: Column,
    triggers: Column,
    tags: Column,
    examples: Column,
) -> Column:
    """Lower-cased text BM25 and the embedder read; boost keywords count twice."""
    boost = blank_to_null(boost_keywords)
    lists = [blank_to_null(F.array_join(c, " ")) for c in (triggers, tags, examples)]
    fields = [blank_to_null(c) for c in (name, description, category, provider)]
    return F.lower(F.concat_ws(" ", *fields, boost, boost, *lists))


def extract_triggers(name: Column, description: Column, tags: Column) -> Column:
    """Name, its parts, the first description word and the longer tags, first seen first."""
    parts = F.split(name, r"[_\-.]")
    first_word = F.lower(F.regexp_extract(description, r"(\S+)", 1))
    nothing = F.array().cast(S.STRINGS)
    every = F.concat(
        F.when(F.length(name) > 0, F.array(name)).otherwise(nothing),
        F.when(F.size(parts) > 1, parts).otherwise(nothing),
        F.when(F.length(first_word) > 2, F.array(first_word)).otherwise(nothing),
        F.coalesce(F.filter(tags, lambda t: F.length(t) > 2), nothing),
    )
    return F.array_distinct(F.filter(every, lambda t: F.length(t) > 1))


def infer_category(name: Column, source: str = "unknown") -> Column:
    lower = F.lower(F.coalesce(name, F.lit("")))
    result = None
    for category, fragments in S.CATEGORY_RULES:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | lower.contains(fragment)
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise("mcp" if source == "mcp" else "misc")


def boost_keywords(name: Column, description: Column) -> Column:
    """Up to ten search words drawn from a listed name and its first sentence."""
    spaced = F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")
    spaced = F.lower(F.regexp_replace(spaced, r"[_\-.]", " "))
    name_words = F.filter(F.split(spaced, r"\s+"), lambda w: F.length(w) > 2)
    sentence = F.split(F.coalesce(description, F.lit("")), r"[.!?]").getItem(0)
    text_words = F.filter(F.split(F.lower(sentence), r"\s+"), lambda w: F.length(w) > 3)
    words = F.array_distinct(F.concat(name_words, F.slice(text_words, 1, 5)))
    return F.array_join(F.slice(words, 1, 10), " ")


def truncate_text(text: Column, limit: int = S.RESULT_CHARS, mark: str = S.TRUNCATION_MARK) -> Column:
    """Cut to `limit` characters and mark the cut; pass mark='' for a silent cut."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(mark))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; empty for shorter text."""
    windows = F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))
    )
    return F.when(F.length(text) >= n, F.array_distinct(windows)).otherwise(F.array().cast(S.STRINGS))
