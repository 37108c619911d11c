from signpost.functions.jsons import parse_json_or_default, schema_arg_keys
from signpost.functions.scoring import (
    cosine_similarity,
    recency_factor,
    round_half_up,
    source_weight,
    success_bonus,
    usage_bonus,
)
from signpost.functions.text import (
    boost_keywords,
    doc_tokens,
    extract_triggers,
    infer_category,
    query_terms,
    query_words,
    search_text,
    truncate_text,
)

__all__ = [
    "boost_keywords",
    "cosine_similarity",
    "doc_tokens",
    "extract_triggers",
    "infer_category",
    "parse_json_or_default",
    "query_terms",
    "query_words",
    "recency_factor",
    "round_half_up",
    "schema_arg_keys",
    "search_text",
    "source_weight",
    "success_bonus",
    "truncate_text",
    "usage_bonus",
]
