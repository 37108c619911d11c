"""Record types and fixed values shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.FloatType())

CATALOG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("input_schema", T.StringType()),
        T.StructField("triggers", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("examples", STRINGS),
        T.StructField("endpoint", T.StringType()),
        T.StructField("search_text", T.StringType()),
        T.StructField("boost_keywords", T.StringType()),
        T.StructField("usage_count", T.LongType()),
        T.StructField("success_rate", T.DoubleType()),
        T.StructField("consecutive_failures", T.LongType()),
        T.StructField("last_used_at", T.TimestampType()),
        T.StructField("embedding", VECTOR),
        T.StructField("registered_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# What a caller may give for one entry; every field but the name is optional.
RAW_ENTRY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("plugin_name", T.StringType()),
        T.StructField("input_schema", T.StringType()),
        T.StructField("triggers", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("examples", STRINGS),
        T.StructField("endpoint", T.StringType()),
        T.StructField("boost_keywords", T.StringType()),
        T.StructField("usage_count", T.LongType()),
        T.StructField("success_rate", T.DoubleType()),
        T.StructField("last_used_at", T.TimestampType()),
        T.StructField("embedding", VECTOR),
        T.StructField("registered_at", T.TimestampType()),
    ]
)

ISSUE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)

# ---- Fixed values: results depend on them, so they are stated as they must be. ----

# BM25
K1 = 1.2
B = 0.75

# Stage weights and bonuses
TRIGGER_WEIGHT = 3.0
KEYWORD_WEIGHT = 1.0
SEMANTIC_WEIGHT = 2.0
USAGE_WEIGHT = 0.5
RECENCY_DAYS = 30.0

# Result limits
TOP_K = 5
THRESHOLD = 0.1
VECTOR_TOP_K = 20
VECTOR_CATEGORIES = 4

# Dispatch
CONFIDENCE = 2.0
MAX_FALLBACK = 3
ALTERNATIVES = 3

# Explorer slot
EXPLORER_PERCENT = 5
EXPLORER_MIN_RESULTS = 2

# Learning
EMA_ALPHA = 0.1

# Circuit breaker
FAILURE_THRESHOLD = 3
RECOVERY_SECONDS = 60.0

# Text limits
RESULT_CHARS = 4000
ERROR_CHARS = 50
TRUNCATION_MARK = "\n... (truncated)"

# Validation
NAME_PATTERN = r"^[a-z]+_[a-z][a-z0-9_]*\z"
MIN_DESCRIPTION = 10
CATEGORIES = ("web", "data", "file", "dev", "ai", "capture", "misc")

# Category inference: the first rule with a fragment inside the lower-cased name wins.
CATEGORY_RULES = (
    ("capture", ("screenshot", "capture", "record")),
    ("web", ("scroll", "tab", "read_page", "navigate")),
    ("data", ("extract", "scrape", "parse")),
    ("ai", ("search", "ai", "query")),
    ("file", ("file", "write", "read")),
    ("dev", ("code", "compile", "lint")),
)

# Token separators
TOKEN_SPLIT = r"[\s_\-./]+"

# Source weights a deployment may pass to `route`
DEFAULT_SOURCE_WEIGHTS = {"mcp": 1.2, "plugin": 1.0, "local": 0.8}
