"""Text, JSON-response and hash-embedding columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import col

# Fixed patterns: fenced json, fenced without a tag, bare object; tried in this order.
RESPONSE_PATTERNS = (
    r"(?s)```json\s*(\{.*?\})\s*```",
    r"(?s)```\s*(\{.*?\})\s*```",
    r"(?s)(\{.*\})",
)


def token_estimate(text: Column | str) -> Column:
    """int(words * 1.3), words being whitespace-separated."""
    words = F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))
    return F.floor(words * F.lit(1.3)).cast("long")


def hash_embedding(text: Column | str, dims: int = 128) -> Column:
    """md5 bytes scaled to [0, 1] and repeated up to ``dims`` entries."""
    digest = F.md5(col(text).cast("binary"))
    bytes_ = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0,
    )
    return F.slice(F.flatten(F.array_repeat(bytes_, -(-dims // 16))), 1, dims)


def mended_json(text: Column) -> Column:
    """From the first brace on: commas before a closing bracket dropped, missing closing braces added."""
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*", 0), r",\s*([}\]])", "$1")
    body = F.regexp_replace(body, r"(?s)[\s,`]+$", "")
    missing = F.regexp_count(body, F.lit(r"\{")) - F.regexp_count(body, F.lit(r"\}"))
    return F.nullif(F.concat(body, F.repeat(F.lit("}"), F.greatest(missing, F.lit(0)))), F.lit(""))


def response_json(text: Column | str) -> Column:
    """First candidate object in a model response that is valid JSON, the mended text last, else NULL."""
    found = [F.nullif(F.regexp_extract(col(text), pattern, 1), F.lit("")) for pattern in RESPONSE_PATTERNS]
    candidates = [*found, *(mended_json(x) for x in (found[-1], col(text)))]
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull(), x) for x in candidates))
