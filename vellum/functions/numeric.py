"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars per million input and output tokens. Other models are free.
PRICES = {"small": (0.15, 0.6), "medium": (1.0, 5.0), "large": (3.0, 15.0)}
PROMPT_CHARS, PROMPT_TOKENS = 4000, 200
OUTPUT_TOKENS = {"identify": 150, "suggest_tags": 200}


def ability_modifier(score: Column) -> Column:
    return F.floor((score - 10) / 2).cast("int")


def signed(value: Column) -> Column:
    return F.format_string("%+d", value)


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def estimate_tokens(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def estimate_cost(text: Column, model: str, task: str = "identify") -> Column:
    """Dollars for one call: the prompt holds the first characters of the text."""
    price_in, price_out = PRICES.get(model, (0.0, 0.0))
    used = estimate_tokens(F.least(F.length(text), F.lit(PROMPT_CHARS))) + PROMPT_TOKENS
    return (used * price_in + OUTPUT_TOKENS.get(task, 150) * price_out) / 1e6


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height == 0, 0.0).otherwise(F.round(width / height, 2))


def likely_map(width: Column, height: Column) -> Column:
    ratio = width / F.nullif(height, F.lit(0))
    return F.coalesce((width >= 200) & (height >= 200) & ratio.between(0.5, 3) & (width * height >= 100_000), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double arithmetic; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


def unit(v: Column) -> Column:
    """An array in double arithmetic, divided by its norm; of nulls where that is zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.nullif(norm, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 1))
