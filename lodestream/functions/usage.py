"""Token usage, cost and number formats (MTH5-11, PRJ6)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names under which a count may come, the first that is there wins (fixed values).
ALIASES = {
    "input": ("input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens"),
    "output": ("output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
    "cache_read": ("cacheRead", "cache_read", "cache_read_input_tokens", "cached_tokens", "prompt_tokens_details.cached_tokens"),
    "cache_write": ("cacheWrite", "cache_write", "cache_creation_input_tokens"),
    "total": ("total", "totalTokens", "total_tokens"),
}


def normalized(raw_json: Column) -> Column:
    """Struct of the five counts from JSON of any naming; a negative input is 0; null if none is there."""
    count = lambda names: F.coalesce(*[F.get_json_object(raw_json, f"$.{n}").try_cast("double") for n in names])
    found = {k: count(v) for k, v in ALIASES.items()}
    found["input"] = F.greatest(found["input"], F.when(found["input"].isNotNull(), F.lit(0.0)))
    return F.when(F.coalesce(*found.values()).isNotNull(), F.struct(*[v.alias(k) for k, v in found.items()]))


def prompt_tokens(input_: Column, cache_read: Column, cache_write: Column, override: Column | None = None) -> Column:
    """Input and cache tokens, null if not positive; a positive override wins. Not clamped to any context."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = zero(input_) + zero(cache_read) + zero(cache_write)
    own = F.when(total > 0, total)
    return own if override is None else F.when(override > 0, override).otherwise(own)


def cost(usage: dict[str, Column], price: dict[str, Column]) -> Column:
    """Sum of tokens times price, per million; null if a price is missing."""
    finite = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
    total = sum((finite(usage[k]) * price[k] for k in ("input", "output", "cache_read", "cache_write")), F.lit(0.0))
    return total / 1_000_000


def clamp_percent(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))


def backoff_ms(attempt: Column, initial: float, factor: float, most: float, jitter: Column) -> Column:
    """Exponential backoff; jitter is a share in [0, 1) that the caller draws."""
    return F.least(F.lit(most), F.floor(initial * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))) * (1 + jitter) + 0.5))


def _fixed(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def token_count(c: Column) -> Column:
    """950, 1.5k, 12k, 3.4m; null and negative counts are 0."""
    safe = F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)))
    million, thousand = F.concat(_fixed(safe / 1e6, 1), F.lit("m")), F.when(safe >= 10_000, _fixed(safe / 1e3, 0)).otherwise(_fixed(safe / 1e3, 1))
    return F.when((safe >= 1e6) | (safe >= 999_500), million).when(safe >= 1e3, F.concat(thousand, F.lit("k"))).otherwise(F.floor(safe + 0.5).cast("long").cast("string"))


def usd(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), F.concat(F.lit("$"), F.when(c >= 0.01, _fixed(c, 2)).otherwise(_fixed(c, 4))))


def window_label(hours: Column, reset_s: Column, primary_reset_s: Column) -> Column:
    """Week, Day or hours; a day whose reset lies three days or more after the primary one is a week."""
    gap = F.coalesce(reset_s - primary_reset_s >= 3 * 86_400, F.lit(False))
    return F.when(hours >= 168, "Week").when(hours < 24, F.concat(hours.cast("long").cast("string"), F.lit("h"))).when(gap, "Week").otherwise("Day")


def context_use(total: Column, context: Column) -> tuple[Column, Column]:
    """Tokens left, and per cent used (at most 999); null where a figure is missing."""
    known = total.isNotNull() & (context > 0)
    return F.when(known, F.greatest(F.lit(0.0), context - total)), F.when(known, F.least(F.lit(999.0), F.floor(100 * total / context + 0.5)))
