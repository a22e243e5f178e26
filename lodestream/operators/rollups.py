"""Usage rollups over message facts (AGG*, WIN1-3): one scan, partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The additive measures of a cost total.
MEASURES = ("input", "output", "cache_read", "cache_write", "total_tokens", "input_cost", "output_cost", "cache_read_cost", "cache_write_cost", "total_cost")


def totals(prefix: str = "") -> list[Column]:
    """Sums of the measures and the number of rows without a cost."""
    return [F.round(F.sum(F.coalesce(F.col(m), F.lit(0.0))), 4).alias(f"{prefix}{m}") for m in MEASURES] + [F.count_if(F.col("total_cost").isNull()).alias(f"{prefix}missing_cost")]


def rollup(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(*totals()) if by else facts.agg(*totals())


def bundle(facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row for each value of each dimension, in one scan: (dimension, value, n, total_tokens, total_cost)."""
    sets = facts.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("total_tokens"), 2).alias("total_tokens"), F.round(F.sum("total_cost"), 2).alias("total_cost"), F.grouping_id().alias("gid")
    )
    # bit i from the right is 0 for the dimension a row belongs to
    last = len(dimensions) - 1
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    full = (1 << len(dimensions)) - 1
    for i, d in enumerate(dimensions):
        own = F.col("gid") == full - (1 << (last - i))
        name, value = F.when(own, d).otherwise(name), F.when(own, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n", "total_tokens", "total_cost")


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Element floor(share * n) of each group's sorted values, counted from 0 and clamped: equal values are counted first, and only running counts of distinct values are windowed."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = F.greatest(F.lit(1), F.least(F.col("_all"), F.floor(F.col("_all") * share) + 1))
    return upto.filter((F.col("_upto") >= at) & (F.col("_upto") - F.col("_n") < at)).select(*by, F.col(value).alias("percentile"))


def latency(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    """count, avg, p95 (nearest rank), min, max."""
    basic = df.filter(F.col(ms).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ms), 4).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))
    return basic.join(nearest_rank(df, by, ms, 0.95).withColumnRenamed("percentile", "p95_ms"), by)


def merge_latency(partial: DataFrame, by: list[str]) -> DataFrame:
    """Partial latencies as one; p95 is the largest partial p95, which isn't the p95 of all. Averages have four decimals, so their sums are exact in decimals, whatever the order. Partials without a count are left out."""
    return partial.filter("n > 0").groupBy(*by).agg(
        F.sum("n").alias("n"), F.round(F.sum((F.col("avg_ms") * F.col("n")).cast("decimal(28,6)")).cast("double") / F.sum("n"), 4).alias("avg_ms"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.max("p95_ms").alias("p95_max_ms")
    )


def cumulative(points: DataFrame, by: str, order: list[str], measures: dict[str, str]) -> DataFrame:
    """Running sums, new name -> column."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({name: F.round(F.sum(c).over(w), 4) for name, c in measures.items()})


def range_totals(points: DataFrame, a_ms: int, b_ms: int, by: str) -> DataFrame:
    """Points between the two bounds, whichever comes first, inclusive; keys without a point have no row."""
    lo, hi = min(a_ms, b_ms), max(a_ms, b_ms)
    own = points.filter(F.col("ts_ms").between(lo, hi))
    return own.groupBy(by).agg(
        F.round(F.sum("total_tokens"), 4).alias("total_tokens"), F.round(F.sum("total_cost"), 4).alias("total_cost"), F.count_if(F.col("input") > 0).alias("user_messages"),
        F.count_if(F.col("output") > 0).alias("assistant_messages"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"),
    )


def top_per_group(df: DataFrame, by: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark cuts each partition to n a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= n)
