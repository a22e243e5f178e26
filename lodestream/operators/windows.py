"""Budgets, streaks and duplicates over ordered rows (WIN4-11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE = Window.unboundedPreceding


def newest_within(df: DataFrame, by: str, order: list[Column], size: Column, budget: float) -> DataFrame:
    """The newest rows whose sizes add up to the budget at most; order is newest first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(BEFORE, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= budget).drop("_sum")


def last_user_turns(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """From the n-th last user turn on; all rows if n isn't positive. Rows before the first user turn stay only if there are fewer turns."""
    if n <= 0:
        return df
    w = Window.partitionBy(by).orderBy(order).rowsBetween(BEFORE, 0)
    turns = df.withColumn("_u", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    last = F.max("_u").over(Window.partitionBy(by))
    return turns.withColumn("_all", last).filter((F.col("_all") < n) | (F.col("_u") > F.col("_all") - n)).drop("_u", "_all")


def byte_capped(df: DataFrame, by: str, order: list[Column], size: Column, most: int) -> DataFrame:
    """The newest rows that fit; the newest alone, flagged too large if it doesn't."""
    w = Window.partitionBy(by).orderBy(*order)
    own = df.withColumns({"_sum": F.sum(size).over(w.rowsBetween(BEFORE, 0)), "_n": F.row_number().over(w)})
    return own.filter((F.col("_sum") <= most) | (F.col("_n") == 1)).withColumn("too_large", F.col("_sum") > most).drop("_sum", "_n")


def equal_shares(df: DataFrame, by: str, order: list[str], size: Column, parts: int) -> DataFrame:
    """part 0 to parts - 1 for each row, by the share of the size before it; the order is kept."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(BEFORE, -1)), F.lit(0))
    total = F.greatest(F.sum(size).over(Window.partitionBy(by)), F.lit(1))
    return df.withColumn("part", F.least(F.lit(parts - 1), F.floor(parts * before / total)).cast("int"))


def failure_streak(df: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """streak: failures in a row up to each run, 0 after a success; islands begin at successes."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(BEFORE, 0)
    island = df.withColumns({"_f": failed.cast("int"), "_i": F.sum(F.when(failed, 0).otherwise(1)).over(w)})
    inner = Window.partitionBy(by, "_i").orderBy(*order).rowsBetween(BEFORE, 0)
    return island.withColumn("streak", F.sum("_f").over(inner).cast("long")).drop("_f", "_i")


def failure_alerts(df: DataFrame, by: str, order: str, time_ms: str, failed: str, after: int, cooldown_ms: int) -> DataFrame:
    """The failures that raise an alert: a streak of ``after`` and no alert within the cooldown. Each alert depends on the one before, so a key's failing runs go to one worker."""
    streaks = failure_streak(df, by, [order], F.col(failed)).filter(F.col("streak") >= after).select(by, order, time_ms, "streak")
    schema = streaks.schema.simpleString()[7:-1].replace(":", " ")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        last, kept = None, []
        for at in rows[time_ms]:
            fire = last is None or at - last >= cooldown_ms
            kept.append(fire)
            last = at if fire else last
        return rows[kept]

    return streaks.groupBy(by).applyInPandas(pick, schema)


def without_repeats(df: DataFrame, by: str, order: list[str], body: str, last: int) -> DataFrame:
    """Rows whose trimmed text differs from the one before, blank ones left out, the last ones of each key."""
    own = df.withColumn("_t", F.trim(body)).filter("_t <> ''")
    w = Window.partitionBy(by).orderBy(*order)
    kept = own.withColumn("_p", F.lag("_t").over(w)).filter(~F.col("_t").eqNullSafe(F.col("_p")))
    newest = Window.partitionBy(by).orderBy(*[F.desc(o) for o in order])
    return kept.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last).drop("_t", "_p", "_n")
