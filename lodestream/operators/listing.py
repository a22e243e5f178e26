"""Listing, paging, ordering and export of sessions, jobs and queue items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestream.functions import text


def between(df: DataFrame, c: str, lo_ms: int, hi_ms: int) -> DataFrame:
    return df.filter(F.col(c).between(lo_ms, hi_ms))


def active(df: DataFrame, c: str, now_ms: int, minutes: int) -> DataFrame:
    """Rows updated within the last minutes; rows never updated are out."""
    return df.filter(F.col(c).isNotNull() & (F.lit(now_ms) - F.col(c) <= minutes * 60_000))


def sessions(df: DataFrame, now_ms: int, limit: int | None = None, active_minutes: int | None = None, agent_id: str | None = None, label: str | None = None, search: str | None = None, include_unknown: bool = False, key: str = "key") -> DataFrame:
    """Every filter that is given, newest first."""
    if active_minutes is not None:
        df = active(df, "updated_at", now_ms, active_minutes)
    if agent_id is not None:
        df = df.filter(F.col("agent_id") == agent_id)
    if label is not None:
        df = df.filter(F.col("label") == label)
    if search:
        low = search.strip().lower()
        df = df.filter(F.coalesce(F.contains(F.lower("label"), F.lit(low)), F.lit(False)) | F.contains(F.lower("key"), F.lit(low)))
    if not include_unknown:
        df = df.filter(F.col("chat_type") != "unknown")
    df = df.orderBy(F.coalesce("updated_at", F.lit(0)).desc(), key)
    return df if limit is None else df.limit(limit)


def jobs(df: DataFrame, enabled: str = "all", query: str = "", name: str = "name", column: str = "enabled") -> DataFrame:
    """enabled: all, enabled or disabled."""
    if enabled != "all":
        df = df.filter(F.col(column) == F.lit(enabled == "enabled"))
    return df.filter(F.contains(F.lower(name), F.lit(query.strip().lower()))) if query.strip() else df


def runs(df: DataFrame, job: str, scope: object = "all", status: str = "status", statuses: list[str] | None = None, text: str = "summary", query: str = "", delivery: str = "delivery_status", deliveries: list[str] | None = None) -> DataFrame:
    """Runs of one job or of all, of some statuses and delivery statuses or ["all"], that hold the query."""
    if scope != "all":
        df = df.filter(F.col(job) == scope)
    if statuses and "all" not in statuses:
        df = df.filter(F.col(status).isin(*statuses))
    if deliveries and "all" not in deliveries:
        df = df.filter(F.col(delivery).isin(*deliveries))
    return df.filter(F.contains(F.lower(text), F.lit(query.strip().lower()))) if query.strip() else df


def without_tool_rows(df: DataFrame, include: bool = False, tool_roles: tuple[str, ...] = ("tool", "toolResult")) -> DataFrame:
    return df if include else df.filter(~F.col("role").isin(*tool_roles))


def allow_match(candidates: dict[str, Column], allowed: list[str]) -> Column:
    """Which source of candidates, in order, is on the list; ``wildcard`` for a list with *, null for none."""
    if "*" in allowed:
        return F.lit("wildcard")
    chain = F.lit(None).cast("string")
    for source, c in reversed(candidates.items()):
        chain = F.when(c.isin(*allowed), source).otherwise(chain)
    return chain


def page(df: DataFrame, by: str, descending: bool = False, tie: str = "id", offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset to offset + limit in order, nulls last, ties by id."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(order, tie).offset(max(0, offset)).limit(limit)


SORTS = {"tokens": "total_tokens", "cost": "total_cost", "recent": "updated_at", "messages": "messages", "errors": "errors"}


def sort_sessions(df: DataFrame, by: str = "recent", descending: bool = True, tie: str = "key") -> DataFrame:
    measure = F.coalesce(F.col(SORTS[by]), F.lit(0))
    return df.orderBy(measure.desc() if descending else measure.asc(), tie)


PRIORITY = {"high": 3, "normal": 2, "default": 1}


def drain(items: DataFrame, most: int = 4) -> DataFrame:
    """The first items of each node by priority, time and id (ten at most), and whether there are more."""
    most = max(1, min(10, most))
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "normal", 2).otherwise(1)
    w = Window.partitionBy("node").orderBy(rank.desc(), "created", "id")
    first = items.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most + 1)
    last = F.max("place").over(Window.partitionBy("node"))
    return first.withColumn("has_more", last > most).filter(F.col("place") <= most)


def credential_order(df: DataFrame, by: str, cooling: str, type_rank: str, last_used: str, tie: str) -> DataFrame:
    """Available credentials by type, then least recently used; cooling ones after, by when they are free."""
    w = Window.partitionBy(by).orderBy(cooling, F.when(~F.col(cooling), F.col(type_rank)).asc_nulls_last(), last_used, tie)
    return df.withColumn("place", F.row_number().over(w))


def choices(df: DataFrame, key: str, updated: str, now_ms: int, window_ms: int, pinned: Column, limit: int) -> DataFrame:
    """One row a key, recent ones newest first, the pinned one in front whatever its age."""
    recent = F.coalesce(F.lit(now_ms) - F.col(updated) <= window_ms, F.lit(False))
    own = df.filter(recent | pinned)
    newest = own.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(updated)))).filter("_n = 1").drop("_n")
    return newest.orderBy(pinned.desc(), F.desc_nulls_last(updated), key).limit(limit)


def keyword_items(items: DataFrame, query: str, most: int) -> DataFrame:
    """Additive score: the query in the description 10, each of its words in a description word 5, its emoji 8, in the set's name 3; only positive scores."""
    low = query.strip().lower()
    words = F.split(F.lower("description"), r"\s+")
    score = F.when(F.contains(F.lower("description"), F.lit(low)), 10).otherwise(0)
    for w in low.split():
        score = score + F.when(F.exists(words, _holds(w)), 5).otherwise(0)
    score = score + F.when(F.contains(F.lit(query), F.col("emoji")) & (F.col("emoji") != ""), 8).otherwise(0)
    score = score + F.when(F.contains(F.lower("set_name"), F.lit(low)), 3).otherwise(0)
    return items.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(most)


def _holds(word: str):
    return lambda x: F.contains(x, F.lit(word))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of CSV."""
    return df.select(F.array_join(F.array(*[text.csv_escape(F.col(c)) for c in columns]), ",").alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes doubled, null empty. Files follow the partitions, so the caller coalesces where one file is wanted."""
    df.write.option("header", True).option("escape", '"').option("nullValue", "").csv(path)
