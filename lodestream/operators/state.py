"""Batch forms of keyed state: freshness, sessions, retention, health, echoes (STM10-12, 17-20, 24-26, 29, 30, JN12, JN13)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestream.functions import timefns


@dataclass(frozen=True)
class ResetPolicy:
    """mode daily: stale before the last at_hour o'clock; idle_minutes, if any: stale after that long."""

    mode: str = "daily"
    at_hour: int = 4
    idle_minutes: int | None = None


def reset_policy(kind: str, by_type: dict | None = None, base: dict | None = None, idle_minutes: float | None = None, override: dict | None = None) -> ResetPolicy:
    """The policy of a session type: its own setting, then the base, then the older idle setting alone; an override replaces them all."""
    base = override if override is not None else base
    own = {} if override is not None else (by_type or {}).get(kind) or ((by_type or {}).get("dm") if kind == "direct" else None) or {}
    legacy = None if override is not None else idle_minutes
    explicit = bool(base) or by_type is not None
    mode = own.get("mode") or (base or {}).get("mode") or ("idle" if not explicit and legacy is not None else "daily")
    hour = next((x for x in (own.get("atHour"), (base or {}).get("atHour"), 4) if x is not None))
    idle = next((x for x in (own.get("idleMinutes"), (base or {}).get("idleMinutes"), legacy) if x is not None), None)
    idle = max(1, int(idle)) if idle is not None else 60 if mode == "idle" else None
    return ResetPolicy(mode, max(0, min(23, int(hour))), idle)


def fresh(updated_ms: Column, now_ms: Column, policy: ResetPolicy, offset_minutes: int = 0) -> Column:
    stale = F.lit(False)
    if policy.mode == "daily":
        stale = stale | (updated_ms < timefns.daily_reset_ms(now_ms, policy.at_hour, offset_minutes))
    if policy.idle_minutes is not None:
        stale = stale | (now_ms > updated_ms + policy.idle_minutes * 60_000)
    return ~stale


def sessionize(df: DataFrame, by: str, time_ms: str, tie: str, policy: ResetPolicy) -> DataFrame:
    """session 1, 2, ... of each key: a new one where the row before it is stale by then."""
    w = Window.partitionBy(by).orderBy(time_ms, tie)
    last = F.lag(time_ms).over(w)
    starts = F.when(last.isNull() | ~fresh(last, F.col(time_ms), policy), 1).otherwise(0)
    return df.withColumn("_s", starts).withColumn("session", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def retained(df: DataFrame, time_ms: str, now_ms: int, max_age_ms: int | None) -> DataFrame:
    return df if max_age_ms is None else df.filter(F.col(time_ms) >= now_ms - max_age_ms)


def sweep(sessions: DataFrame, key: Column, time_ms: str, now_ms: int, retention_ms: int | None = 24 * 3_600_000) -> DataFrame:
    """Without sessions of scheduled runs past the retention; others stay whatever their age."""
    from lodestream.functions import keys

    return sessions if retention_ms is None else sessions.filter(~keys.is_cron_run(key) | (F.col(time_ms) >= now_ms - retention_ms))


def evicted(artifacts: DataFrame, by: str, time_ms: str, size: str, high_water: float, target: float, referenced: DataFrame, key: str) -> DataFrame:
    """The oldest unreferenced artifacts whose removal brings a folder over its high water down to the target.

    Sizes are added as decimals of ten places, so that a folder that is exactly at its target is at it in any order of adding. A folder with a size that no such decimal holds is added as it stands."""
    exact = F.col(size).try_cast("decimal(28,10)")
    total = artifacts.groupBy(by).agg(F.sum(exact).alias("_total"), F.sum(size).alias("_plain"), F.coalesce(F.bool_or(exact.isNull() & F.col(size).isNotNull()), F.lit(False)).alias("_is_plain"))
    over = artifacts.join(total.filter(F.when(F.col("_is_plain"), F.col("_plain") > high_water).otherwise(F.col("_total") > high_water)), by)
    free = over.join(referenced.select(key).distinct(), key, "left_anti")
    earlier = Window.partitionBy(by).orderBy(time_ms, key).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_total") - F.coalesce(F.sum(exact).over(earlier), F.lit(0))
    plain = F.col("_plain") - F.coalesce(F.sum(size).over(earlier), F.lit(0.0))
    return free.withColumn("_more", F.when(F.col("_is_plain"), plain > target).otherwise(rest > target)).filter("_more").drop("_more", "_total", "_plain", "_is_plain")


BUSY_STALE_MS, EVENT_STALE_MS, CONNECT_GRACE_MS = 25 * 60_000, 30 * 60_000, 120_000


def channel_health(now_ms: Column, s: dict[str, Column]) -> Column:
    """Reason of the first rule that fits a snapshot (managed, running, connected, busy, active_runs, last_run_ms, last_event_ms, last_start_ms, polling)."""
    busy = F.coalesce(s["busy"], F.lit(False)) | (F.coalesce(s["active_runs"], F.lit(0)) > 0)
    current = s["last_start_ms"].isNull() | F.coalesce(s["last_run_ms"] >= s["last_start_ms"], F.lit(False))
    recent = F.coalesce(now_ms - s["last_run_ms"] < BUSY_STALE_MS, F.lit(False))
    up = now_ms - s["last_start_ms"]
    stale = ~s["polling"] & F.coalesce(s["connected"], F.lit(False)) & F.coalesce(now_ms - s["last_event_ms"] > EVENT_STALE_MS, F.lit(False)) & F.coalesce(up > EVENT_STALE_MS, F.lit(True))
    return (
        F.when(~s["managed"], "unmanaged").when(~F.coalesce(s["running"], F.lit(False)), "not-running").when(busy & current & recent, "busy").when(busy & current, "stuck")
        .when(F.coalesce(up < CONNECT_GRACE_MS, F.lit(False)), "startup-connect-grace").when(F.coalesce(~s["connected"], F.lit(False)), "disconnected").when(stale, "stale-socket").otherwise("healthy")
    )


def echoes(inbound: DataFrame, outbound: DataFrame, id_ms: int = 60_000, text_ms: int = 5_000) -> DataFrame:
    """Inbound rows (in_id, scope, text, message_id, at) that repeat an earlier outbound of their scope: by message id within id_ms, or by text within text_ms; ``ok`` and ``unknown`` are no ids."""
    body = lambda c: F.nullif(F.trim(F.regexp_replace(c, "\r\n?", "\n")), F.lit(""))
    real = lambda c: F.when(~F.trim(c).isin("", "ok", "unknown"), F.trim(c))
    out = outbound.select("scope", body(F.col("text")).alias("o_text"), real(F.col("message_id")).alias("o_id"), F.col("at").alias("o_at"))
    own = inbound.withColumns({"_text": body(F.col("text")), "_id": real(F.col("message_id"))})
    by_id = own.join(out, (own["scope"] == out["scope"]) & (F.col("_id") == F.col("o_id")) & (F.col("at") - F.col("o_at")).between(0, id_ms), "left_semi")
    rest = own.join(by_id.select(F.col("in_id").alias("_found")), F.col("in_id") == F.col("_found"), "left_anti")
    by_text = rest.join(out, (rest["scope"] == out["scope"]) & (F.col("_text") == F.col("o_text")) & (F.col("at") - F.col("o_at")).between(0, text_ms), "left_semi")
    return by_id.unionByName(by_text).drop("_text", "_id")


def with_required(required: DataFrame, found: DataFrame, key: str, status: str) -> DataFrame:
    """Every required key, ``missing`` where it has no row."""
    return required.join(found, key, "left").withColumn(status, F.coalesce(status, F.lit("missing")))


def hits_in_window(df: DataFrame, by: str, time_ms: str, window_ms: int, most: int) -> DataFrame:
    """hits within the window up to each row (both ends included) and whether they reach the limit."""
    w = Window.partitionBy(by).orderBy(time_ms).rangeBetween(-window_ms, 0)
    return df.withColumn("hits", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("hits") >= most)


def reconciled(agent: DataFrame, chat: DataFrame) -> DataFrame:
    """(run_id, source, at, status): the newer snapshot of the two writers wins; an agent record still in flight keeps an older chat record out."""
    a, c = agent.select("run_id", F.struct("at", "status").alias("a")), chat.select("run_id", F.struct("at", "status").alias("c"))
    both = a.join(c, "run_id", "full_outer")
    use_chat = F.col("a").isNull() | F.coalesce((F.col("c.at") > F.col("a.at")), F.lit(False))
    pick = F.when(use_chat, F.col("c")).otherwise(F.col("a"))
    waits = F.coalesce((F.col("a.status") == "running") & ~use_chat, F.lit(False))
    return both.select("run_id", F.when(use_chat, "chat").otherwise("agent").alias("source"), pick["at"].alias("at"), F.when(waits, "pending").otherwise(pick["status"]).alias("status"))
