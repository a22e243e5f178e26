"""Hierarchical session keys (PRJ3-5): agent:<id>:<rest>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _raw(key: Column) -> Column:
    return F.lower(F.trim(F.coalesce(key, F.lit(""))))


def _parts(key: Column) -> Column:
    return F.filter(F.split(_raw(key), ":"), lambda x: x != "")


def is_agent_key(key: Column) -> Column:
    parts = _parts(key)
    return (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "agent") & (F.trim(F.get(parts, F.lit(1))) != "")


def agent_id(key: Column) -> Column:
    return F.when(is_agent_key(key), F.trim(F.get(_parts(key), F.lit(1))))


def rest(key: Column) -> Column:
    return F.when(is_agent_key(key), F.array_join(F.slice(_parts(key), 3, 1 << 20), ":"))


def chat_type(key: Column) -> Column:
    scoped = F.coalesce(rest(key), _raw(key))
    names = F.split(scoped, ":")
    has = lambda x: F.array_contains(names, x)
    return (
        F.when(has("group"), "group")
        .when(has("channel"), "channel")
        .when(has("direct") | has("dm"), "direct")
        .when(scoped.rlike("^discord:(?:[^:]+:)?guild-[^:]+:channel-[^:]+$"), "channel")
        .otherwise("unknown")
    )


def is_cron_run(key: Column) -> Column:
    return F.coalesce(rest(key).rlike("^cron:[^:]+:run:[^:]+$"), F.lit(False))


def is_subagent(key: Column) -> Column:
    return F.startswith(_raw(key), F.lit("subagent:")) | F.coalesce(F.startswith(rest(key), F.lit("subagent:")), F.lit(False))


def subagent_depth(key: Column) -> Column:
    return F.size(F.split(_raw(key), ":subagent:")) - 1


def thread_parent(key: Column) -> Column:
    """What stands before the last :thread: or :topic:, null if there is neither or nothing before it."""
    text = F.trim(key)
    found = F.regexp_extract(text, "(?is)^(.+):(?:thread|topic):", 1)
    return F.nullif(F.trim(found), F.lit(""))
