"""The session query language: ``key:value`` terms compiled to one column predicate (FLT6-14).

Terms are split at white space unless quoted; all must hold. An unknown key, an unknown ``has:`` value or a number that can't be read matches everything and is reported as a warning.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TEXT_KEYS = {"agent": "agent_id", "channel": "channel", "chat": "chat_type", "label": "label"}
LIST_KEYS = {"provider": "providers", "model": "models", "tool": "tools"}
ID_KEYS = ("key", "session", "id")
NUMBER_KEYS = {"tokens": "total_tokens", "cost": "total_cost", "messages": "messages"}
HAS = ("tools", "errors", "context", "usage", "model", "provider")
KEYS = {*TEXT_KEYS, *LIST_KEYS, *ID_KEYS, "has", *(f"{side}{n}" for n in NUMBER_KEYS for side in ("min", "max"))}


@dataclass(frozen=True)
class Term:
    value: str
    key: str | None = None
    raw: str = ""


def parse(query: str) -> list[Term]:
    """Terms in order; a colon that isn't the first character splits key from value."""
    found = []
    for token in re.findall(r'"[^"]+"|\S+', query):
        bare = token.removeprefix('"').removesuffix('"')
        key, colon, value = bare.partition(":")
        found.append(Term(value, key, bare) if colon and key else Term(bare, None, bare))
    return found


def number(text: str) -> float | None:
    """$ in front and k or m behind are understood."""
    raw = text.strip().lower().removeprefix("$")
    factor = {"k": 1e3, "m": 1e6}.get(raw[-1:], 1.0)
    if factor > 1:
        raw = raw[:-1]
    if not text.strip():
        return None
    try:
        value = float(raw) if raw else 0.0
    except ValueError:
        return None
    return value * factor if math.isfinite(value) and "_" not in raw else None


def glob(pattern: str) -> str:
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def _low(c: str) -> Column:
    return F.lower(F.col(c))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def predicate(term: Term) -> Column:
    """A session needs: key, session_id, label, agent_id, channel, chat_type, providers, models, tools (arrays), total_tokens, total_cost, messages, errors, tool_calls, has_context, has_usage."""
    value = term.value.strip().lower()
    if not value:
        return F.lit(True)
    inside = lambda c: _sure(F.contains(_low(c), F.lit(value)))
    if term.key is None:
        return inside("label") | inside("key") | inside("session_id")
    key = term.key.strip().lower()
    if key in TEXT_KEYS:
        return inside(TEXT_KEYS[key])
    if key in LIST_KEYS:
        return _sure(F.exists(LIST_KEYS[key], lambda x: F.contains(F.lower(x), F.lit(value))))
    if key in ID_KEYS:
        if "*" in value or "?" in value:
            return _sure(F.col("key").rlike(glob(value))) | _sure(F.col("session_id").rlike(glob(value)))
        return inside("key") | inside("session_id")
    if key == "has":
        positive = lambda c: _sure(F.col(c) > 0)
        some = lambda c: _sure(F.size(F.col(c)) > 0)
        tests = {"tools": positive("tool_calls"), "errors": positive("errors"), "context": _sure(F.col("has_context")), "usage": _sure(F.col("has_usage")), "model": some("models"), "provider": some("providers")}
        return tests.get(value, F.lit(True))
    if key[:3] in ("min", "max") and key[3:] in NUMBER_KEYS:
        limit = number(value)
        if limit is None:
            return F.lit(True)
        own = F.coalesce(F.col(NUMBER_KEYS[key[3:]]).cast("double"), F.lit(0.0))
        return own >= limit if key[:3] == "min" else own <= limit
    return F.lit(True)


def warnings(terms: list[Term]) -> list[str]:
    found = []
    for t in terms:
        if t.key is None:
            continue
        key = t.key.strip().lower()
        if key not in KEYS:
            found.append(f"Unknown filter: {t.key}")
            continue
        if t.value == "":
            found.append(f"Missing value for {t.key}")
        elif key == "has" and t.value.strip().lower() not in HAS:
            found.append(f"Unknown has:{t.value}")
        elif key[:3] in ("min", "max") and number(t.value) is None:
            found.append(f"Invalid number for {t.key}")
    return found


def filter_sessions(sessions: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    """Sessions for which all terms hold, and the warnings."""
    terms = parse(query)
    out = sessions
    for t in terms:
        out = out.filter(predicate(t))
    return out, warnings(terms)


# --- editing a query -----------------------------------------------------------------------------


def suggestions(sessions: DataFrame, key: str, typed: str = "", most: int = 6) -> DataFrame:
    """The first distinct values of a key that hold what is typed."""
    column = F.col(TEXT_KEYS[key]) if key in TEXT_KEYS else F.explode(LIST_KEYS[key])
    values = sessions.select(column.alias("value")).filter("value IS NOT NULL").distinct()
    return values.filter(F.contains(F.lower("value"), F.lit(typed.lower()))).orderBy("value").limit(most).select(F.concat(F.lit(f"{key}:"), "value").alias("suggestion"))


def add_term(query: str, term: str) -> str:
    """Appended unless it is there already, in any case."""
    own = query.split()
    return query if term.lower() in (t.lower() for t in own) else " ".join([*own, term]) + " "


def remove_term(query: str, term: str) -> str:
    rest = [t for t in query.split() if t.lower() != term.lower()]
    return " ".join(rest) + " " if rest else ""


def set_terms(query: str, key: str, values: list[str]) -> str:
    """All terms of the key replaced by one for each value."""
    rest = [t.raw for t in parse(query) if (t.key or "").lower() != key.lower()]
    return " ".join([*rest, *(f"{key}:{v}" for v in values)]) + " " if rest or values else ""


def apply_suggestion(query: str, suggestion: str) -> str:
    """The last word, which is being typed, replaced."""
    head = query.rstrip().split()[:-1] if query.strip() and not query.endswith(" ") else query.split()
    return " ".join([*head, suggestion]) + " "
