"""Text functions as column expressions (STR*): all stay inside the JVM.

Lengths count code points. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UNICODE_TOKEN = r"[\p{L}\p{N}_]+"
ASCII_TOKEN = "[a-z0-9_]+"
#: Zero-width, bidirectional and tag characters (fixed values).
INVISIBLE = r"[​-‏‪-‮⁠-⁤⁪-⁯﻿\x{E0000}-\x{E007F}]"
#: Characters after which a word starts (fixed values).
BOUNDARY = r"\s\-_./:#@"


def lit(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNICODE_TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    """How many tokens a text has, without a list of them: the places where a word character follows none."""
    return F.coalesce(F.regexp_count(c, F.lit(UNICODE_TOKEN)), F.lit(0))


def word_pattern(token: str) -> str:
    """Matches a token, which is made of word characters, where it stands alone."""
    inside = UNICODE_TOKEN.removesuffix("+")
    return f"(?<!{inside}){token}(?!{inside})"


def fts_query(c: Column) -> Column:
    """Every token quoted, joined by AND; null if there is none."""
    found = tokens(c)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND "))


def token_set(c: Column) -> Column:
    """Distinct lower-case ASCII tokens, as the diversity re-ranking compares them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(ASCII_TOKEN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def expand_query(original: Column, keywords: Column) -> Column:
    """The original OR each keyword; the original alone without keywords."""
    return F.when(F.size(keywords) > 0, F.concat_ws(" OR ", original, F.array_join(keywords, " OR "))).otherwise(original)


def normalize_session_text(c: Column) -> Column:
    return F.trim(replace(replace(c, r"(?U)\s*\n+\s*", " "), r"(?U)\s+", " "))


def blocks_text(blocks: Column) -> Column:
    """Texts of the blocks of type text, normalised, non-empty ones joined by a blank; null if none is left."""
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: normalize_session_text(b["text"]))
    kept = F.filter(texts, lambda t: t != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def remap_line(line_map: Column, line: Column) -> Column:
    """The source line of a 1-based content line; the line itself beyond the map."""
    return F.coalesce(F.get(line_map, line - 1), line)


def word_boundary_index(text: Column, query: str) -> Column:
    """0-based place of the first match of the query, in any case, at a word's start; null if there is none."""
    if not query:
        return F.lit(None).cast("int")
    at = F.regexp_instr(F.lower(text), F.lit(f"(?:^|(?<=[{BOUNDARY}])){re.escape(query.lower())}"))
    return F.when(at > 0, at - 1)


def search_text(label: Column, description: Column, extra: Column) -> Column:
    empty = lambda c: F.nullif(c, F.lit(""))
    return F.lower(F.concat_ws(" ", empty(label), empty(description), empty(extra)))


def hyphen_slug(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return replace(replace(replace(replace(low, r"\s+", "-"), "[^a-z0-9#@._+-]+", "-"), "-{2,}", "-"), "^[-.]+|[-.]+$")


def at_hash_slug(c: Column) -> Column:
    low = replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^[@#]+")
    return replace(replace(replace(replace(low, r"[\s_]+", "-"), "[^a-z0-9-]+", "-"), "-{2,}", "-"), "^-+|-+$")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(replace(replace(replace(replace(c, "\r"), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"), "[ \t]{2,}", " "))


def markdown_to_text(c: Column) -> Column:
    """Images dropped, links and code unwrapped, headings, bullets and numbers stripped."""
    c = replace(c, r"!\[[^\]]*\]\([^)]+\)")
    c = replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = replace(c, r"```(?:[^\n]*?```|[^\n]*\n([\s\S]*?)```)", "$1")
    c = replace(c, "`([^`]+)`", "$1")
    c = replace(c, r"(?m)^#{1,6}\s+")
    c = replace(c, r"(?m)^\s*[-*+]\s+")
    c = replace(c, r"(?m)^\s*\d+\.\s+")
    return normalize_whitespace(c)


def strip_invisible(c: Column) -> Column:
    return replace(c, INVISIBLE)


def elide(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(replace(F.substring(c, 1, max(0, limit - 1)), r"\s+$"), F.lit("…")))


def summary_line(c: Column, limit: int = 160) -> Column:
    return elide(F.trim(replace(c, r"\s+", " ")), limit)


def csv_escape(c: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end; null becomes empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def rel_path(c: Column) -> Column:
    return F.replace(replace(F.trim(c), "^[./]+"), F.lit("\\"), F.lit("/"))


def is_memory_path(c: Column) -> Column:
    path = rel_path(c)
    return F.coalesce(path.isin("MEMORY.md", "memory.md") | F.startswith(path, F.lit("memory/")), F.lit(False))


def links(c: Column, most: int, blocked_hosts: tuple[str, ...] = ("localhost", "127.0.0.1", "0.0.0.0", "::1")) -> Column:
    """Distinct bare http(s) URLs in order, without those inside markdown links and those of blocked hosts, at most ``most``."""
    found = F.regexp_extract_all(replace(F.trim(c), r"(?i)\[[^\]]*\]\((https?://\S+?)\)", " "), F.lit(r"(?i)https?://\S+"), F.lit(0))
    host = lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/:?#\s]+)", 1))
    allowed = F.filter(found, lambda u: (host(u) != "") & ~host(u).isin(*blocked_hosts))
    return F.slice(F.array_distinct(allowed), 1, most)


def largest_b_number(c: Column) -> Column:
    """Largest positive number directly before a separate ``b``, as in model names; null if there is none."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?:^|[^a-z0-9])[a-z]?(\d+(?:\.\d+)?)b(?:[^a-z0-9]|$)"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: x > 0))


def path_glob(pattern: str) -> str:
    """Anchored, case-insensitive regular expression of a path glob: ** any, * within a segment, ? any character."""
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "(?i)^" + "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in parts) + "$"


def byte_size(c: Column) -> Column:
    """Bytes of "2mb"-like text (units of 1024), null if it isn't one; a bare number is bytes."""
    low = F.lower(F.trim(c))
    pattern = r"^(\d+(?:\.\d+)?)\s*(b|kb?|mb?|gb?|tb?)?$"
    unit = F.substring(F.regexp_extract(low, pattern, 2), 1, 1)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    value = F.regexp_extract(low, pattern, 1)
    return F.when(value != "", F.round(value.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def tool_counts(c: Column) -> Column:
    """Names in the lines that begin with [Tool: name], one entry for each line."""
    return F.filter(F.transform(F.split(c, "\n"), lambda s: F.regexp_extract(F.trim(s), r"^\[Tool:\s*([^\]]+)\]", 1)), lambda s: s != "")


def without_tool_lines(c: Column) -> Column:
    kept = F.filter(F.split(c, "\n"), lambda s: ~F.trim(s).rlike(r"^\[Tool:\s*[^\]]+\]") & ~F.startswith(F.trim(s), F.lit("[Tool Result]")))
    return F.trim(F.array_join(kept, "\n"))
