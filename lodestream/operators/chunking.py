"""Text splitting (STR7, STR9-13): loops that carry state from line to line, as Arrow-batched functions.

Lengths are in UTF-16 units, as the limits they serve are stated in them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def cut_units(text: str, n: int) -> int:
    """Characters of the longest prefix of at most n units."""
    if text.isascii() or max(text) <= "￿":
        return min(len(text), n)
    used = 0
    for i, c in enumerate(text):
        used += 2 if c > "￿" else 1
        if used > n:
            return i
    return len(text)


def markdown_chunks(content: str, tokens: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """(first line, last line, text, hash): lines packed up to 4 * tokens characters, each chunk beginning with the last 4 * overlap characters' worth of lines."""
    most, carried = max(32, tokens * 4), max(0, overlap * 4)
    pieces: list[tuple[int, str]] = []
    for number, line in enumerate(content.split("\n"), 1):
        if not line:
            pieces.append((number, ""))
        while line:
            n = max(1, cut_units(line, most))
            pieces.append((number, line[:n]))
            line = line[n:]
    chunks, held, size = [], [], 0

    def close() -> None:
        text = "\n".join(t for _, t in held)
        chunks.append((held[0][0], held[-1][0], text, hashlib.sha256(text.encode()).hexdigest()))

    for piece in pieces:
        n = units(piece[1]) + 1
        if held and size + n > most:
            close()
            kept, total = 0, 0
            while carried and kept < len(held) and total < carried:
                kept += 1
                total += units(held[-kept][1]) + 1
            held = held[len(held) - kept :] if kept else []
            size = total
        held.append(piece)
        size += n
    if held:
        close()
    return chunks


def utf8_parts(text: str, most: int) -> list[str]:
    """Cut into pieces of at most ``most`` UTF-8 bytes, a character at least; unchanged for a limit of 0 or less."""
    raw = text.encode()
    if most <= 0 or len(raw) <= most:
        return [text]
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw) and end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # a character longer than the limit
            end = at + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        parts.append(raw[at:end].decode())
        at = end
    return parts


def break_chunks(text: str, limit: int, find: Callable[[str], int]) -> list[str]:
    """Windows of ``limit`` characters cut where ``find`` says (0 or out of range: at the limit); ends are trimmed, blank pieces dropped."""
    if not text:
        return []
    if limit <= 0:
        return [text]
    found, rest = [], text
    while len(rest) > limit:
        at = find(rest[:limit])
        at = at if 0 < at <= limit else limit
        head = rest[:at].rstrip()
        if head:
            found.append(head)
        rest = rest[at + 1 :] if at < len(rest) and rest[at].isspace() else rest[at:]
        rest = rest.lstrip()
    return [*found, rest] if rest else found


def last_break(window: str) -> int:
    """The last line end, else the last blank."""
    at = window.rfind("\n")
    return at if at > 0 else window.rfind(" ")


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code: a fence is closed by one of its own character that is at least as long; an open one runs to the end."""
    spans, opened, at = [], None, 0
    for line in text.split("\n"):
        end = at + len(line)
        mark = _FENCE.match(line)
        if mark:
            if opened is None:
                opened = at, mark[1]
            elif mark[1][0] == opened[1][0] and len(mark[1]) >= len(opened[1]):
                spans.append((opened[0], end))
                opened = None
        at = end + 1
    if opened is not None:
        spans.append((opened[0], len(text)))
    return spans


def paragraph_chunks(text: str, least: int, most: int, prefer: str = "paragraph") -> list[str]:
    """Blocks of ``least`` to ``most`` characters that end at a paragraph, a line, a sentence or a blank, in falling preference, never inside a fence unless one is longer than ``most``."""
    least, most = max(1, least), max(1, least, most)
    order = {"paragraph": ("\n\n", "\n", ". ", " "), "newline": ("\n", ". ", " "), "sentence": (". ", " ")}[prefer]
    found, rest = [], text
    while len(rest) > most:
        spans = fences(rest)
        inside = lambda i: next((s for s in spans if s[0] < i < s[1]), None)  # noqa: E731, B023
        at = 0
        for mark in order:
            i = rest.rfind(mark, 0, most)
            while i >= 0 and inside(i):
                i = rest.rfind(mark, 0, i)
            if i >= 0 and i + len(mark.rstrip("\n ")) >= least:
                at = i + len(mark.rstrip("\n "))
                break
        if not at:
            span = inside(most)
            at = span[0] if span and span[0] >= least else most
        piece = rest[:at].rstrip()
        if piece:
            found.append(piece)
        rest = rest[at:].lstrip("\n ")
    return [*found, rest] if rest.strip() else found


# --- on DataFrames -------------------------------------------------------------------------------


def exploded(df: DataFrame, key: str, body: str, schema: str, made: Callable[[str], list[tuple]]) -> DataFrame:
    """(key, schema columns): a row for each tuple that ``made`` gives for the text; null texts give none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *t) for k, x in zip(batch[key], batch[body], strict=True) if x is not None for t in made(x)]
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, body).mapInPandas(run, f"{key} {kind}, {schema}")


def chunk_documents(df: DataFrame, tokens: int = 400, overlap: int = 80, key: str = "doc_id", body: str = "text") -> DataFrame:
    return exploded(df, key, body, "start_line int, end_line int, chunk string, hash string", lambda t: markdown_chunks(t, tokens, overlap))


def enforce_bytes(chunks: DataFrame, most: int, body: str = "chunk") -> DataFrame:
    """Chunks over the byte limit split and hashed again, their lines kept; the others never leave the JVM."""
    fits = F.octet_length(body) <= most
    names = [c for c in chunks.columns if c not in (body, "hash")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*r[:-1], p) for r in batch[[*names, body]].itertuples(index=False, name=None) for p in utf8_parts(r[-1], most)]
            yield pd.DataFrame(rows, columns=[*names, body])

    large = chunks.filter(~fits).select(*names, body)
    split = large.mapInPandas(run, large.schema).withColumn("hash", F.sha2(body, 256))
    return chunks.filter(fits).select(*names, body, "hash").unionByName(split)
