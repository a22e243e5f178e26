"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin hashes of ``least`` words, rolled over a document and looked up among those of the benchmark, are the seeds that the two
share. Seeds on one diagonal grow into maximal matches; the longest match is marked again and again, cut to what is still unmarked, until none
of ``least`` words is left. An item is found if the tiles cover at least ``coverage`` of its words, in whatever order its pieces stand.

The benchmark is read in blocks of about BLOCK_BYTES, dealt by a hash of the id, and each block is broadcast alone; documents flow through one pass
for each block, without a shuffle, and carry the best item so far. So neither the broadcast nor the work of a row depends on how many documents there are.

Cases: a null or empty text, or item, has no words and matches nothing; an item of fewer than ``least`` words matches nothing. Texts are read whole.
A text and an item of one word repeated share as many seeds as the product of their lengths: they are handled SEEDS at a time, and only the matches that they grow into, one a diagonal, are held.
Ties go to the smaller item id. Repeated rows get equal results, and columns called like an added one are replaced. An empty benchmark leaves coverage 0.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestream.llm.shared import held, small_batches, stored

LEAST, COVERAGE = 5, 0.8
#: Bytes of benchmark text that one pass holds.
BLOCK_BYTES = 8 << 20
#: Passes that one stage makes, each with a worker and a block of its own, before the documents are written.
PASSES = 4
#: Seeds that are held at once.
SEEDS = 1 << 20

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
ADDED = T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("item_id", T.LongType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("n_words", T.LongType())])


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` ids, each from the one before it."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _BASE + ids[k : k + n]
    return out


def _before(item: int | None, other: int | None) -> bool:
    """Whether an id comes before another; null comes last."""
    return item is not None and (other is None or item < other)


class Index:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least, self.words = least, {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owners, places = [], [], []
        for item, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in _WORD.findall((text or "").lower())], np.uint64)
            if len(ids) < least:
                continue
            seeds = rolled(ids, least)
            hashes.append(seeds)
            owners.append(np.full(len(seeds), len(self.items)))
            places.append(np.arange(len(seeds)))
            self.items.append((item, ids))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int64)

    def best(self, text: str | None) -> tuple[float, int | None, int, int]:
        """Coverage, item id and tiles of the item covered most, and the number of words of the text."""
        words = _WORD.findall((text or "").lower())
        none = (0.0, None, 0, len(words))
        if len(words) < self.least or not len(self.hash):
            return none
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        at = np.flatnonzero(known[self.least :] - known[: -self.least] == self.least)
        if not len(at):
            return none
        seeds = rolled(ids, self.least)[at]
        lo, hi = np.searchsorted(self.hash, seeds, "left"), np.searchsorted(self.hash, seeds, "right")
        hit = np.flatnonzero(hi > lo)
        many = hi[hit] - lo[hit]
        runs: dict[int, list[np.ndarray]] = defaultdict(list)
        start = 0
        while start < len(hit):
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(many[start:]), SEEDS, side="right")))
            own, n = hit[start:stop], many[start:stop]
            place = np.repeat(lo[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            p, q, owner = np.repeat(at[own], n), self.place[place], self.owner[place]
            by = np.argsort(owner, kind="stable")
            edge = np.flatnonzero(np.diff(owner[by], prepend=-1))
            for k, part in zip(owner[by][edge].tolist(), np.split(by, edge[1:]), strict=True):
                runs[k].append(matches(ids, self.items[k][1], p[part], q[part], self.least))
            start = stop
        found = none
        for k, of_item in runs.items():
            item, own = self.items[k]
            tiles = tile(joined(of_item), len(own), self.least)
            part = sum(n for n, _, _ in tiles) / len(own)
            if part > found[0] or (part == found[0] and part > 0 and _before(item, found[1])):
                found = (part, item, len(tiles), len(words))
        return found


def matches(text: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """Maximal matches (length, start in the text, start in the item) of the seeds at p and q, one row each; two runs of one hash that differ are no seed."""
    same = np.ones(len(p), bool)
    for k in range(least):
        same &= text[p + k] == item[q + k]
    return joined([np.stack([np.full(int(same.sum()), least), p[same], q[same]], axis=1)])


def joined(runs: list[np.ndarray]) -> np.ndarray:
    """Matches that touch or overlap on a diagonal made one."""
    rows = np.concatenate(runs)
    if not len(rows):
        return rows
    diagonal = rows[:, 1] - rows[:, 2]
    by = np.lexsort((rows[:, 1], diagonal))
    n, p, diagonal = rows[by, 0], rows[by, 1], diagonal[by]
    # ends grow along a diagonal; an offset for each diagonal keeps the running maximum apart
    width = int((p + n).max()) + 1
    rank = np.cumsum(np.diff(diagonal, prepend=diagonal[0]) != 0) * width
    reach = np.maximum.accumulate(p + n + rank)
    new = np.flatnonzero(np.concatenate(([True], p[1:] + rank[1:] > reach[:-1])))
    end = reach[np.append(new[1:], len(p)) - 1] - rank[new]
    return np.stack([end - p[new], p[new], p[new] - diagonal[new]], axis=1)


def tile(runs: np.ndarray, item_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in the text, start in the item) from maximal matches: the longest first, cut to what is unmarked, until fewer than ``least`` words of the item are left."""
    heap = [(-n, p, q) for n, p, q in runs.tolist()]
    heapq.heapify(heap)
    used_text, used_item, tiles, left = set(), np.zeros(item_words, bool), [], item_words
    while heap and left >= least:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = ~used_item[q : q + n]
        if not free.any():
            continue
        if used_text:
            free &= np.fromiter((p + k not in used_text for k in range(n)), bool, n)
        if free.all():
            tiles.append((n, p, q))
            used_item[q : q + n] = True
            used_text.update(range(p, p + n))
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return tiles


def tiled(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """docs with coverage, item_id, n_tiles and n_words of the benchmark item that each covers most."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    own = [f for f in docs.schema.fields if f.name not in ADDED.fieldNames() or f.name == text]
    out = docs.select(*[F.col(f"`{f.name}`") for f in own])
    nulls = {"coverage": F.lit(0.0), "item_id": F.lit(None).cast("long"), "n_tiles": F.lit(0), "n_words": F.lit(None).cast("long")}
    out = out.select("*", *[c.alias(n) for n, c in nulls.items()])
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        out = _pass(out, spark.sparkContext.broadcast(block), least, text)
        if b % PASSES == PASSES - 1 and b < blocks - 1:
            out = stored(out)
    return out


def _pass(df: DataFrame, shared, least: int, text: str) -> DataFrame:
    names = df.columns
    added, owner = ADDED.fieldNames(), f"tiles {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(owner, "index", lambda: Index(shared.value, least))
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(names)}
            now = []
            for t, *old in zip(column[text].to_pylist(), *[column[n].to_pylist() for n in added], strict=True):
                new = index.best(t)
                better = new[0] > old[0] or (new[0] == old[0] and _before(new[1], old[1]))
                now.append(new if better else (old[0], old[1], old[2], new[3]))
            types = (pa.float64(), pa.int64(), pa.int32(), pa.int64())
            column |= {n: pa.array([x[i] for x in now], t) for i, (n, t) in enumerate(zip(added, types, strict=True))}
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names=names)

    return df.mapInArrow(run, df.schema)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, contaminated, coverage, item_id, n_tiles); item_id is null where nothing is shared, and for an item without an id."""
    found = tiled(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", (F.col("coverage") >= COVERAGE).alias("contaminated"), "coverage", "item_id", "n_tiles")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all its columns, without the rows that hold a benchmark item."""
    marked = tiled(docs, benchmark)
    return marked.filter(F.col("coverage") < COVERAGE).select(*docs.columns)
