"""Exact removal of repeated strings by a distributed suffix array.

What repeats is a string of ``length`` symbols (a window) of a Unit: bytes, or words. Two equal windows agree in the place of their smallest run of ``anchor`` symbols (by a hash), so every window
belongs to one anchor and equal windows have equal anchors. The windows of an anchor are consecutive; with their text they make its context.

1. Documents are dealt into blocks. A block sends each distinct anchor once to the partition of its hash, and learns whether the anchor is alone, has one context wherever it occurs (then every
   window of it repeats), or has several. Anchors of several units go together.
2. The contexts of the last kind, the anchor itself being one symbol in each, are suffix-sorted, group by group of equal anchors, by two-stage sorting; where suffixes that are neighbours in
   that order share a whole window, both windows repeat. A group of more than GROUP_ROWS contexts is cut first: its windows are dealt anew by the longer string that a few neighbouring
   windows have in common, then window by window, so a passage that any number of documents share never meets in one task.
3. The windows found are joined to the documents that wait for them and their bytes removed.

Words are runs without ASCII white space, compared by 32 bits of a hash each, as they stand; what a window of words covers reaches from its first word's first byte to its last word's last.

Cases: null and empty texts have no symbol, and texts shorter than ``length`` lose none. Texts are read whole, in segments if very long. Equal rows are each other's copies: all their windows repeat. Hashes of
runs have 64 bits. Extra columns pass through; the operator's own have names that begin with ``_sd_``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestream.llm.ngramlm import _B, _mix, _pack, _powers, _unpack
from lodestream.llm.shared import begin, release, slices, small_batches, stored, utf8
from lodestream.llm.suffixes import adjacent_prefixes, sorted_suffixes


@dataclass(frozen=True)
class Unit:
    """Windows of ``length`` symbols and anchors of ``anchor``; a symbol is a byte, or a word in four bytes."""

    length: int
    anchor: int
    words: bool = False

    @property
    def width(self) -> int:
        return 4 if self.words else 1

    @property
    def span(self) -> int:
        """Bytes of a window's symbols besides its anchor."""
        return (self.length - self.anchor) * self.width


#: Strings of 400 bytes; passages of over 50 words, the first and last of which may be joined to other characters.
BYTES, PASSAGES = Unit(400, 300), Unit(48, 24, words=True)
#: Window starts of a text that are treated at once; places within a segment take 24 bits.
SEGMENT = 1 << 20
#: Bytes of text in a block, and of anchors in a partition; their numbers follow the input.
BLOCK_BYTES, PARTITION_BYTES = 2 << 20, 16 << 20
#: Rows with texts in an Arrow batch.
TEXT_ROWS = 100
#: Bytes of a word that is hashed with its neighbours; longer ones are hashed alone.
LONG_WORD = 4096
#: Bytes of anchors sent for a byte of text, about.
SENT_PER_BYTE = 0.35
#: Contexts of one anchor that are sorted together, and symbols that are sorted at once.
GROUP_ROWS, SORTED_SYMBOLS = 256, 1 << 16
#: Neighbouring windows that share a key when a large group is cut.
BANDS = (8, 1)

ALONE, SAME, SEVERAL = 0, 1, 2


def _slide_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from running minima of blocks in both directions."""
    n = len(a) - width + 1
    padded = np.full(-(-len(a) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(a)] = a
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word, and the byte after its last."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_symbols(raw: np.ndarray) -> np.ndarray:
    """32 bits of a hash of every word."""
    import xxhash

    starts, ends = word_places(raw)
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    piece, done = max(SEGMENT, LONG_WORD), 0
    while done < len(short):
        origin = starts[short[done]]
        own = short[done : int(np.searchsorted(ends[short], origin + piece, side="right"))]
        part = raw[origin : ends[own[-1]]]
        up, down = _powers(piece)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        a, b = starts[own] - origin, ends[own] - origin
        out[own] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)) >> np.uint64(32)
        done += len(own)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh32_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def anchors(symbols: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """For each anchor of a text: its hash, its context's hash, its place, and its first and last window, counted in symbols."""
    found = []
    length, anchor = unit.length, unit.anchor
    for first in range(0, len(symbols) - length + 1, SEGMENT):
        part = symbols[first : first + SEGMENT + length - 1]
        up, down = _powers(SEGMENT + length)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        runs = _mix((sums[anchor:] - sums[:-anchor]) * down[: len(part) - anchor + 1])
        low = np.uint64((1 << 24) - 1)
        place = (_slide_min((runs & ~low) | np.arange(len(runs), dtype=np.uint64), length - anchor + 1) & low).astype(np.int64)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        end = np.append(start[1:], len(place)) - 1
        at = place[start]
        shape = (end - start).astype(np.uint64) * np.uint64(1 << 20) + (at - start).astype(np.uint64)
        context = _mix(_mix((sums[end + length] - sums[start]) * down[start]) + shape * _B)
        # a smallest hash is a small number: it is mixed again, or nearly all anchors would go to the first partition
        found.append((_mix(runs[at] + _B + np.uint64(unit.width)), context, at + first, start + first, end + first))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _of_block(table: pa.Table, text: str, units: tuple[Unit, ...]):
    """The texts' bytes and offsets, and for each unit the symbols and the anchors of every text (None for those too short)."""
    begin("suffixes")
    release()
    raw, at = utf8(table.column(text))
    bodies = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    symbols = [[word_symbols(b) for b in bodies] if u.words else bodies for u in units]
    each = [[anchors(s, u) if len(s) >= u.length else None for s in own] for u, own in zip(units, symbols, strict=True)]
    return bodies, symbols, each


def repeats(symbols: list[np.ndarray], groups: np.ndarray, mids: list[int], lows: list[int], span: int, width: int = 1) -> list[list[tuple[int, int]]]:
    """For each context (bytes before and after its core, which is the symbol at ``mids``) the distances before the core, as ranges, at which windows repeat in its group; windows begin at every ``width``-th byte."""
    rank = np.unique(groups, return_inverse=True)[1]
    text = np.concatenate(symbols)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in symbols])))
    core = starts[:-1] + np.array(mids)
    text[core] = 256 + rank
    window = np.zeros(len(text), bool)
    for c, m, low in zip(core.tolist(), mids, lows, strict=True):
        window[c - m : c - low + 1 : width] = True
    order = sorted_suffixes(text, span + 1)
    order = order[window[order]]
    shared = adjacent_prefixes(text, order, span + 1) > span
    twice = shared | np.append(shared[1:], False)
    hit = np.zeros(len(text), bool)
    hit[order[twice]] = True
    found = []
    for c, m in zip(core.tolist(), mids, strict=True):
        own = np.flatnonzero(hit[c - m : c + 1])
        cut = np.flatnonzero(np.diff(own) > width)
        found.append([(m - int(b), m - int(a)) for a, b in zip(own[np.concatenate(([0], cut + 1))], own[np.append(cut, len(own) - 1)], strict=True)] if len(own) else [])
    return found


#: Classes of equal contexts of one anchor; distances from the anchor, low to the bytes of before, are counted in bytes of symbols.
_CLASS = "g long, u long, before binary, after binary, low int, n long"
_RANGE = "g long, u long, low int, high int"


def _sort_groups(classes: DataFrame, span: int, width: int) -> DataFrame:
    """Rows (g, u, low, high): ranges of distances at which a class's windows repeat within its group."""
    small_batches(classes.sparkSession)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            symbols = [np.frombuffer(b + b"\0" + a, np.uint8).astype(np.int64) for _, _, b, a, _ in rows]
            found = repeats(symbols, np.array([r[0] for r in rows]), [len(r[2]) for r in rows], [r[4] for r in rows], span, width)
            flat = [(r[0], r[1], lo, hi) for r, ranges in zip(rows, found, strict=True) for lo, hi in ranges]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["g", "u", "low", "high"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if size >= SORTED_SYMBOLS and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + len(row[3]) + 1
        if held:
            yield out(held)

    return classes.select("g", "u", "before", "after", "low").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, _RANGE)


def _cut(classes: DataFrame, span: int, band: int, width: int) -> DataFrame:
    """The classes' windows dealt by the string that neighbouring windows, within ``band`` bytes, share: rows of a class of its own, with (pg, pu, shift) of the class it is cut from."""
    small_batches(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out = []
            for g, u, before, after, low, n in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                for b in range(low // band, len(before) // band + 1):
                    nearest = min(b * band, span + width - band)  # a short last band begins earlier, so that its windows have the same inner span
                    furthest = nearest + band - width
                    first, last = min(len(before), furthest), max(low, b * band)  # the distances of this class in the band
                    core = before[len(before) - nearest :] + b"|" + after[: span - furthest]
                    left = before[len(before) - first : len(before) - nearest]
                    right = after[span - furthest : span - last]
                    key = xxhash.xxh64_intdigest(g.to_bytes(8, "little", signed=True) + b.to_bytes(4, "little") + core)
                    own = xxhash.xxh64_intdigest(key.to_bytes(8, "little") + bytes([len(left), last - nearest]) + left + b"|" + right)
                    out.append((signed(key), signed(own), left, right, last - nearest, n, g, u, nearest))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["g", "u", "before", "after", "low", "n", "pg", "pu", "shift"])

    return classes.select("g", "u", "before", "after", "low", "n").mapInArrow(run, _CLASS + ", pg long, pu long, shift int")


def _merged(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("g", "u").agg(F.min("before").alias("before"), F.min("after").alias("after"), F.min("low").alias("low"), F.sum("n").alias("n")))


def _repeated(classes: DataFrame, span: int, width: int, bands: tuple[int, ...]) -> DataFrame:
    """Rows (g, u, low, high) for stored classes, one row for each (g, u); n is how often it occurs."""
    whole = lambda rows: rows.filter("n > 1").select("g", "u", "low", F.length("before").alias("high"))
    if span == 0:
        return whole(classes)
    sizes = stored(classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes")))
    some = sizes.filter((F.col("classes") > 1) & (F.col("classes") <= GROUP_ROWS)).select("g")
    found = whole(classes).unionByName(_sort_groups(classes.join(some, "g", "left_semi"), span, width))
    many = sizes.filter(F.col("classes") > GROUP_ROWS).select("g")
    if many.limit(1).count():
        band = min(bands[0] * width, span + width)
        cut = stored(_cut(stored(classes.join(many, "g", "left_semi")), span, band, width))
        inner = stored(_repeated(_merged(cut), band - width, width, bands[1:]))
        links = cut.select("g", "u", "pg", "pu", "shift").join(inner, ["g", "u"])
        found = found.unionByName(links.select(F.col("pg").alias("g"), F.col("pu").alias("u"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high")))
    return found


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans merged where they overlap or touch."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _bytes_of(body: np.ndarray, unit: Unit, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans of bytes for spans of symbols."""
    starts, ends = spans_of(starts, ends)
    if not unit.words or not len(starts):
        return starts, ends
    first, last = word_places(body)
    return first[starts], last[ends - 1]


def without(body: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The bytes outside merged spans."""
    cuts = np.concatenate(([0], np.stack(spans, axis=1).reshape(-1), [len(body)])).tolist()
    return b"".join(body[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True))


def remove(docs: DataFrame, made: Callable[..., tuple], added: T.StructType, types: list[pa.DataType], units: tuple[Unit, ...] = (BYTES,), text: str = "text") -> DataFrame:
    """docs' other columns with what ``made`` makes of each text's bytes and, for each unit, the merged spans of bytes (starts, ends) that its repeated windows cover."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    own = {f.name for f in added.fields} | {text}
    kept = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name not in own]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_sd_text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("_sd_text")), F.lit(0))).first()[0])
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(0, int(np.ceil(np.log2(max(1.0, size * SENT_PER_BYTE / PARTITION_BYTES)))))
    mixed = F.xxhash64("_sd_text") if not any(f.name == "doc_id" for f in kept) else F.xxhash64("doc_id", "_sd_text")
    dealt = rows.withColumn("_sd_block", F.pmod(mixed, F.lit(blocks)).cast("long"))
    kept_names, added_names = [f.name for f in kept], added.fieldNames()
    nothing = np.zeros(0, np.int64)

    def distinct(each) -> tuple[np.ndarray, ...]:
        """The block's anchors in order: hash, a context, how often (1 or 2 for more), and whether there are several contexts."""
        some = [e for of_unit in each for e in of_unit if e is not None]
        g = np.concatenate([e[0] for e in some]) if some else np.zeros(0, np.uint64)
        u = np.concatenate([e[1] for e in some]) if some else np.zeros(0, np.uint64)
        by = np.lexsort((u, g))
        g, u = g[by], u[by]
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else nothing
        last = np.append(edge[1:], len(g)) - 1 if len(g) else edge
        return g[edge], u[edge], np.minimum(2, last - edge + 1), u[edge] != u[last]

    def send(table: pa.Table) -> pa.Table:
        _, _, each = _of_block(table, "_sd_text", units)
        g, u, times, several = distinct(each)
        part = (g >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), np.int64)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(g)).tolist()  # only partitions that get something
        block = table.column("_sd_block")[0].as_py()
        out = [(int(part[a]), block, b - a, _pack(g[a:b]), u[a:b].tobytes(), (times[a:b] + 4 * several[a:b]).astype(np.uint8).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "block", "n", "keys", "contexts", "flags"])

    def judge(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        g = np.concatenate([_unpack(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        u = np.frombuffer(b"".join(table.column("contexts").to_pylist()), np.uint64)
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)
        by = np.argsort(g, kind="stable")
        new = np.concatenate(([True], g[by][1:] != g[by][:-1]))
        edge = np.flatnonzero(new)
        times = np.add.reduceat((flags & 3)[by].astype(np.int64), edge)
        differ = np.maximum.reduceat(u[by], edge) != np.minimum.reduceat(u[by], edge)
        several = differ | (np.maximum.reduceat((flags & 4)[by], edge) > 0)
        state = np.where(several, SEVERAL, np.where(times > 1, SAME, ALONE)).astype(np.uint8)
        answer = np.empty(len(g), np.uint8)
        answer[by] = state[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        return pa.table([table.column("block").combine_chunks(), table.column("part").combine_chunks(), pa.array([answer[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())], names=["block", "part", "states"])

    mid = T.StructType(
        kept
        + [T.StructField(f.name, f.dataType, True) for f in added.fields]
        + [T.StructField("_sd_row", T.LongType()), T.StructField("_sd_text", T.StringType()), T.StructField("_sd_sure", T.BinaryType()), T.StructField("_sd_open", T.BinaryType())]
        + [T.StructField(f"_sd_{n}", t) for n, t in (("g", T.LongType()), ("u", T.LongType()), ("before", T.BinaryType()), ("after", T.BinaryType()), ("low", T.IntegerType()), ("n", T.LongType()), ("k", T.IntegerType()))]
    )

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        bodies, symbols, each = _of_block(table, "_sd_text", units)
        g, _, _, _ = distinct(each)
        states = np.frombuffer(b"".join(answers.sort_by("part").column("states").to_pylist()), np.uint8) if len(g) else np.zeros(0, np.uint8)
        texts = table.column("_sd_text").combine_chunks()
        block = table.column("_sd_block")[0].as_py() if table.num_rows else 0
        done: list[tuple | None] = []
        waiting, sure, unsure = [], [], []
        classes: dict[tuple[int, int], list] = {}
        for i, body in enumerate(bodies):
            spans, keys = [], []
            for k, unit in enumerate(units):
                e = each[k][i]
                if e is None:
                    spans.append((nothing, nothing))
                    continue
                state = states[np.searchsorted(g, e[0])]
                same, several = state == SAME, np.flatnonzero(state == SEVERAL)
                spans.append(spans_of(e[3][same], e[4][same] + unit.length))
                keys.append(np.stack([np.full(len(several), k), e[0][several].view(np.int64), e[1][several].view(np.int64), e[2][several]]))
                for key, ctx, place, first, last in zip(*[c[several].tolist() for c in e], strict=True):
                    seen = classes.get((key, ctx))
                    if seen:
                        seen[3] += 1
                    else:
                        own = symbols[k][i]
                        classes[key, ctx] = [own[first:place].tobytes(), own[place + unit.anchor : last + unit.length].tobytes(), (place - last) * unit.width, 1, k]
            is_open = any(x.shape[1] for x in keys)
            done.append(None if is_open else made(body, *[_bytes_of(body, u, a, b) for u, (a, b) in zip(units, spans, strict=True)]))
            waiting.append(texts[i].as_py() if is_open else None)
            sure.append(np.concatenate([np.stack([np.full(len(a), k), a, b]) for k, (a, b) in enumerate(spans)], axis=1).astype(np.int64).tobytes() if is_open else None)
            unsure.append(np.concatenate(keys, axis=1).tobytes() if is_open else None)
        n, m = table.num_rows, len(classes)
        pad = lambda column, t: pa.concat_arrays([column.cast(t), pa.nulls(m, t)])
        arrays = [pad(table.column(f.name).combine_chunks(), table.schema.field(f.name).type) for f in kept]
        arrays += [pa.array([d[k] if d else None for d in done] + [None] * m, t) for k, t in enumerate(types)]
        arrays += [pa.array([(block << 32) + i for i in range(n)] + [None] * m, pa.int64()), pa.array(waiting + [None] * m, pa.string()), pa.array(sure + [None] * m, pa.binary()), pa.array(unsure + [None] * m, pa.binary())]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        arrays += [pa.array([None] * n + [signed(k[j]) for k in classes], pa.int64()) for j in (0, 1)]
        arrays += [pa.array([None] * n + [v[j] for v in classes.values()], t) for j, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()))]
        out = pa.table(arrays, names=mid.fieldNames())
        return pa.Table.from_batches(out.to_batches(max_chunksize=TEXT_ROWS), schema=out.schema)

    sent = dealt.groupBy("_sd_block").applyInArrow(send, "part long, block long, n int, keys binary, contexts binary, flags binary")
    judged = sent.groupBy("part").applyInArrow(judge, "block long, part long, states binary")
    settled = stored(dealt.groupBy("_sd_block").cogroup(judged.groupBy("block")).applyInArrow(settle, mid))
    ranges = None
    for k, unit in enumerate(units):
        classes = _merged(settled.filter(F.col("_sd_k") == k).select(*[F.col(f"_sd_{c}").alias(c) for c in ("g", "u", "before", "after", "low", "n")]))
        back = lambda c, unit=unit: (F.col(c) / unit.width).cast("long").alias(c)
        found = _repeated(classes, unit.span, unit.width, BANDS).select(F.lit(k).alias("k"), "g", "u", back("low"), back("high"))
        ranges = found if ranges is None else ranges.unionByName(found)
    ranges = stored(ranges)
    rows_of = settled.filter("_sd_row IS NOT NULL")
    open_rows = rows_of.filter("_sd_text IS NOT NULL")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(p, np.int64).reshape(4, -1) for p in batch.column(1).to_pylist()]
            row = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [e.shape[1] for e in each])
            k, g, u, place = np.concatenate(each, axis=1) if each else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(k.astype(np.int32)), pa.array(g), pa.array(u), pa.array(place)], names=["_sd_row", "k", "g", "u", "place"])

    hits = stored(open_rows.select("_sd_row", "_sd_open").mapInArrow(places, "_sd_row long, k int, g long, u long, place long")).join(ranges, ["k", "g", "u"])
    length = F.element_at(F.array(*[F.lit(u.length) for u in units]), F.col("k") + 1)
    per_row = hits.groupBy("_sd_row").agg(F.collect_list(F.struct("k", (F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + length).alias("b"))).alias("_sd_found"))
    finished = open_rows.select(*[f"`{n}`" for n in kept_names], "_sd_row", "_sd_text", "_sd_sure").join(stored(per_row), "_sd_row", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_sd_text"):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            found = column("_sd_found")
            edges = found.offsets.to_numpy()
            of, first, last = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw, at = utf8(column("_sd_text"))
            out = []
            for i, s in enumerate(column("_sd_sure").to_pylist()):
                k, a, b = np.frombuffer(s, np.int64).reshape(3, -1)
                if found[i].is_valid:
                    more = slice(edges[i], edges[i + 1])
                    k, a, b = np.concatenate([k, of[more]]), np.concatenate([a, first[more]]), np.concatenate([b, last[more]])
                body = raw[at[i] : at[i + 1]]
                out.append(made(body, *[_bytes_of(body, unit, a[k == j], b[k == j]) for j, unit in enumerate(units)]))
            yield pa.RecordBatch.from_arrays([column(n) for n in kept_names] + [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=kept_names + added_names)

    schema = T.StructType(kept + added.fields)
    ready = rows_of.filter("_sd_text IS NULL").select(*[f"`{n}`" for n in kept_names + added_names])
    return ready.union(finished.mapInArrow(finish, schema))


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words): the first for BYTES; then the passages of PASSAGES that stand elsewhere too, and the words in them, which are told but not removed."""
    names = ("n_bytes", "n_removed", "n_spans")
    added = T.StructType([*[T.StructField(n, T.LongType()) for n in names], T.StructField("kept_sha256", T.StringType()), T.StructField("n_passages", T.LongType()), T.StructField("n_passage_words", T.LongType())])

    def made(body, cut, passages):
        words = sum(len(word_places(body[a:b])[0]) for a, b in zip(*passages, strict=True))
        return len(body), int((cut[1] - cut[0]).sum()), len(cut[0]), hashlib.sha256(without(body, cut)).hexdigest(), len(passages[0]), words

    return remove(docs.select("doc_id", "text"), made, added, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2, (BYTES, PASSAGES))


def deduplicated(docs: DataFrame, text: str = "text", units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """docs with the repeated strings removed from the text; halves of characters that a cut leaves are dropped too. Columns keep their order."""
    added = T.StructType([T.StructField(text, T.StringType())])

    def made(body, *spans):
        every = spans_of(np.concatenate([a for a, _ in spans]), np.concatenate([b for _, b in spans]))
        return (without(body, every).decode("utf-8", "ignore"),)

    return remove(docs, made, added, [pa.string()], units, text).select(*[f"`{c}`" for c in docs.columns])
