"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of four fifths or more, all of them and no others.

1. Texts with equal sets are one class. Its SimHash fingerprint is made of its shingles, and fingerprints within DISTANCE bits, found by the pigeonring's chains, make candidates. These are the closest pairs: at four
   fifths two fingerprints differ in ten bits on average, and no chain is selective there. So the candidates beyond are added by a filter that loses no pair, and all candidates meet the same exact check.
2. The filter: in an order of all shingles that is the same for every class, two similar sets share one of the first ``n // 5 + 1`` of their n shingles (prefix filter), so
   these are the keys of a join. Shingles that a sample of the texts has often come last in the order; whatever the sample is, no pair is lost. Large sets share one of so many shingles with too many
   others, and no few bits tell them apart. They are compared in classes of size, each with the next, and dealt by their hashes into more parts than similar sets of a class can differ in: as some
   parts are then equal throughout, the parts that aren't empty are the keys.
   Two rows of a bucket are candidates unless the sizes, the places of the key or the parities of 256 parts of the sets, which can't differ in more places than the sets do, rule it out. Sets of over
   SKETCHED shingles are too large for these parities to tell apart; one bit of each of 256 min-hashes does, of which similar sets share nine tenths and others about half. Without it chance keys join
   ever more unlike sets as the table grows, and in the end most of them are one group. A similar pair passes but for a chance under 1e-14, less than that of two equal hashes in a large table.
   A bucket returns no pairs but a spanning forest of its candidates, which joins the same classes; one of over BUCKET_ROWS rows is cut into blocks, every two of which meet in a task.
3. What candidates join is a group. The whole sets of a group meet, once each, in one task. Those of a large group meet in classes of size, each with the next, as similar sets have similar sizes; and block by
   block where a class is large itself. Every two that no earlier link joins are compared, first by parities of as many parts as the sets are large, then exactly; again a spanning forest is
   returned, of the links of four fifths or more. Its components are the copies.

The two large exchanges, of keys and of whole sets, go in as many rounds as keep each near ROUND_BYTES for a shingle of the input, however often rows are sent; a round's shuffle goes before the next.

Shingles and sets are known by hashes of 64 bits. Cases: texts without a word are one class, which links to nothing; texts under five words have one shingle. Rows without an id aren't compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestream.llm.components import components
from lodestream.llm.ngramlm import _mix
from lodestream.llm.shared import discard, free_shuffles, slices, small_batches, stored, utf8
from lodestream.llm.simhash import BUCKET_ROWS, SEED, SHIFTED_ROWS, fingerprint_of, links, shingle_hashes

WORDS = 5
#: Bits in which the fingerprints of candidates differ at most.
DISTANCE = 3
#: Texts whose shingles are counted, how often a frequent one occurs among them, and how many are known at most (16 bytes each, on the driver and in the tasks).
SAMPLE_TEXTS, FREQUENT, FREQUENT_SHINGLES = 8000, 4, 100_000
#: One in so many classes tells which buckets are large.
SIZED = 16
#: Shingles of a large set.
LARGE = 1000
#: Parts of a set whose parities are compared.
PARTS = 256
#: Sets of more shingles have a sketch of so many bits, in which candidates differ in at most SKETCH_DIFFER; each bit of two sets at four fifths differs with a chance of a tenth.
SKETCHED, SKETCH_BITS, SKETCH_DIFFER = 400, 256, 72
#: Sets, and shingles in them, that one task compares with each other, and rows with sets in an Arrow batch.
GROUP_SETS, GROUP_SHINGLES, SET_ROWS = 4096, 1 << 22, 100
#: Similar sets differ in size by a factor of at most 1.25, so by one class at most.
SIZE_STEP = 1.26
#: Bytes of parities that a task holds.
MAP_BYTES = 32 << 20
#: Bytes that a round of an exchange sends for each shingle of all sets, about, and the least that a round is made for; bytes of a key's row in a shuffle; one in so many partitions writes what a round found, as that is little.
ROUND_BYTES, LEAST_ROUND, KEY_BYTES, WRITERS = 3, 64 << 20, 24, 16
#: Odd factors of the min-hashes.
_FACTORS = _mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of the text's shingles, sorted, each once."""
    return np.unique(np.array(shingle_hashes(text, WORDS), np.uint64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of a set's hashes by their count in the sample, then by themselves; similar sets share one of them."""
    if not len(hashes):
        return hashes
    count = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        count = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, count))[: len(hashes) // 5 + 1]]


def parts_of(hashes: np.ndarray, common: np.ndarray, unit: int) -> np.ndarray:
    """Keys of the parts of a set, for comparison with sets of the class of size ``unit`` or the one below. Their sizes are under SIZE_STEP ** (unit + 1), so similar ones differ in at most two
    ninths of that many shingles, and of the parts one in six at least is equal. Parts that are empty or hold common shingles alone tell little, and are keys only where they are that many."""
    differ = 2 * int(SIZE_STEP ** (unit + 1)) // 9
    many = differ + 1 + differ // 5
    part = ((hashes >> np.uint64(8)) % np.uint64(many)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    sums = np.add.reduceat(_mix(hashes[order]), edge, dtype=np.uint64)
    place = part[order][edge]
    telling = np.logical_or.reduceat(~common[order], edge)
    if telling.sum() > differ:
        sums, place = sums[telling], place[telling]
    else:
        sums, place = np.concatenate([sums, np.zeros(many - len(edge), np.uint64)]), np.concatenate([place, np.setdiff1d(np.arange(many), place)])
    return _mix(sums + _mix(place.astype(np.uint64) + (np.uint64(unit) << np.uint64(40))))


def keys_of(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's prefix, and its keys as a large set; one or the other, and both at the classes' border."""
    if not len(hashes):
        return hashes, hashes
    own = int(math.log(len(hashes)) / math.log(SIZE_STEP))
    units = [u for u in (own, own + 1) if SIZE_STEP**u > LARGE]
    common = np.isin(hashes, frequent)
    return prefix(hashes, frequent, counts) if own not in units else hashes[:0], np.concatenate([hashes[:0], *[parts_of(hashes, common, u) for u in units]])


def parities(hashes: np.ndarray, parts: int = PARTS) -> bytes:
    return np.packbits((np.bincount((hashes & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8)).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """One bit of each of SKETCH_BITS min-hashes."""
    least = np.full(SKETCH_BITS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 256):
        np.minimum(least, (short[i : i + 256, None] * _FACTORS).min(axis=0), out=least)
    return np.packbits(((least >> np.uint32(4)) & np.uint32(1)).astype(np.uint8)).tobytes()


def map_of(hashes: np.ndarray) -> bytes:
    """The parities of a set that may be similar to one of at most SKETCHED shingles, then the sketch of a larger one; zeros for what a set hasn't."""
    small = parities(hashes) if 4 * len(hashes) <= 5 * SKETCHED else bytes(PARTS // 8)
    return small + (sketch(hashes) if len(hashes) > SKETCHED else bytes(SKETCH_BITS // 8))


def spanning(sides: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the rows: linked(i, js) tells which of js row i is linked with. Rows of two sides link across only. A row is compared with those alone that nothing has joined yet."""
    cut = len(sides) > 0 and sides[0] != sides[-1]
    left = np.ones(len(sides), bool)
    a: list[int] = []
    b: list[int] = []
    for first in range(len(sides)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            i = todo.pop()
            others = np.flatnonzero(left & (sides != sides[i])) if cut else np.flatnonzero(left)
            if not len(others):
                continue
            hit = others[linked(i, others)]
            left[hit] = False
            a += [i] * len(hit)
            b += hit.tolist()
            todo += hit.tolist()
    return a, b


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a[i] - b[i] among n nodes make a spanning forest: every tree but the smallest hooks on a smaller one, again and again."""
    label, open_links, kept = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a[open_links]], label[b[open_links]]
        apart = x != y
        open_links, high, low = open_links[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(open_links):
            return np.concatenate(kept) if kept else open_links
        trees, at = np.unique(high, return_index=True)
        kept.append(open_links[at])
        parent = np.arange(n)
        parent[trees] = low[at]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]


def _texts(rows: DataFrame, make, schema: str, carried: str) -> DataFrame:
    """The columns ``carried`` of rows, and make(shingle set) of each row's text."""
    fields = [part.split() for part in (carried + ", " + schema).split(", ")]
    names = [n for n, _ in fields]
    n_carried = len(carried.split(", "))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            raw, at = utf8(piece.column(n_carried))
            whole = raw.tobytes()
            out = [make(shingle_set(whole[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            made = [pa.array([o[i] for o in out], types[kind]) for i, (_, kind) in enumerate(fields[n_carried:])]
            yield pa.RecordBatch.from_arrays([*piece.columns[:n_carried], *made], names=names)

    small_batches(rows.sparkSession)
    return rows.select(*names[:n_carried], "text").mapInArrow(run, carried + ", " + schema)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the different texts, sorted, and their counts."""
    many = rows.count()
    every = max(1, -(-many // SAMPLE_TEXTS))
    sample = rows.filter(F.pmod(F.xxhash64("hash"), F.lit(every)) == 0).dropDuplicates(["hash"])
    counted = _texts(sample, lambda s: (s.view(np.int64).tolist(),), "shingles array<long>", "hash long").select(F.explode("shingles").alias("s")).groupBy("s").count()
    found = counted.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(FREQUENT_SHINGLES).collect()
    hashes = np.array([r["s"] for r in found], np.int64).view(np.uint64)
    by = np.argsort(hashes)
    return hashes[by], np.array([r["count"] for r in found], np.int64)[by]


def _pairs(run: np.ndarray, sides: np.ndarray, n: np.ndarray, place: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows sorted by run, a bucket or two blocks of one."""

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs that nothing rules out."""
        a, b = n[i], n[j]
        rest = np.minimum(a - place[i], b - place[j])  # if the key is the first shingle they share, they share no more than these
        hit = np.flatnonzero((4 * np.maximum(a, b) <= 5 * np.minimum(a, b)) & (9 * rest >= 4 * (a + b)))
        differ = np.bitwise_count(maps[i[hit]] ^ maps[j[hit]])
        most = PARTS // 64
        sketched = np.minimum(a, b)[hit] > SKETCHED
        return hit[np.where(sketched, differ[:, most:].sum(axis=1, dtype=np.int64) <= SKETCH_DIFFER, 9 * differ[:, :most].sum(axis=1, dtype=np.int64) <= (a + b)[hit])]

    edge = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(np.append(edge, len(run)))
    small = np.flatnonzero(np.repeat(size, size) <= SHIFTED_ROWS)
    u, v = [edge[:0]], [edge[:0]]
    for shift in range(1, SHIFTED_ROWS):
        small = small[small + shift < len(run)]
        small = small[run[small] == run[small + shift]]
        if not len(small):
            break
        hit = small[may(small, small + shift)]
        u.append(hit)
        v.append(hit + shift)
    for at, many in zip(edge[size > SHIFTED_ROWS].tolist(), size[size > SHIFTED_ROWS].tolist(), strict=True):
        def linked(i: int, js: np.ndarray, at: int = at) -> np.ndarray:
            mask = np.zeros(len(js), bool)
            mask[may(np.full(len(js), at + i), at + js)] = True
            return mask

        a, b = spanning(sides[at : at + many], linked)
        u.append(at + np.array(a, np.int64))
        v.append(at + np.array(b, np.int64))
    return np.concatenate(u), np.concatenate(v)


def rounds(sent: int | None, shingles: int) -> int:
    """In how many rounds an exchange of so many bytes goes."""
    return max(1, math.ceil((sent or 0) / max(LEAST_ROUND, ROUND_BYTES * shingles)))


def _in_rounds(n: int, made: Callable[[int], DataFrame]) -> DataFrame:
    """What made(0), made(1) ... give, each written before the next begins."""
    parts = []
    for r in range(n):
        found = made(r)
        writers = -(-int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) // WRITERS)
        parts.append(stored(found.repartition(writers, "u", "v")))
        free_shuffles(found.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def candidates(classes: DataFrame, shingles: int) -> DataFrame:
    """Rows (u, v) of classes (set, n, prefix, parts, map) with so many shingles in all: links that join all that may be similar."""
    spark = classes.sparkSession
    sized = classes.filter(F.pmod(F.col("set"), F.lit(SIZED)) == 0).select(F.explode(F.concat("prefix", "parts")).alias("key")).groupBy("key").count()
    large = stored(sized.filter(F.col("count") * SIZED > BUCKET_ROWS).select("key", F.ceil(F.col("count") * SIZED * 2 / BUCKET_ROWS).cast("int").alias("blocks"), "count"))
    again = large.agg(F.sum(F.col("count") * SIZED * (F.col("blocks") - 1))).first()[0]
    large = large.drop("count")
    n_rounds = rounds(KEY_BYTES * ((classes.agg(F.sum(F.size("prefix") + F.size("parts"))).first()[0] or 0) + (again or 0)), shingles)
    rows = classes.select(F.posexplode("prefix").alias("place", "key"), "set", "n", "map")
    rows = rows.unionByName(classes.select(F.lit(0).alias("place"), F.explode("parts").alias("key"), "set", "n", "map"))
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    names = ["key", "side", "i", "j", "set", "n", "place", "map"]
    blocks = F.coalesce("blocks", F.lit(1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(r: int) -> DataFrame:
        own = rows.filter(F.pmod(F.xxhash64("key"), F.lit(n_rounds)) == r).join(large, "key", "left").withColumn("side", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        own = own.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).select(*names)
        return own.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, side, i, j, name, n, place, packed = rows
            change = (np.diff(key, prepend=key[:1]) != 0) | (np.diff(i, prepend=i[:1]) != 0) | (np.diff(j, prepend=j[:1]) != 0)
            maps = np.frombuffer(b"".join(packed), np.uint64).reshape(len(key), -1)
            a, b = _pairs(np.cumsum(change), side, n.astype(np.int64), place.astype(np.int64), maps)
            nodes, at = np.unique(np.concatenate([name[a], name[b]]), return_inverse=True)
            kept = forest(at[: len(a)], at[len(a) :], len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(name[a[kept]]), pa.array(name[b[kept]])], names=["u", "v"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < 16 * BUCKET_ROWS:
                continue
            now = [np.concatenate(c) for c in zip(*held, strict=True)]
            key, _, i, j, *_ = now
            whole = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))  # the last bucket may go on
            done = int(whole[-1]) + 1 if len(whole) else 0
            held = [[c[done:] for c in now]]
            if done:
                yield found([c[:done] for c in now])
        if held and len(held[0][0]):
            yield found([np.concatenate(c) for c in zip(*held, strict=True)])

    return _in_rounds(n_rounds, lambda r: dealt(r).mapInArrow(run, "u long, v long"))


def _compared(sets: list[np.ndarray], sides: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join all similar sets."""
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    flat = np.concatenate(sets)
    parts = PARTS
    while parts < 2 * size.max() and len(sets) * parts // 4 <= MAP_BYTES:
        parts *= 2
    maps = np.frombuffer(b"".join(parities(s, parts) for s in sets), np.uint64).reshape(len(sets), -1)

    def linked(i: int, js: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(js), bool)
        js_fit = np.flatnonzero(5 * np.minimum(size[js], size[i]) >= 4 * np.maximum(size[js], size[i]))
        js_fit = js_fit[9 * np.bitwise_count(maps[js[js_fit]] ^ maps[i]).sum(axis=1, dtype=np.int64) <= size[js[js_fit]] + size[i]]
        if not len(js_fit):
            return mask
        own = js[js_fit]
        other = np.concatenate([flat[ends[j] - size[j] : ends[j]] for j in own.tolist()])
        at = np.minimum(np.searchsorted(sets[i], other), size[i] - 1)
        both = np.add.reduceat(sets[i][at] == other, np.concatenate(([0], np.cumsum(size[own])[:-1])), dtype=np.int64)
        mask[js_fit] = 5 * both >= 4 * (size[i] + size[own] - both)
        return mask

    return spanning(sides, linked)


def verified(texts: DataFrame, shingles: int) -> DataFrame:
    """Rows (u, v): links that join all similar sets of a group. texts has (group, units, set, n, text), units being the classes of size where the set meets others, and the number of blocks of each; shingles are those of the whole input."""
    spark = texts.sparkSession
    names = ["group", "unit", "i", "j", "side", "set", "shingles"]
    sent = texts.agg(F.sum(8 * F.col("n").cast("long") * F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + u["blocks"]))).first()[0]
    n_rounds = rounds(sent, shingles)

    def meetings(u):
        side = F.pmod(F.xxhash64("set"), u["blocks"]).cast("int")
        return F.transform(F.sequence(F.lit(0), u["blocks"] - 1), lambda other: F.struct(u["unit"].alias("unit"), F.least(side, other).alias("i"), F.greatest(side, other).alias("j"), side.alias("side")))

    def dealt(r: int) -> DataFrame:
        own = texts.withColumn("meets", F.filter(F.flatten(F.transform("units", meetings)), lambda m: F.pmod(F.xxhash64("group", m["unit"], m["i"], m["j"]), F.lit(n_rounds)) == r))
        small_batches(spark)
        sets = _texts(own.filter(F.size("meets") > 0), lambda s: (s.tobytes(),), "shingles binary", "set long, group long, meets array<struct<unit:int,i:int,j:int,side:int>>")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SET_ROWS))
        return sets.select("group", "set", "shingles", F.explode("meets").alias("m")).select("group", "m.unit", "m.i", "m.j", "m.side", "set", "shingles").select(*names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        now = None

        def found() -> pa.RecordBatch:
            name = list(held)
            a, b = _compared([s for _, s in held.values()], np.array([side for side, _ in held.values()]))
            return pa.RecordBatch.from_arrays([pa.array([name[i] for i in a], pa.int64()), pa.array([name[i] for i in b], pa.int64())], names=["u", "v"])

        for batch in batches:
            *keys, sides, name = (batch.column(k).to_pylist() for k in range(6))
            for k, key in enumerate(zip(*keys, strict=True)):
                if key != now:
                    if len(held) > 1:
                        yield found()
                    held, now = {}, key
                held[name[k]] = sides[k], np.frombuffer(batch.column(6)[k].as_py(), np.uint64)
        if len(held) > 1:
            yield found()

    keys = ["group", "unit", "i", "j"]
    return _in_rounds(n_rounds, lambda r: dealt(r).repartition(parts, *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "u long, v long"))


def _units(known: DataFrame) -> DataFrame:
    """known (set, doc_id, hash, n, group) with units (unit, blocks): one for a group of a task's size, else the set's class of size and the next."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_SETS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    of_group = known.groupBy("group").agg(size.alias("large"))
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    each = known.join(of_group, "group").withColumn("unit", F.explode(F.when(F.col("large") > 1, F.array(own, own + 1)).otherwise(F.array(F.lit(0)))))
    blocks = each.groupBy("group", "unit").agg(F.when(size > 1, 2 * size).otherwise(1).alias("blocks"))
    return each.join(blocks, ["group", "unit"]).groupBy("doc_id", "hash", "group", "set", "n").agg(F.array_sort(F.collect_set(F.struct("unit", "blocks"))).alias("units"))


def kept(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, hash), hash of the text: of each group of copies and near copies the row of the smallest id."""
    import xxhash

    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    frequent, counts = _frequent(rows)
    name = lambda s: np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64)
    made = lambda s: (name(s), len(s), int(np.uint64(fingerprint_of(s)).astype(np.int64)), *[k.view(np.int64).tolist() for k in keys_of(s, frequent, counts)], map_of(s))
    prints = _texts(rows, made, "set long, n int, fp long, prefix array<long>, parts array<long>, map binary", "doc_id long, hash long")
    first = F.min(F.struct("doc_id", "hash")).alias("row")
    keyed = stored(prints.groupBy("set").agg(first, *[F.first(c).alias(c) for c in ("n", "fp", "prefix", "parts", "map")]))
    free_shuffles(spark)
    classes = stored(keyed.select("set", "row", "n", "fp"))
    shingles = int(classes.agg(F.sum("n")).first()[0] or 0)
    filtered = candidates(keyed, shingles)
    discard(keyed)
    near = components(stored(links(classes.filter("n > 0").select(F.array("fp").alias("fps"), F.col("set").alias("rep")), DISTANCE).unionByName(filtered)))
    free_shuffles(spark)
    members = stored(near.select(F.col("node").alias("set"), F.col("component").alias("group")).unionByName(near.select(F.col("component").alias("set"), F.col("component").alias("group")).distinct()))
    known = stored(classes.select("set", "row.doc_id", "row.hash", "n").join(members, "set"))
    needed = stored(_units(known))
    # rows of one id and text have one class; the texts of the groups are written, so that theirs alone are read in each round
    texts = stored(rows.join(needed.hint("merge"), ["doc_id", "hash"]).groupBy("doc_id", "hash", "set", "n", "group").agg(F.min("text").alias("text"), F.min("units").alias("units")))
    free_shuffles(spark)
    joined = components(verified(texts, shingles))
    discard(texts)
    free_shuffles(spark)
    of_class = classes.join(joined, classes["set"] == joined["node"], "left").select(F.coalesce("component", "set").alias("component"), "row")
    return of_class.groupBy("component").agg(F.min("row").alias("row")).select("row.doc_id", "row.hash")
