"""SimHash near-duplicates, with candidates from the pigeonring principle.

A fingerprint is cut into SEGMENTS segments on a ring. If two fingerprints differ in at most ``distance`` bits,
some segment starts a chain whose first l segments together differ in at most l * distance / SEGMENTS bits, for
every l. The longest chain whose budget is still zero is an equality, so it is the key of a join; the rest of the
chain is checked on each pair of a bucket before the full Hamming distance. Equal fingerprints are one row there.

A bucket never becomes all its pairs: a task compares a bucket in numpy and returns a spanning forest of the links it
found. A bucket of more than BUCKET_ROWS rows is cut into blocks, and every two blocks of it meet in a task of their own.

Cases: a null or empty text, or one of white space alone, has fingerprint zero, which links like any other. Fewer words than
a shingle takes: the whole sequence is the only shingle. Repeated rows are equal fingerprints. Rows without an id have the component of rows with an id and the same fingerprint, null without such rows. ``groups``
ignores extra columns, whatever their names; ``without_copies`` keeps all columns, and its own have names that begin with ``_sh_``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestream.llm.components import components
from lodestream.llm.shared import slices, small_batches, stored, utf8

#: Segments of 4 bits; with distance 3 the first five of a chain are equal, a key of 20 bits.
SEGMENTS = 16
KEY_BITS = 20
#: Rows of a bucket that one task compares with each other.
BUCKET_ROWS = 2048
#: Buckets of up to so many rows are compared by shifts over the whole batch, larger ones by matrices.
SHIFTED_ROWS = 48
SEED = 42


def shingle_hashes(text: bytes, words_each: int) -> list[int]:
    """XXH64 of each shingle of an ASCII-lower-cased text; words are runs without ASCII white space."""
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - words_each] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    return fingerprint_of(np.array(hashes, dtype=np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            raw, at = utf8(piece.column(1))
            whole = raw.tobytes()
            found = np.array([fingerprint(shingle_hashes(whole[a:b], words_each)) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Which pairs pass the chain from their segment on, and then the full Hamming check."""
    width = 64 // segments
    differ = a ^ b
    turned = (differ << start) | (differ >> ((np.uint64(64) - start) & np.uint64(63)))
    turned = np.where(start == 0, differ, turned)
    alive = np.ones(len(a), bool)
    for length in range(1, segments + 1):  # the chain's first segments are the upper bits after the turn
        at = np.flatnonzero(alive)
        if not len(at):
            return at
        head = turned[at] >> np.uint64(64 - width * length)
        alive[at] = np.bitwise_count(head) <= length * distance // segments
    return np.flatnonzero(alive)


def _forest(n: int, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of the links a[i] - b[i] those that join what earlier ones haven't joined."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _links(run: np.ndarray, keys: np.ndarray, sides: np.ndarray, fps: np.ndarray, reps: np.ndarray, distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by run, a bucket or two blocks of one; sides tells the two blocks apart."""
    start = ((keys >> np.int64(KEY_BITS)) % segments).astype(np.uint64) * np.uint64(64 // segments)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _near(fps[i], fps[j], start[i], distance, segments)

    edge = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(np.append(edge, len(run)))
    size_of = np.repeat(size, size)
    u, v = [], []
    small = np.flatnonzero(size_of <= SHIFTED_ROWS)
    for shift in range(1, SHIFTED_ROWS):
        small = small[small + shift < len(run)]
        small = small[run[small] == run[small + shift]]
        if not len(small):
            break
        hit = small[near(small, small + shift)]
        u.append(reps[hit])
        v.append(reps[hit + shift])
    for at, n in zip(edge[size > SHIFTED_ROWS].tolist(), size[size > SHIFTED_ROWS].tolist(), strict=True):
        side = sides[at : at + n]
        cut = side.min() != side.max()
        x, y = [], []
        for i in range(n):
            j = np.arange(i + 1, n) if not cut else i + 1 + np.flatnonzero(side[i + 1 :] != side[i])
            hit = j[near(np.full(len(j), at + i), j + at)]
            x += [i] * len(hit)
            y += hit.tolist()
            if len(x) > 1 << 16:
                kept = _forest(n, x, y)
                x, y = [a for a, _ in kept], [b for _, b in kept]
        kept = _forest(n, x, y)
        u.append(reps[at : at + n][[a for a, _ in kept]] if kept else reps[:0])
        v.append(reps[at : at + n][[b for _, b in kept]] if kept else reps[:0])
    return np.concatenate([reps[:0], *u]), np.concatenate([reps[:0], *v])


def links(classes: DataFrame, distance: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """Rows (u, v): enough links between the classes (fps, rep) to join all that are linked.

    Two classes link if one of their signatures fps, the same for both, is within ``distance`` bits.
    """
    spark = classes.sparkSession
    width = 64 // segments
    chain = max(n for n in range(1, segments + 1) if n * distance < segments)
    bits = min(KEY_BITS, width * chain)  # the rest of a longer chain is checked on the pairs
    turned = lambda x, s: F.shiftleft(x, width * s).bitwiseOR(F.shiftrightunsigned(x, 64 - width * s)) if s else x
    keys = lambda x, k: F.array(*[((k * segments + s) * (1 << KEY_BITS) + F.shiftrightunsigned(turned(x, s), 64 - bits)).cast("long") for s in range(segments)])
    each = classes.select(F.posexplode("fps").alias("k", "fp"), "rep")
    rows = stored(each.select(F.explode(keys(F.col("fp"), F.col("k"))).alias("key"), "fp", "rep"))
    large = stored(rows.groupBy("key").count().filter(F.col("count") > BUCKET_ROWS).select("key", F.ceil(F.col("count") * 2 / BUCKET_ROWS).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = rows.join(large, "key").select("key", "fp", "rep", mine.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("key", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "fp", "rep")
    whole = rows.join(large, "key", "left_anti").select("key", F.lit(0).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.unionByName(cut).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, side, i, j, fp, rep = rows
            change = np.diff(key, prepend=key[:1]) | np.diff(i, prepend=i[:1]) | np.diff(j, prepend=j[:1])
            u, v = _links(np.cumsum(change != 0), key, side, fp.view(np.uint64), rep, distance, segments)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < 4 * BUCKET_ROWS:
                continue
            now = [np.concatenate(c) for c in zip(*held, strict=True)]
            key, _, i, j, *_ = now
            whole = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))  # the last bucket may go on
            done = int(whole[-1]) + 1 if len(whole) else 0
            held = [[c[done:] for c in now]]
            if done:
                yield found([c[:done] for c in now])
        if held:
            yield found([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.mapInArrow(run, "u long, v long")


def _components(prints: DataFrame, same: list[str], distance: int, segments: int) -> DataFrame:
    """prints (doc_id and the columns ``same``, in which copies are equal) with component_id."""
    classes = stored(prints.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes.filter("rep IS NOT NULL"), distance, segments))
    of_class = classes.join(joined, classes["rep"] == joined["node"], "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(stored(of_class), same)


def groups(docs: DataFrame, words_each: int = 3, distance: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, the row's own included."""
    prints = stored(fingerprints(docs, words_each, text, key).select("doc_id", F.array("fp").alias("fps")))
    return _components(prints, ["fps"], distance, SEGMENTS).select("doc_id", F.element_at("fps", 1).alias("fp"), "component_id")


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id, with all its columns. Rows without an id stay; rows that repeat an id are told apart by their texts."""
    from lodestream.llm import nearcopies

    found = nearcopies.kept(docs, text, key)
    kept = stored(found.select(F.col("doc_id").alias("_sh_id"), F.col("hash").alias("_sh_hash")))
    own = docs.withColumns({"_sh_id": F.col(key).cast("long"), "_sh_hash": F.xxhash64(text)})
    # the texts are dealt once, by id: the join's order serves the numbering of rows that are equal throughout
    same = Window.partitionBy("_sh_id", "_sh_hash").orderBy("_sh_id", "_sh_hash")
    once = own.join(kept.hint("merge"), ["_sh_id", "_sh_hash"]).withColumn("_sh_n", F.row_number().over(same)).filter("_sh_n = 1")
    columns = [f"`{c}`" for c in docs.columns]
    return once.select(*columns).unionByName(own.filter("_sh_id IS NULL").select(*columns))
