"""Stupid-backoff scores of documents against all other documents.

S(w | h) is count(h w) / count(h) if h w occurs, else ALPHA times S(w | h less its first word), down to count(w) / tokens, and 1 / (tokens + 1) for
a word never seen. Counts are those of the whole table less the document's own, so a text doesn't vouch for itself; a copy elsewhere does.

The count tables are partitioned by the n-gram's hash and joined to the documents' n-grams, in columns of numbers rather than a row for each n-gram: documents
are dealt into blocks, a block sends each of its distinct n-grams once to the partition of its hash, with the number of times it has it (so a frequent n-gram is one entry
of each block, wherever it is hot), the partition adds up and answers with the totals, and the block sums the scores of each document. The n-grams of one length are counted at a time
and their totals written, so that no more than one length's are on the way.

Cases: a null or empty text, or one without a word, has no words, a sum of 0 and a null mean. Texts are read whole. Repeated rows are documents of their own. Words are
runs of ASCII letters, A-Z lower-cased, digits, and all characters beyond ASCII. N-grams are 64-bit hashes. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestream.llm.shared import free_shuffles, small_batches, stored, utf8

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a block, and bytes of n-grams in a partition of the counts; their numbers follow the input.
BLOCK_BYTES, PARTITION_BYTES = 4 << 20, 16 << 20
#: Bytes of n-grams of one length that a byte of text makes, at most, about.
KEYS_PER_BYTE = 1.0
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_TOTAL = np.uint64(0xD1B54A32D192ED03)  # stands for "any word": its count is the number of tokens
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for name, base in (("up", _B), ("down", inverse)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of the text that it stands in."""
    hashes, places = [], []
    is_word = _IS_WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    start, n = 0, len(raw)
    while start < n:
        stop = min(n, start + PIECE)
        if stop < n:  # cut between words
            gap = np.flatnonzero(~is_word[start:stop] | first[start + 1 : stop + 1])
            if len(gap):
                stop = start + int(gap[-1]) + 1
            else:
                later = np.flatnonzero(~is_word[stop:])
                stop = stop + int(later[0]) + 1 if len(later) else n
        own, edge = is_word[start:stop], first[start : stop + 1]
        before = np.concatenate(([False], own[:-1]))
        starts = np.flatnonzero(own & (~before | edge[:-1]))
        after = np.concatenate((own[1:], [False]))
        ends = np.flatnonzero(own & (~after | edge[1:])) + 1
        if len(starts):
            up, down = _powers(PIECE if stop - start <= PIECE else stop - start)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw[start:stop]].astype(np.uint64) + np.uint64(1)) * up[: stop - start], dtype=np.uint64)))
            hashes.append(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
            places.append(starts + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    where = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(at, where, side="right") - 1


def grams(word: np.ndarray, owner: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the keys of the n-grams and the place of each one's last word."""
    found, now = [], word
    for k in range(1, order + 1):
        if k > 1:
            now = now[:-1] * np.uint64(0xA24BAED4963EE407) + word[k - 1 :] if len(now) else now
            now = _mix(now + np.uint64(k))
        inside = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1]) if len(word) >= k else np.zeros(0, np.int64)
        found.append((now[inside] if len(now) else np.zeros(0, np.uint64), inside + k - 1))
    return found


def _small(values: np.ndarray) -> bytes:
    """Counts, one byte each; those from 255 on follow in full."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.int64).tobytes()


def _large(packed: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    if len(packed) > n:
        values[values == 255] = np.frombuffer(packed[n:], np.int64)
    return values


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, without the bytes that are zero in all; the first byte tells how many are kept."""
    step = np.diff(keys, prepend=np.zeros(1, np.uint64)) if len(keys) else keys
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + step[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    step = np.zeros((n, 8), np.uint8)
    step[0] = np.frombuffer(packed, np.uint8, 8, 1)
    step[1:, :width] = np.frombuffer(packed, np.uint8, (n - 1) * width, 9).reshape(-1, width)
    return np.cumsum(step.reshape(-1).view(np.uint64), dtype=np.uint64)


def _keys(table: pa.Table, order: int):
    raw, at = utf8(table.column("text"))
    word, owner = words(raw, at)
    return word, owner, grams(word, owner, order)


def score(docs: DataFrame, order: int = ORDER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_words, log_score, score, n_backoffs): sum and mean of the natural logarithms, and words scored at a lower order."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(0, int(np.ceil(np.log2(max(1.0, size * KEYS_PER_BYTE / PARTITION_BYTES)))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))

    def keys_of(by_order: list, k: int, n_words: int) -> np.ndarray:
        """The n-grams of k words; with single words goes one entry for all words."""
        return by_order[k - 1][0] if k > 1 else np.append(by_order[0][0], np.full(min(1, n_words), _TOTAL))

    def sender(k: int):
        def send(table: pa.Table) -> pa.Table:
            word, _, by_order = _keys(table, k)
            keys = np.sort(keys_of(by_order, k, len(word)))
            edge = np.flatnonzero(np.diff(keys, prepend=keys[:1] - np.uint64(1)))
            keys, counts = keys[edge], np.diff(np.append(edge, len(keys)))
            counts[keys == _TOTAL] = len(word)
            block = table.column("block")[0].as_py()
            part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys)).tolist()  # only partitions that get something
            out = [(int(part[a]), block, b - a, _pack(keys[a:b]), _small(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "block", "n", "keys", "counts"])

        return send

    def add(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([_unpack(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([_large(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        by = np.argsort(keys)
        new = np.concatenate(([True], keys[by][1:] != keys[by][:-1]))
        totals = np.add.reduceat(counts[by], np.flatnonzero(new))
        answer = np.empty(len(keys), np.int64)
        answer[by] = totals[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        return pa.table([table.column("block").combine_chunks(), table.column("part").combine_chunks(), pa.array([_small(answer[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary()), pa.array(sizes, pa.int32())], names=["block", "part", "totals", "n"])

    def total(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        n_docs = docs_of.num_rows
        names = ["doc_id", "n_words", "log_score", "score", "n_backoffs"]
        if not n_docs:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names=names)
        word, owner, by_order = _keys(docs_of, order)
        n_words = np.bincount(owner, minlength=n_docs)
        logs, lower = np.zeros(n_docs), np.zeros(n_docs, np.int64)
        if len(word):
            ordered = answers.sort_by([("length", "ascending"), ("part", "ascending")])
            length = ordered.column("length").to_numpy()
            packed, sizes = ordered.column("totals").to_pylist(), ordered.column("n").to_pylist()

            def others_of(k: int) -> np.ndarray:
                """For each n-gram of k words how often it stands in other documents."""
                rows = np.flatnonzero(length == k).tolist()
                keys = keys_of(by_order, k, len(word))
                if not len(keys):
                    return np.zeros(0, np.int64)
                totals = np.concatenate([_large(packed[r], sizes[r]) for r in rows])
                doc = np.append(owner[by_order[k - 1][1]], np.full(len(keys) - len(by_order[k - 1][1]), -1))
                by = np.argsort(keys, kind="stable")
                new = np.concatenate(([True], keys[by][1:] != keys[by][:-1]))
                run = np.flatnonzero(new | np.concatenate(([True], doc[by][1:] != doc[by][:-1])))
                own = np.repeat(np.diff(np.append(run, len(by))), np.diff(np.append(run, len(by))))
                others = np.empty(len(keys), np.int64)
                others[by] = totals[np.cumsum(new) - 1] - own
                return others

            value, used = None, np.zeros(len(word), np.int64)
            before = None
            for k, (_, place) in enumerate(by_order):
                others = others_of(k + 1)
                count = np.zeros(len(word), np.int64)
                count[place] = others[: len(place)]
                if k == 0:
                    tokens = others[-1] + 1 - n_words[owner]  # the total's own entry was taken off once
                    value = np.where(count > 0, count / np.maximum(tokens, 1), 1 / (tokens + 1.0))
                else:
                    history = np.maximum(1, np.concatenate(([0], before[:-1])))
                    possible = np.zeros(len(word), bool)
                    possible[place] = True
                    seen = count > 0
                    value = np.where(seen, count / history, np.where(possible, ALPHA * value, value))
                    used = np.where(possible & ~seen, used + 1, np.where(seen, 0, used))
                before = count
            logs = np.bincount(owner, weights=np.log(value), minlength=n_docs)
            lower = np.bincount(owner, weights=used > 0, minlength=n_docs).astype(np.int64)
        mean = pa.array(logs / np.maximum(1, n_words), mask=n_words == 0)
        return pa.table([docs_of.column("doc_id").combine_chunks(), pa.array(n_words), pa.array(logs), mean, pa.array(lower)], names=names)

    answers = None
    for k in range(1, order + 1):
        sent = dealt.groupBy("block").applyInArrow(sender(k), "part long, block long, n int, keys binary, counts binary")
        answered = stored(sent.groupBy("part").applyInArrow(add, "block long, part long, totals binary, n int").withColumn("length", F.lit(k)))
        free_shuffles(spark)
        answers = answered if answers is None else answers.unionByName(answered)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "doc_id long, n_words long, log_score double, score double, n_backoffs long")
