"""Language identification as mixture inference over hashed letter trigrams.

Each learned language is a distribution over trigrams. A document's language proportions are the weights of a mixture of
those distributions, found by expectation maximisation; the set of languages grows from the likeliest one as long as the
log-likelihood gains more than the penalty, PENALTY times the logarithm of the number of trigrams for each language added.
The prediction is the language of the largest proportion, the score is that proportion.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing could be learned. A text of
any length is used whole. Ties go to the language that sorts first. Rows are predicted one by one: repeated rows get equal
results, an empty table an empty one. Training rows with a null language or text are ignored, as are other columns, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestream.llm.shared import slices, small_batches, stored

#: Trigrams are hashed to so many numbers.
BUCKETS = 4096
#: Steps that rank the languages, and steps of each candidate set.
RANKING_STEPS, SET_STEPS = 3, 6
SMOOTHING = 0.5
#: Languages that a model may have; each is BUCKETS numbers on the driver and in the workers. More are an error: a column of other things than languages.
LANGUAGES = 1000
#: A language has two parameters: that it is there, and its share.
PENALTY = 1.0


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts, texts by buckets: trigrams of lower-case letters, every other run of characters being one blank."""
    low = [(t or "").lower() + " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(0))
    kept = letter | np.roll(letter, 1)  # the first blank after a letter stays
    kept[:1] = letter[:1]
    code, owner = code[kept], owner[kept]
    if len(code) < 3:
        return np.zeros((len(low), BUCKETS), np.float32)
    same = owner[2:] == owner[:-2]
    mixed = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
    mixed = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    cell = owner[2:][same] * BUCKETS + mixed[same]
    return np.bincount(cell, minlength=len(low) * BUCKETS).reshape(len(low), BUCKETS).astype(np.float32)


def has_letter(texts: list[str | None]) -> np.ndarray:
    letters = _letters()
    return np.array([bool(t) and bool(letters[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)].any()) for t in texts], bool)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Trigram counts of every language over all rows given: lang, bucket, n."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in slices(batches, "text"):
            found = trigram_counts(piece.column(1).to_pylist())
            of = np.array(piece.column(0).to_pylist(), dtype=object)
            for name in set(of):
                total[name] = total.get(name, 0) + found[of == name].sum(axis=0, dtype=np.float64)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their smoothed distributions: LANGUAGES times BUCKETS rows at most reach the driver."""
    counts = stored(counts)
    names = sorted(r["lang"] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = counts.collect()
    table = np.zeros((len(names), BUCKETS))
    at = {n: i for i, n in enumerate(names)}
    for r in rows:
        table[at[r["lang"]], r["bucket"]] = r["n"]
    table += SMOOTHING
    return names, (table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(counts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions, texts by languages (zero outside the set chosen), and the number of languages chosen."""
    n_texts, n_langs = len(counts), len(p)
    total = counts.sum(axis=1)

    def steps(at: np.ndarray, weights: np.ndarray, times: int) -> np.ndarray:
        own = counts[at]
        for _ in range(times):
            seen = np.maximum(weights @ p, 1e-30)
            weights = weights * ((own / seen) @ p.T)
            weights /= np.maximum(weights.sum(axis=1, keepdims=True), 1e-30)
        return weights

    def likelihood(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (counts[at] * np.log(np.maximum(weights @ p, 1e-30))).sum(axis=1, dtype=np.float64)

    everything = np.arange(n_texts)
    alone = counts @ np.log(p).T
    first = alone.argmax(axis=1)
    chosen = np.zeros((n_texts, n_langs), np.float32)
    chosen[everything, first] = 1
    size = np.ones(n_texts, np.int64)
    if n_langs == 1 or not n_texts:
        return chosen, size
    rank = steps(everything, np.full((n_texts, n_langs), 1 / n_langs, np.float32), RANKING_STEPS)
    rank[everything, first] = 2  # the likeliest language alone comes first
    order = np.argsort(-rank, axis=1, kind="stable")
    best = alone[everything, first].astype(np.float64)
    going = np.flatnonzero(total > 0)
    for k in range(2, n_langs + 1):
        start = np.zeros((len(going), n_langs), np.float32)
        np.put_along_axis(start, order[going, :k], 1 / k, axis=1)
        weights = steps(going, start, SET_STEPS)
        gain = likelihood(going, weights) - best[going] - PENALTY * np.log(np.maximum(total[going], 2))
        better = gain > 0
        going, weights, gain = going[better], weights[better], gain[better]
        if not len(going):
            break
        chosen[going], size[going] = weights, k
        best[going] += gain
    return chosen, size


def predict(docs: DataFrame, learned: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, lang_pred, score, n_languages, mixture); mixture lists ``language:share`` by falling share."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        for piece in slices(batches, "text"):
            texts = piece.column(1).to_pylist()
            known = has_letter(texts) if names else np.zeros(len(texts), bool)
            label, score, size, mix = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), [""] * len(texts)
            if known.any():
                at = np.flatnonzero(known)
                share, many = mixtures(trigram_counts([texts[i] for i in at]), p)
                for i, s, k in zip(at.tolist(), share, many.tolist(), strict=True):
                    by = np.argsort(-s, kind="stable")[:k]
                    label[i], score[i], size[i] = names[by[0]], min(1.0, float(s[by[0]])), k
                    mix[i] = ",".join(f"{names[j]}:{s[j]:.3f}" for j in by)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(label, pa.string()), pa.array(score), pa.array(size), pa.array(mix, pa.string())], names=["doc_id", "lang_pred", "score", "n_languages", "mixture"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_languages long, mixture string")


def fold(key: Column, of: int) -> Column:
    """The remainder of the CRC-32 of the id's decimal text."""
    return F.crc32(key.cast("string").cast("binary")) % of


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose fold of three isn't 1 and predicts every row."""
    held = fold(F.col("doc_id"), 3) == 1
    learned = model(learn(docs.filter(~held).select("text", "lang")))
    found = predict(docs, learned)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_languages", "mixture")
