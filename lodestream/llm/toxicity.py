"""Toxicity by weighted finite-state patterns over clauses.

Words become classes: insult, threat, target, intent, negation, report, or other. Small transducers rewrite the heads of a clause, which are its insults and threats. Two read the clause from its end:
one aims heads at a target that follows, one marks those that a later report quotes. Five read it from its start: one chains insults that follow each other, one keeps only threats that an
intent or the clause's beginning introduces, and one each marks heads that a negation governs, that an earlier report quotes, or that follow a target. The machines of each direction are composed into
one, built on the driver. Each kind of match has a weight, and a text is scored by all its matched clauses: a threat without intent and target is no match, and a lone insult, before any label is
seen, is too weak a one to be called toxic.

The lexicon is a short hand-written one and the stems that the labelled rows show to be insults; the weights are a logistic
regression with a prior over match counts. Both are learned from at most SAMPLE_ROWS labelled rows, in the order of a hash of their ids.

Cases: null and empty texts have no match and get the score of none. Every text is read whole. Several labels of one id count as
toxic if one is. With no labelled row the prior weights and the hand-written words remain. Repeated rows get equal scores. Extra columns are ignored by ``judge`` and pass through ``clean``.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import uuid
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestream.llm.langid import fold
from lodestream.llm.shared import held, slices, small_batches, stored

#: Labelled rows that the classifier is fitted on, and stems it may learn.
SAMPLE_ROWS, STEMS = 20_000, 5_000
#: A stem is learned if so many different words precede it in toxic texts and toxic texts hold it so many times as often as others.
LEAST_CONTEXTS, LEAST_RATIO = 10, 20.0
#: Stems whose counts a task holds before it passes them on.
HELD_STEMS = 200_000
#: Letters of a stem; a whole word ends with END.
STEM_LETTERS, END = (4, 5, 6, 7, 8), "$"

#: Hand-written words (fixed values).
INSULTS = "idiot moron loser scum trash worthless pathetic disgusting stupid clown dumb fool jerk vermin filth imbecile dummkopf trottel abschaum versager wertlos widerlich dumm connard ordure minable débile abruti imbécil basura escoria inútil estúpido patético".split()
THREATS = "kill hurt destroy murder strangle stab töten umbringen vernichten tuer détruire matar destruir".split()
TARGETS = "you your you're yourself he him she her they them u du dich dein ihr euch sie er tu te ton toi vous il elle ils tú te tu usted ustedes él ella ellos".split()
#: Words that announce a deed (fixed values).
INTENTS = "will i'll we'll they'll gonna going want wants shall must should werde werden wird wirst vais vas vont voy va van quiero".split()
NEGATIONS = "not no never nobody none neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say saying called calls wrote writes quoted quote reported claimed according sagte sagt schrieb nannte laut dit disait écrit selon dijo dice escribió según llamó".split()
#: Weights before any label is seen, and how far a label's evidence may move them.
PRIOR = {"plain": 2.0, "chained": 5.0, "targeted": 5.0, "negated": 0.5, "reported": 0.5, "threat": 5.0}
PRIOR_BIAS, PRIOR_SPREAD = -4.0, 3.0
KINDS = tuple(PRIOR)
#: Words within which a negation, an intent or a target reaches a head, and within which insults are a chain.
REACH, CHAIN = 3, 2

#: Classes of words.
OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT = "o", "I", "T", "t", "w", "n", "r"
#: What the machines make of heads: chained and targeted insults, aimed threats, and heads that are negated or reported.
CHAINED, TARGETED, AIMED, NEGATED, REPORTED = "C", "P", "K", "N", "R"
WORDS = (OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT)
SYMBOLS = (*WORDS, CHAINED, TARGETED, AIMED, NEGATED, REPORTED)


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, symbols out). Weights belong to the symbols of the last one."""

    def __init__(self, moves: dict[tuple[int, str], tuple[int, str]], states: int) -> None:
        self.moves, self.states = moves, states

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for x in symbols:
            state, y = self.moves.get((state, x), (state, x))
            out.append(y)
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that acts as second after first; only states that can be reached are made."""
    ids, moves, todo = {(0, 0): 0}, {}, deque([(0, 0)])
    while todo:
        a, b = todo.popleft()
        for x in SYMBOLS:
            p, y = first.moves.get((a, x), (a, x))
            q, z = second.moves.get((b, y), (b, y))
            if (p, q) not in ids:
                ids[p, q] = len(ids)
                todo.append((p, q))
            moves[ids[a, b], x] = ids[p, q], z
    return Transducer(moves, len(ids))


def _after(triggers: str, marks: dict[str, str], reach: int | None) -> Transducer:
    """After a trigger, for ``reach`` words or to the end, symbols are rewritten by ``marks``."""
    last = 1 if reach is None else reach
    moves = {}
    for state, x in itertools.product(range(last + 1), SYMBOLS):
        after = last if x in triggers else state if reach is None else max(0, state - 1)
        moves[state, x] = after, marks.get(x, x) if state else x
    return Transducer(moves, last + 1)


def _introduced() -> Transducer:
    """Threats stay where the clause begins, or within REACH words of an intent; elsewhere they are words like others. State REACH + 1 is the clause's beginning."""
    moves = {}
    for state, x in itertools.product(range(REACH + 2), SYMBOLS):
        after = REACH if x == INTENT else max(0, min(state, REACH) - 1) if state <= REACH else 0
        moves[state, x] = after, x if state or x not in (THREAT, AIMED) else OTHER
    begin = REACH + 1
    swap = {0: begin, begin: 0}  # a machine begins in state 0
    return Transducer({(swap.get(s, s), x): (swap.get(t, t), y) for (s, x), (t, y) in moves.items()}, REACH + 2)


HEADS = INSULT + CHAINED + TARGETED + THREAT + AIMED


def backward() -> list[Transducer]:
    """The machines that read a clause from its end."""
    return [_after(TARGET, {INSULT: TARGETED, THREAT: AIMED}, REACH), _after(REPORT, dict.fromkeys(HEADS, REPORTED), None)]


def forward() -> list[Transducer]:
    """The machines that read a clause from its start."""
    return [
        _after(INSULT + TARGETED, {INSULT: CHAINED}, CHAIN),
        _introduced(),
        _after(NEGATION, dict.fromkeys(HEADS, NEGATED), REACH),
        _after(REPORT, dict.fromkeys(HEADS, REPORTED), None),
        _after(TARGET, {INSULT: TARGETED, CHAINED: TARGETED, THREAT: AIMED}, REACH),
    ]


class Grammar:
    """A clause's classes to its matches: one machine for each direction."""

    def __init__(self) -> None:
        self.back, self.ahead = functools.reduce(compose, backward()), functools.reduce(compose, forward())

    def run(self, classes: list[str]) -> list[str]:
        return self.ahead.run(self.back.run(classes[::-1])[::-1])


KIND_OF = {NEGATED: "negated", REPORTED: "reported", TARGETED: "targeted", CHAINED: "chained", INSULT: "plain", AIMED: "threat"}
CLAUSE_ENDS = ".!?;:\n\r"
_CLAUSE = re.compile(f"[{CLAUSE_ENDS}]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


class Matcher:
    """Finds the clauses that hold a head with one pass over the text, and reads only those."""

    def __init__(self, stems: list[str]) -> None:
        import ahocorasick

        self.machine = Grammar()
        self.kind = {w: c for c, ws in ((INTENT, INTENTS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
        self.kind |= {w + "s": INSULT for w in INSULTS if w + "s" not in self.kind}
        self.kind |= {s[:-1]: INSULT for s in stems if s.endswith(END)}
        self.stems = {s for s in stems if not s.endswith(END)}
        self.finder = ahocorasick.Automaton()
        for head in {*INSULTS, *THREATS, *self.stems, *(s[:-1] for s in stems if s.endswith(END))}:
            self.finder.add_word(head, len(head))
        self.finder.make_automaton()

    def class_of(self, word: str) -> str:
        found = self.kind.get(word)
        if found is None and any(word[:n] in self.stems for n in STEM_LETTERS):
            return INSULT
        return found or OTHER

    def matches(self, text: str) -> Counter:
        low, found, done = text.lower(), Counter(), -1
        for end, size in self.finder.iter(low):
            at = end - size + 1
            if at <= done or (at and low[at - 1].isalpha()):
                continue
            start = max(done, *(low.rfind(c, done + 1, at) for c in CLAUSE_ENDS)) + 1
            stop = _CLAUSE.search(low, at)
            done = stop.start() if stop else len(low)
            out = self.machine.run([self.class_of(w) for w in _WORD.findall(low, start, done)])
            found.update(KIND_OF[y] for y in out if y in KIND_OF)
        return found


def features(found: Counter) -> list[float]:
    """How often each kind matched, on a scale that flattens."""
    return [math.log2(1 + found[k]) for k in KINDS]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of at most SAMPLE_ROWS labelled rows outside the fold: text, toxic. The ids broadcast are no more than that."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", "toxic")
    return stored(rows)


def learn_stems(rows: DataFrame) -> list[str]:
    """Stems that many different contexts in toxic texts and hardly any other text hold; copies of a text share their contexts."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        clean: Counter = Counter()
        for batch in batches:
            out_stem, out_before = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                if not toxic:
                    clean.update({s for w in set(words) for s in _stems(w)})
                    continue
                before = dict(zip(words[1:], words, strict=False)) | ({words[0]: words[0]} if words else {})
                for stem, word in {s: b for w, b in before.items() for s in _stems(w)}.items():
                    out_stem.append(stem)
                    out_before.append(zlib.crc32(word.encode()))
            yield _rows(out_stem, out_before, [0] * len(out_stem))
            if len(clean) > HELD_STEMS:
                yield _rows(list(clean), [-1] * len(clean), list(clean.values()))
                clean.clear()
        yield _rows(list(clean), [-1] * len(clean), list(clean.values()))

    def _rows(stem: list, before: list, others: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(before, pa.int64()), pa.array(others, pa.int64())], names=["stem", "before", "others"])

    seen = rows.mapInArrow(run, "stem string, before long, others long")
    each = seen.groupBy("stem", "before").agg(F.sum("others").alias("others"), F.count(F.lit(1)).alias("n"))
    total = each.groupBy("stem").agg(F.sum("others").alias("others"), F.sum(F.when(F.col("before") >= 0, 1).otherwise(0)).alias("contexts"), F.sum(F.when(F.col("before") >= 0, F.col("n")).otherwise(0)).alias("toxic"))
    sizes = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return []
    rate = (F.col("toxic") / sizes[True]) / ((F.col("others") + 0.5) / sizes[False])
    found = total.filter((F.col("contexts") >= LEAST_CONTEXTS) & (rate >= LEAST_RATIO)).orderBy(F.desc("toxic"), "stem").limit(STEMS).select("stem").collect()
    stems = {r["stem"] for r in found}
    shorter = lambda s: any(s[:n] in stems for n in STEM_LETTERS if n < len(s.rstrip(END)))
    return sorted(s for s in stems if not shorter(s))


def _stems(word: str) -> list[str]:
    return [word[:n] for n in STEM_LETTERS if n <= len(word)] + [word + END] * (len(word) >= 3)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and weights of a logistic regression whose prior is PRIOR, by Newton's method."""
    mean = np.array([PRIOR_BIAS, *PRIOR.values()])
    a = np.hstack([np.ones((len(x), 1)), x]) if len(x) else np.zeros((0, len(mean)))
    w = mean.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + (w - mean) / PRIOR_SPREAD**2
        bend = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) / PRIOR_SPREAD**2
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _with_matcher(docs: DataFrame, stems: list[str], made, schema: str, carried: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)
    shared, owner = docs.sparkSession.sparkContext.broadcast(stems), f"toxicity {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(owner, "matcher", lambda: Matcher(shared.value))
        for piece in slices(batches, "text", owner=owner):
            found = [matcher.matches(t) if t else Counter() for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in carried] + made(found), names=[c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Stems and weights."""
    rows = sample(docs, labels)
    stems = learn_stems(rows)
    names = [f"f{i}" for i in range(len(KINDS))]
    seen = _with_matcher(rows, stems, lambda found: [pa.array([features(f)[i] for f in found], pa.float64()) for i in range(len(KINDS))], "toxic int, " + ", ".join(f"{n} double" for n in names), ["toxic"])
    cells = seen.groupBy("toxic", *names).count().collect()  # a few match counts make few different rows, SAMPLE_ROWS at most
    x = np.array([[r[n] for n in names] for r in cells for _ in range(r["count"])]).reshape(-1, len(names))
    y = np.array([r["toxic"] for r in cells for _ in range(r["count"])], float)
    return stems, fit(x, y)


def score(docs: DataFrame, learned: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, score, predicted, n_matches)."""
    stems, w = learned
    bias, weights = float(w[0]), [float(x) for x in w[1:]]

    def made(found: list[Counter]) -> list[pa.Array]:
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(a * b for a, b in zip(weights, features(f), strict=True)))))) for f in found]
        return [pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32()), pa.array([sum(f.values()) for f in found], pa.int64())]

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _with_matcher(rows, stems, made, "doc_id long, score double, predicted int, n_matches long", ["doc_id"])


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose score is 0.5 or more; learned from the labelled rows outside the fold."""
    small_batches(docs.sparkSession)
    stems, w = learn(docs, labels)
    bias, weights = float(w[0]), [float(x) for x in w[1:]]
    shared, owner = docs.sparkSession.sparkContext.broadcast(stems), f"toxicity {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(owner, "matcher", lambda: Matcher(shared.value))
        for piece in slices(batches, text, owner=owner):
            texts = piece.column(piece.schema.get_field_index(text)).to_pylist()
            margin = [bias + sum(a * b for a, b in zip(weights, features(matcher.matches(t)), strict=True)) if t else bias for t in texts]
            yield piece.filter(pa.array([m < 0 for m in margin]))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows outside the fold and scores every row."""
    held_out = fold(F.col("doc_id"), 5) == 0
    return score(docs, learn(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_matches")
