"""Operators on documents against brute force, with odd inputs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestream.llm import bpe, components, decontaminate, langid, licenses, ngramlm, simhash, suffixdedup, suffixes, toxicity
from tests.llm.conftest import prose

# --- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary[0].splitlines())}
    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_rank_encoder_and_round_trips(spark, frame, corpus, odd_texts, vocabulary, tiktoken_encoding):
    texts = odd_texts + corpus[:20]
    out = {r["doc_id"]: r for r in bpe.digests(frame(texts), *vocabulary).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and out[i]["lang"] == "en"


@given(st.text(max_size=60) | st.text("ab \n'sé-=", max_size=80))
@settings(max_examples=150, deadline=None)
def test_bpe_on_any_text(content):
    test_bpe_on_any_text.codec = getattr(test_bpe_on_any_text, "codec", None) or bpe.Codec(*bpe.default_vocabulary())
    codec = test_bpe_on_any_text.codec
    content = content.encode("utf-8", "ignore").decode()
    assert codec.decode(codec.encode([content])[0]) == content.encode()


def test_bpe_ids_offsets_and_split_characters(spark, frame, vocabulary):
    df = frame(["a 😀b", None]).withColumn("token_ids", F.lit("old"))
    out = bpe.decode(bpe.encode(df, *vocabulary, offsets=True), *vocabulary).orderBy("doc_id").collect()
    assert out[0]["decoded_text"] == "a 😀b" and bytes(out[1]["decoded"]) == b"" and out[1]["token_ids"] == []
    spans = list(zip(out[0]["token_starts"], out[0]["token_ends"]))
    assert spans[0] == (0, 1) and spans[-1] == (3, 4) and all((1, 3)[0] <= a <= 3 for a, _ in spans[1:-1])
    half = bpe.decode(df.limit(1).select(F.slice(F.lit(out[0]["token_ids"]), 1, 2).cast("array<int>").alias("token_ids")), *vocabulary).first()
    assert "a" in half["decoded_text"]
    assert bpe.digests(frame([]), *vocabulary).count() == 0


# --- languages -----------------------------------------------------------------------------------

TONGUES = {"aa": "ka lo mi nu pe".split(), "bb": "schr ach ung eit ö".split(), "cc": "que eau é oi".split()}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_and_mixtures(spark, odd_texts):
    rng = random.Random(3)
    rows = [(i, tongue(rng, lang, 60), lang) for i, lang in enumerate(list(TONGUES) * 40)]
    rows += [(1000, tongue(rng, "aa", 70) + " " + tongue(rng, "bb", 30), None), (1001, tongue(rng, "cc", 40), None)] + [(2000 + i, t, None) for i, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    held = [i for i, _, _ in rows[:120] if out[i]["held_out"]]
    assert held and np.mean([out[i]["lang_pred"] == rows[i][2] for i in held]) >= 0.98
    assert out[1000]["lang_pred"] == "aa" and out[1000]["n_languages"] >= 2 and out[1000]["mixture"].split(",")[1][:2] == "bb" and out[1000]["score"] == pytest.approx(0.7, abs=0.12) and out[1001]["n_languages"] == 1
    for i, t in enumerate(odd_texts):
        assert (out[2000 + i]["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))


def test_fold_is_the_checksum_of_the_decimal_text(spark):
    import zlib

    got = {r["doc_id"]: r["f"] for r in spark.range(50).select(F.col("id").alias("doc_id"), langid.fold(F.col("id"), 3).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_mixtures_equal_a_plain_em():
    """Proportions found text by text, with the set of languages grown by trial of every language left."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(40, 0.3), size=4).astype(np.float32) + np.float32(1e-4)
    p /= p.sum(axis=1, keepdims=True)
    counts = np.array([rng.multinomial(n, rng.dirichlet([0.4] * 4) @ (p / p.sum(axis=1, keepdims=True)).astype(float) / 1.0000001) for n in (5, 30, 200, 800, 60, 400)], np.float32)
    weights, chosen = langid.mixtures(counts, p)
    for text, found, n in zip(counts, weights, chosen):
        own = np.flatnonzero(found > 0)
        assert len(own) <= n and found.sum() == pytest.approx(1, abs=1e-3)
        w = np.zeros(4)
        w[own] = 1 / len(own)
        for _ in range(3000):  # to the end, over the same set
            w = w * (p @ (text / np.maximum(w @ p, 1e-30))) / text.sum()
        best = (text * np.log(w @ p)).sum()
        assert (text * np.log(np.maximum(found @ p, 1e-30))).sum() >= best - 0.02 * text.sum() - 0.5
        alone = max((text * np.log(p[k])).sum() for k in range(4))
        assert (text * np.log(np.maximum(found @ p, 1e-30))).sum() >= alone - 1e-2


def test_languages_without_training_rows(spark, frame):
    df = frame(["abc"]).withColumn("lang", F.lit(None).cast("string"))
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(df).collect()] == [("und", 0.0)] and langid.identify(frame([])).count() == 0


# --- toxicity ------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, kinds", [
    ("You are an idiot.", {"targeted": 1}), ("idiot", {"plain": 1}), ("You are not an idiot", {"negated": 1}), ("He said that you idiot left", {"reported": 1}), ("He said hello. Idiot!", {"plain": 1}),
    ("I will kill you", {"threat": 1}), ("Kill them all", {"threat": 1}), ("not a nice day, my friend idiot", {"plain": 1}), ("idiotic widiot", {}), ("", {}), ("the scum; the loser", {"plain": 2}),
    ("kill the process with a signal", {}), ("signals kill it and hurt you", {}), ("the idiot box is an old name", {"plain": 1}), ("idiots like you", {"targeted": 1}), ("a stupid clown", {"plain": 1, "chained": 1}),
    ("nobody will kill you, he said", {"reported": 1}), ("I will never hurt you", {"negated": 1}), ("ich werde dich töten", {"threat": 1}), ("you idiot, she wrote", {"reported": 1})])
def test_clauses(text, kinds):
    assert dict(toxicity.Matcher([]).matches(text)) == kinds


def test_a_lone_word_is_not_toxic_before_any_label_is_seen(spark):
    texts = ["idiot", "the idiot box is an old name", "kill the process with a signal", "He said that you idiot left", "You are not an idiot", "You are an idiot", "I will kill you", "you stupid clown"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.judge(docs, none).orderBy("doc_id").collect()] == [0] * 5 + [1] * 3


def test_composition_equals_one_machine_after_another():
    import itertools

    machine = toxicity.Grammar()
    for n in (1, 2, 4):
        for clause in itertools.product(toxicity.WORDS, repeat=n):
            expected = list(clause)[::-1]
            for part in toxicity.backward():
                expected = part.run(expected)
            expected = expected[::-1]
            for part in toxicity.forward():
                expected = part.run(expected)
            assert machine.run(list(clause)) == expected


def test_toxicity_learns_stems_and_leaves_clean_texts(spark, odd_texts):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 60).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), "zurbo" + rng.choice("abcdefgh") + rng.choice("klmn"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.judge(docs, marks).collect()}
    assert len(out) == len(rows) and all(out[i]["predicted"] == (i % 5 == 0) for i in range(600) if out[i]["held_out"])
    assert all(out[1000 + i]["predicted"] == 0 for i in range(len(odd_texts))) and all(r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    kept = {r[0] for r in toxicity.clean(docs, marks).select("doc_id").collect()}
    assert kept == {i for i, r in out.items() if not r["predicted"]}
    nothing = toxicity.judge(docs.limit(0), marks.limit(0))
    assert nothing.count() == 0 and toxicity.judge(spark.createDataFrame([(1, "you idiot")], "doc_id long, text string"), marks.limit(0)).first()["predicted"] == 1


# --- benchmark passages --------------------------------------------------------------------------


def test_tiles_find_reordered_passages(spark, frame):
    rng = random.Random(2)
    item = prose(rng, 40)
    w = item.split()
    swapped = " ".join(w[20:] + ["between"] + w[:20])
    texts = [f"{prose(rng, 50)} {item} {prose(rng, 9)}", f"x {swapped} y", " ".join(w[:20]), prose(rng, 80), item.upper(), None, "", item + " " + item]
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 30)), (3, "two words"), (4, None), (0, item), (None, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.judge(frame(texts), bench).collect()}
    assert [out[i]["contaminated"] for i in range(8)] == [True, True, False, False, True, False, False, True]
    assert out[0]["coverage"] == 1 and out[0]["item_id"] == 0 and out[1]["n_tiles"] == 2 and out[2]["coverage"] == 0.5 and out[3]["item_id"] is None
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame(texts), bench).collect()) == [2, 3, 5, 6] and decontaminate.clean(frame(texts), bench).columns == frame(texts).columns
    assert decontaminate.judge(frame(texts), bench.limit(0)).filter("contaminated").count() == 0 and decontaminate.judge(frame([]), bench).count() == 0


def test_items_without_an_id_are_found(spark, frame):
    rng = random.Random(2)
    a, b = prose(rng, 30), prose(rng, 30)
    benchmark = spark.createDataFrame([(None, a), (4, b), (None, b)], "item_id long, text string")
    docs = frame([f"{prose(rng, 20)} {a}", f"{b} {prose(rng, 20)}", prose(rng, 50)])
    out = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontaminate.judge(docs, benchmark).collect()}
    assert out == {0: (True, None), 1: (True, 4), 2: (False, None)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()] == [2]


def test_blocks_of_the_benchmark_give_the_same(spark, frame, corpus, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(t.split()[5:40])) for i, t in enumerate(corpus[:30])], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.judge(frame(corpus), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, decontaminate.judge(frame(corpus), bench).collect())) == whole


def greedy(text, item, least):
    """Plain greedy string tiling."""
    marked_t, marked_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and p + n not in marked_t and q + n not in marked_i:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < least:
            return covered
        marked_t.update(range(p, p + n))
        marked_i.update(range(q, q + n))
        covered += n


def test_a_word_repeated_shares_many_seeds(monkeypatch):
    """The product of both lengths isn't held, and pieces of it give the same tiles."""
    index = decontaminate.Index([(1, "the " * 400), (2, "the of " * 60)], 5)
    monkeypatch.setattr(decontaminate, "SEEDS", 10_000)
    assert index.best("the " * 20_000) == (1.0, 1, 1, 20_000)
    assert index.best("the of " * 30)[0] == 0.5 and index.best("of " + "the " * 100 + "x " + "the " * 100)[:3] == (0.5, 1, 2)


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), min_size=3, max_size=8))
@settings(max_examples=150, deadline=None)
def test_tiles_equal_the_plain_algorithm(text, item):
    decontaminate.SEEDS = 1 + len(text) % 3  # pieces of seeds that end anywhere
    index = decontaminate.Index([(1, " ".join(item))], 3)
    assert index.best(" ".join(text))[0] * len(item) == pytest.approx(greedy(text, item, 3))
    decontaminate.SEEDS = 1 << 20


# --- repeated strings ----------------------------------------------------------------------------


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 8))
@settings(max_examples=300, deadline=None)
def test_suffix_order_and_prefixes(symbols, depth):
    t = np.array(symbols, np.int64)
    order = suffixes.sorted_suffixes(t, depth)
    assert sorted(order.tolist()) == list(range(len(t)))
    cut = [tuple(symbols[i : i + depth]) for i in order]
    assert cut == sorted(cut)
    shared = suffixes.adjacent_prefixes(t, order, depth)
    for k in range(1, len(order)):
        n = 0
        while n < depth and n < min(len(cut[k]), len(cut[k - 1])) and cut[k][n] == cut[k - 1][n]:
            n += 1
        assert shared[k] == n


def removed(texts, length):
    """Every window counted."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(texts, length):
    """For each text its words' places in bytes, and which of them stand in a run of ``length`` that occurs twice."""
    import re

    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    words = [[(t or "").encode()[a:b] for a, b in p] for t, p in zip(texts, places)]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    cover = [np.zeros(len(w), bool) for w in words]
    for w, c in zip(words, cover):
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                c[i : i + length] = True
    return places, cover


def runs_of(cover):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(int), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def without_words(texts, length):
    """The texts without those runs, from a run's first word's first byte to its last word's last."""
    out = []
    for t, places, cover in zip(texts, *repeated_words(texts, length)):
        b = (t or "").encode()
        cuts = [0, *(x for i, j in runs_of(cover) for x in (places[i][0], places[j - 1][1])), len(b)]
        out.append(b"".join(b[x:y] for x, y in zip(cuts[::2], cuts[1::2])).decode())
    return out


@pytest.mark.parametrize("group_rows, segment", [(256, 1 << 20), (1, 700)])
def test_suffix_dedup(spark, frame, corpus, odd_texts, monkeypatch, group_rows, segment):
    texts = corpus + [t for t in odd_texts if len(t or "") < 10_000]
    monkeypatch.setattr(suffixdedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(suffixdedup, "SEGMENT", segment)
    rows = {r["doc_id"]: r for r in suffixdedup.digests(frame(texts)).collect()}
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for _, r in sorted(rows.items())] == removed(texts, 400)
    assert [(r["n_passages"], r["n_passage_words"]) for _, r in sorted(rows.items())] == [(len(runs_of(c)), int(c.sum())) for c in repeated_words(texts, 48)[1]]


@pytest.mark.parametrize("group_rows, segment", [(256, 1 << 20), (1, 5000)])
def test_passages_of_words(spark, frame, corpus, odd_texts, monkeypatch, group_rows, segment):
    """Passages of 46 to 60 words in many texts, over line ends, in pieces, and a word repeated; long words are symbols like others."""
    monkeypatch.setattr(suffixdedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(suffixdedup, "SEGMENT", segment)
    rng = random.Random(8)
    texts = corpus + [t for t in odd_texts if len(t or "") < 10_000]
    for n in (46, 47, 48, 49, 51, 60):
        passage = prose(rng, n)
        texts += [f"{prose(rng, rng.randint(0, 40))}{gap}{passage}{gap}{prose(rng, rng.randint(0, 40))}" for gap in (" ", "\n", "\t ", "\n\n", "  ", " ")]
    texts += ["it " * 90, "w" * 5000 + " " + prose(rng, 60) + " " + "w" * 5000]
    texts += [texts[-1] + " end"]
    out = {r["doc_id"]: r["text"] for r in suffixdedup.deduplicated(frame(texts), units=(suffixdedup.PASSAGES,)).collect()}
    assert [out[i] for i in range(len(texts))] == without_words(texts, 48)


def test_suffix_dedup_of_large_groups_with_late_anchors(spark, frame, monkeypatch):
    """The last window's anchor stands 96 to 100 bytes in, where the bands of a cut group end."""
    monkeypatch.setattr(suffixdedup, "GROUP_ROWS", 2)
    rng = np.random.default_rng(3)
    letters = lambda n: rng.integers(97, 123, n, np.uint8)
    texts = []
    for size in range(400, 405):
        wanted = set(range(96, 101))
        while wanted:
            passage = letters(size)
            place = int(suffixdedup.anchors(passage[-400:], suffixdedup.BYTES)[2][0])
            if place in wanted:
                wanted.remove(place)
                texts += [np.concatenate([letters(110), passage, letters(110)]).tobytes().decode() for _ in range(4)]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.digests(frame(texts)).collect()}
    assert [out[i] for i in range(len(texts))] == removed(texts, 400)


def test_suffix_dedup_of_equal_rows_and_cut_characters(spark, frame):
    text = "é" * 450
    df = frame([text, text, "a" + text, None], ids=[1, 1, 2, 3])
    out = suffixdedup.deduplicated(df)
    assert out.columns == df.columns and sorted((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == [(1, "", "s0"), (1, "", "s1"), (2, "a", "s0"), (3, "", "s1")]
    assert suffixdedup.digests(frame([])).count() == 0


# --- backoff scores ------------------------------------------------------------------------------


def backoff(texts, order):
    words = [__import__("re").findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()) for t in texts]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    total = Counter(g for w in words for k in range(1, order + 1) for g in grams(w, k))
    tokens = sum(map(len, words))
    out = []
    for w in words:
        own = Counter(g for k in range(1, order + 1) for g in grams(w, k))
        count = lambda g: total[g] - own[g]  # noqa: E731, B023
        n, s, lower = tokens - len(w), 0.0, 0
        for i in range(len(w)):
            longest = min(order, i + 1)
            value = None
            for k in range(longest, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    value = count(g) / n if count(g) > 0 else 1 / (n + 1)
                elif count(g) > 0:
                    value = count(g) / count(g[:-1])
                if value is not None:
                    s += math.log(value * 0.4 ** (longest - k))
                    lower += k < longest
                    break
        out.append((len(w), s, lower))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, frame, corpus, odd_texts, order, monkeypatch):
    texts = corpus + odd_texts
    monkeypatch.setattr(ngramlm, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(ngramlm, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(ngramlm, "PIECE", 1000)
    out = {r["doc_id"]: r for r in ngramlm.score(frame(texts), order).collect()}
    for i, (n, s, lower) in enumerate(backoff(texts, order)):
        assert (out[i]["n_words"], out[i]["n_backoffs"]) == (n, lower) and out[i]["log_score"] == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert out[i]["score"] == (pytest.approx(s / n) if n else None)


def test_backoff_of_three_words_is_registered(spark, frame, corpus, tmp_path):
    from lodestream.llm import queries

    frame(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.QUERIES["op8_backoff"](spark, str(tmp_path)).collect()}
    for i, (n, s, lower) in enumerate(backoff(corpus, 3)):
        assert (out[i]["n_words"], out[i]["n_backoffs"]) == (n, lower) and out[i]["log_score"] == pytest.approx(s, rel=1e-9, abs=1e-5)


def test_backoff_of_nothing(spark, frame):
    assert ngramlm.score(frame([])).count() == 0 and ngramlm.score(frame(["", None])).filter("score IS NULL AND n_words = 0").count() == 2


# --- licences ------------------------------------------------------------------------------------


def base_places(text):
    import re

    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))]
    found = [(i, label) for label, phrase in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), found


LICENCES = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. mit\nLICENSE", "Licensed under CC BY-NC 4.0.",
    "GNU Lesser General Public License", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.", "mit licenses; submit license; apache  license", "K license: the mit\u2028license", "license " * 50 + "mit license",
]


def test_licences(spark, frame, odd_texts, corpus):
    texts = LICENCES + odd_texts + corpus[:10]
    out = {r["doc_id"]: r for r in licenses.scan(frame(texts)).collect()}
    for i, t in enumerate(texts):
        n, found = base_places(t)
        at = [a for a, _ in found]
        assert (out[i]["n_words"], out[i]["n_base"], out[i]["first_word"], out[i]["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None)), t
        base = sorted({x for _, x in found})
        assert out[i]["base_labels"] == ",".join(base) and set(base) <= set(out[i]["labels"].split(",")) | {""} and 0 <= out[i]["score"] <= 1
    labels = [out[i]["labels"] for i in range(len(LICENCES))]
    assert labels[:3] == ["apache", "gpl", "mit"] and labels[3] == "cc-by-nc" and labels[4] == "gpl,lgpl" and labels[5] == "bsd" and labels[6] == "proprietary"
    assert licenses.scan(frame([])).count() == 0 and len(licenses.rules()) > 200


def test_every_spelling_of_a_name_passes_its_keyword(spark, frame):
    texts = ["under the GNU Library General Public License", "the GNU Lesser General Public License", "Do What The Fuck You Want To Public License", "the WTFPL license"]
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(frame(texts)).collect()}
    assert [labels[i] for i in range(4)] == ["gpl,lgpl", "gpl,lgpl", "wtfpl", "wtfpl"]


def plain_labels(text):
    """Every rule over the words, and every span compared with every other."""
    import re

    line = " " + " ".join(w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))) + " "
    spans = [(m.start(), m.end(), priority, label, strength) for label, priority, strength, keyword, pattern in licenses.rules() if keyword in line for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line)]
    kept = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and (o[2] > s[2] or (o[2] == s[2] and o[1] - o[0] > s[1] - s[0])) for o in spans)]
    labels = {s[3] for s in kept} | {label for _, label in base_places(text)[1]}
    return ",".join(sorted(labels)), max([0.0, *(s[4] for s in kept), *([0.6] if base_places(text)[1] else [])])


def test_labels_equal_plain_rules(spark, frame, odd_texts):
    rng = random.Random(12)
    names = ["gnu lesser general public", "mit", "apache 2 0", "cc by nc sa 4 0", "creative commons attribution share alike", "bsd 3 clause", "gpl v3", "lgpl 2 1 or later", "mozilla public", "sspl 1", "the public domain", "isc"]
    frames = ["licensed under the terms of the {} license", "spdx license identifier {}", "license is {}", "{} license", "released under {}", "all rights reserved {}", "without warranty of any kind {} licence", "into {}"]
    texts = [" ".join(rng.choice(frames).format(rng.choice(names)) + " " + prose(rng, rng.randint(0, 3)) for _ in range(rng.randint(1, 6))) for _ in range(60)] + LICENCES + odd_texts
    texts += [" ".join(f"released under the {rng.choice(names)} license" for _ in range(400))]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(texts)).collect()}
    assert [out[i] for i in range(len(texts))] == [plain_labels(t) for t in texts]


def test_contained_matches_are_suppressed(spark, frame):
    rows = licenses.scan(frame(["released under the terms of the GNU Lesser General Public License"]), phrases={}).collect()
    assert rows[0]["labels"] == "lgpl" and rows[0]["n_base"] == 0


# --- fingerprints --------------------------------------------------------------------------------


def groups(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= distance and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    change = True
    return root


def plain_fingerprint(text, k):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("distance", [3, 6])
def test_simhash(spark, frame, corpus, odd_texts, distance, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    monkeypatch.setattr(simhash, "SHIFTED_ROWS", 3)
    texts = corpus + odd_texts
    fps = {i: plain_fingerprint(t, 3) for i, t in enumerate(texts)}
    out = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(frame(texts), 3, distance).collect()}
    expected = groups(fps, distance)
    assert out == {i: (fps[i], expected[i]) for i in fps}


def test_no_link_is_lost_among_random_neighbours(spark):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([([signed(v)], i) for i, v in enumerate(values)], "fps array<long>, rep long")
    for segments in (4, 16):
        found = {r["node"]: r["component"] for r in components.components(simhash.links(classes, 3, segments)).collect()}
        expected = groups(dict(enumerate(values)), 3)
        assert {i: found.get(i, i) for i in expected} == expected


def test_one_of_each_group_of_copies_stays(spark, frame, odd_texts):
    rng = random.Random(9)
    first = prose(rng, 400)
    near = " ".join(w + ("x" if i in (50, 300) else "") for i, w in enumerate(first.split()))
    other = prose(rng, 400)
    df = frame([first, near, other, first, other, None, "", other], ids=[5, 3, 7, 9, 8, 10, None, 7])
    out = simhash.without_copies(df)
    assert out.columns == df.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 3, 7, 10]
    assert simhash.without_copies(frame([])).count() == 0


def test_different_texts_of_one_id_stay(spark, frame):
    rng = random.Random(4)
    a, b, c = (prose(rng, 200) for _ in range(3))
    out = simhash.without_copies(frame([a, b, a + " end", b + " end", c], ids=[1, 1, 2, 3, 3]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, a), (1, b), (3, c)])


@pytest.mark.parametrize("group_sets, map_bytes, large", [(4096, 32 << 20, 1000), (6, 1000, 40)])
def test_near_copies_equal_brute_force(spark, frame, corpus, monkeypatch, group_sets, map_bytes, large):
    """Texts around a similarity of 0.8, both sides of it, with a passage that most of them share: no link of 0.8 is lost, and none below is made; nor in groups cut by size and into blocks."""
    from lodestream.llm import nearcopies

    monkeypatch.setattr(nearcopies, "BUCKET_ROWS", 60)
    monkeypatch.setattr(nearcopies, "SHIFTED_ROWS", 9)
    monkeypatch.setattr(nearcopies, "GROUP_SETS", group_sets)
    monkeypatch.setattr(nearcopies, "MAP_BYTES", map_bytes)
    monkeypatch.setattr(nearcopies, "LARGE", large)
    rng = random.Random(21)
    shared, texts = prose(rng, 25), [t for t in corpus if t]
    base = prose(rng, 200).split()
    texts += [" ".join("new" + w if rng.random() < rng.choice([0.01, 0.03]) else w for w in base) for _ in range(60)]  # one large group
    for _ in range(50):
        base = prose(rng, rng.choice([8, 30, 100, 300])).split()
        texts.append(" ".join(base) + " " + shared)
        for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.04):
            texts.append(" ".join("new" + w if rng.random() < share else w for w in base) + " " + shared)
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    parent = list(range(len(texts)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    near = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for j in range(len(sets)) for i in range(j)]
    assert sum(0.8 <= x < 0.85 for *_, x in near) > 10 and sum(0.7 < x < 0.8 for *_, x in near) > 10
    for i, j, x in near:
        if x >= 0.8 and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    out = sorted(r["doc_id"] for r in simhash.without_copies(frame(texts)).collect())
    assert out == [i for i in range(len(texts)) if root(i) == i]


def test_unlike_texts_with_a_common_passage_are_no_group(spark, frame, monkeypatch):
    """Long texts, each with a passage of the next: only near copies meet in the exact check, not all texts in one group that grows with the table."""
    from lodestream.llm import nearcopies

    met, plain = [], nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda texts, shingles: met.extend(r["doc_id"] for r in texts.select("doc_id").collect()) or plain(texts, shingles))
    rng = random.Random(31)
    texts = []
    for size, common in ((600, 60), (1500, 450)):
        passages = [prose(rng, common) for _ in range(16)]
        texts += [passages[i] + " " + prose(rng, size - 2 * common) + " " + passages[i + 1] for i in range(15)]
    texts += [t + " and this end" for t in texts[::10]]
    out = simhash.without_copies(frame(texts))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(30))
    assert sorted(met) == [0, 10, 20, 30, 31, 32]


def test_similar_sets_have_similar_sketches():
    """Sets at a similarity of 0.8, from the size where sketches begin, and sets of nothing in common."""
    from lodestream.llm import nearcopies

    rng = np.random.default_rng(4)
    for n in [401, 500, 501, 3000] * 25:
        shingles = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        own = n - n // 9
        a, b, c = (np.unique(s) for s in (shingles[:n], np.concatenate([shingles[:own], shingles[n : 2 * n - own]]), shingles[n:]))
        maps = [np.frombuffer(nearcopies.map_of(x), np.uint8)[nearcopies.PARTS // 8 :] for x in (a, b, c)]
        differ = [int(np.bitwise_count(maps[0] ^ m).sum()) for m in maps[1:]]
        assert differ[0] <= nearcopies.SKETCH_DIFFER < differ[1]


def test_large_exchanges_of_near_copies_go_in_rounds(spark, frame, monkeypatch):
    """Keys and whole sets are sent in several rounds of bounded size, and no link is lost between them."""
    from lodestream.llm import nearcopies

    monkeypatch.setattr(nearcopies, "LEAST_ROUND", 40_000)
    monkeypatch.setattr(nearcopies, "GROUP_SETS", 4)
    many, plain = [], nearcopies.rounds
    monkeypatch.setattr(nearcopies, "rounds", lambda sent, shingles: many.append(plain(sent, 0)) or many[-1])
    rng = random.Random(8)
    texts, kept = [], []
    for _ in range(30):
        base = prose(rng, 150).split()
        kept.append(len(texts))
        texts += [" ".join("new" + w if i in (10 * k, 10 * k + 40) else w for i, w in enumerate(base)) for k in range(6)]
    out = simhash.without_copies(frame(texts))
    assert sorted(r["doc_id"] for r in out.collect()) == kept
    assert len(many) == 2 and min(many) > 2


def test_fingerprints_find_the_closest_copies(spark, frame, monkeypatch):
    """Without the prefix filter the SimHash fingerprints alone find copies within three bits; the exact check follows, and a text that shares the fingerprint alone stays."""
    from lodestream.llm import nearcopies

    monkeypatch.setattr(nearcopies, "candidates", lambda classes, *_: spark.createDataFrame([], "u long, v long"))
    rng = random.Random(13)
    texts = [prose(rng, 900) for _ in range(6)]
    texts += [t + " end" for t in texts[:4]]
    prints = [simhash.fingerprint_of(nearcopies.shingle_set(t.encode())) for t in texts]
    close = [i for i in range(4) if (prints[i] ^ prints[6 + i]).bit_count() <= 3]
    assert len(close) >= 2
    assert sorted(r["doc_id"] for r in simhash.without_copies(frame(texts)).collect()) == sorted(set(range(10)) - {6 + i for i in close})
    monkeypatch.setattr(nearcopies, "fingerprint_of", lambda s: 5)
    assert sorted(r["doc_id"] for r in simhash.without_copies(frame(texts)).collect()) == list(range(6))


def test_similar_sets_share_a_key():
    """Sets of all sizes with as many differences as a similarity of 0.8 allows."""
    from lodestream.llm import nearcopies

    rng = np.random.default_rng(6)
    none = np.zeros(0, np.uint64)
    for n in [1, 2, 4, 5, 9, 30, *rng.integers(600, 6000, 60).tolist()]:
        shingles = rng.integers(0, 1 << 63, 2 * n + 2, np.uint64)
        a = np.unique(shingles[:n])
        less, more = (int(n // 5), 0) if n % 2 else (int(n // 9), int(n // 9))
        b = np.unique(np.concatenate([a[less:], shingles[n : n + more]]))
        both = np.intersect1d(a, b).size
        if len(b) and 5 * both >= 4 * (len(a) + len(b) - both):
            assert any(np.intersect1d(x, y).size for x, y in zip(nearcopies.keys_of(a, none, none), nearcopies.keys_of(b, none, none)))


def test_components_of_paths_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(500, 500), (None, 4), (7, 1), (1, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 30)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
