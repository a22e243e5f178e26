import random

import pytest

SYLLABLES = "the an er ing ou ea st nd wh re ti or es ly".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, marks, other scripts, and a very long text."""
    return [None, "", "   \n\t ", "word", "!!! ???", "日本語のテキスト 😀 é", "İK ſ", "a" * 5000, "The THE the " * 20_000, "x\x00y \x85 z"]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table with extra columns whose names clash with those of the operators."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", f"s{i % 2}", len(t or ""), 1.5, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact copies, near copies, shared passages, repeats within a text, and odd cases."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 400)) for _ in range(40)]
    passage = prose(rng, 120)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[5]]
    words = texts[7].split()
    for k in (1, 3, len(words) // 2):
        texts.append(" ".join(w if i % max(2, len(words) // k) else "changed" for i, w in enumerate(words)))
    block = prose(rng, 100)
    texts += [f"{block} {block} {block}", "ab" * 700, "é" * 450]
    return texts
