"""Registered queries that SQL can't say, over whole tables, against plain loops or what defines their result."""

import hashlib
import itertools
import re

import pytest

from lodestream.operators import documents as docs, retrieval
from lodestream.plans import catalog, retrieval as search_plans
from lodestream.plans.scalar import NOW_MS

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r["text"] is not None}


def rows_of(spark, sf, name):
    """The query's rows, without their id, by id."""
    out = {}
    for r in catalog.QUERIES[name](spark, sf).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return out


def packed(text, most, carried):
    """Chunks from prefix sums: each goes on while it fits, and the next begins with the fewest last pieces that reach the overlap."""
    pieces = [(i, line[k : k + most]) for i, line in enumerate(text.split("\n"), 1) for k in range(0, max(1, len(line)), most)]
    total = [0, *itertools.accumulate(len(p) + 1 for _, p in pieces)]
    chunks, first, end = [], 0, 0
    while end < len(pieces):
        end += 1
        while end < len(pieces) and total[end + 1] - total[first] <= most:
            end += 1
        chunks.append((pieces[first][0], pieces[end - 1][0], "\n".join(p for _, p in pieces[first:end])))
        start = end
        while carried and start > first and total[end] - total[start] < carried:
            start -= 1
        first = start
    return chunks


def filled(text, most):
    """Pieces of whole characters, each as many bytes as go in."""
    parts, size = [""], 0
    for c in text:
        if size + len(c.encode()) > most and parts[-1]:
            parts.append("")
            size = 0
        parts[-1] += c
        size += len(c.encode())
    return parts


def test_chunks(spark, sf, texts):
    found = rows_of(spark, sf, "STR7")
    for i, t in texts.items():
        assert found.get(i, []) == [(a, b, sha(c)) for a, b, c in packed(t, 400, 80)]


def test_byte_pieces(spark, sf, texts):
    found = rows_of(spark, sf, "STR9")
    assert all(found[i] == [(len(p.encode()), sha(p)) for p in filled(t, 1000)] for i, t in texts.items())


def test_chunks_under_a_byte_limit(spark, sf, texts):
    found = rows_of(spark, sf, "STR10")
    for i, t in texts.items():
        assert sorted(found.get(i, [])) == sorted((a, b, len(p.encode()), sha(p)) for a, b, c in packed(t, 1600, 320) for p in filled(c, 800))


def test_break_chunks(spark, sf, texts):
    """A window's last line end, else its last blank, else its limit; white space at a cut goes."""
    found = rows_of(spark, sf, "STR11")
    for i, t in texts.items():
        expected, at = [], 0
        while len(t) - at > 500:
            window = t[at : at + 500]
            places = [[k for k, c in enumerate(window) if c == mark and k > 0] for mark in "\n "]
            end = at + (places[0][-1] if places[0] else places[1][-1] if places[1] else 500)
            expected.append(t[at:end].rstrip())
            at = end + len(t[end:]) - len(t[end:].lstrip())
        expected.append(t[at:])
        assert found.get(i, []) == [(sha(p),) for p in expected if p]


def test_block_chunks(spark, sf, texts):
    """No character but white space is lost, and no block is over the limit; a block that could hold its first paragraph more would."""
    from lodestream.operators import chunking

    found = rows_of(spark, sf, "STR12")
    for i, t in texts.items():
        blocks = chunking.paragraph_chunks(t, 200, 800)
        assert found.get(i, []) == [(len(b), sha(b)) for b in blocks]
        assert "".join("".join(b.split()) for b in blocks) == "".join(t.split())
        assert all(0 < len(b) <= 800 for b in blocks) or "```" in t or "~~~" in t
        assert all(len(b) >= 150 for b in blocks[:-1])


def test_document_redaction(spark, sf, texts):
    """Pattern by pattern, the spans that one finds are masked one by one."""

    def masked(t):
        for p in docs.SECRETS:
            out, at = [], 0
            for m in re.finditer(p, t, re.I):
                groups = [g for g in m.groups() if g]
                token = groups[-1] if groups else m[0]
                lines = m[0].splitlines()
                new = f"{lines[0]}\n…redacted…\n{lines[-1]}" if "PRIVATE KEY-----" in m[0] else m[0].replace(token, "***" if len(token) < 18 else token[:6] + "…" + token[-4:], 1)
                out += [t[at : m.start()], new]
                at = m.end()
            t = "".join(out) + t[at:]
        return t

    found = rows_of(spark, sf, "STR15")
    assert all(found[i] == [(sha(masked(t)),)] for i, t in texts.items())
    secret = "x AUTH_TOKEN='abcdefghijklmnopqrstuv' Authorization: Bearer abc --password=no --token qwertyuiopasdfghjklz sk-abcdefgh12345"
    assert docs.redact(secret) == masked(secret) != secret


def test_keyword_extraction(spark, sf):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    found = {(r["conv_id"], r["turn"]): r["keywords"] for r in catalog.QUERIES["STR3"](spark, sf).collect()}
    assert set(found) == set(turns)
    for k, t in turns.items():
        if t is not None and t.isascii():
            words = [w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 1 and not w.isdigit() and w not in docs.STOP_WORDS]
            assert found[k].split() == list(dict.fromkeys(words))


def test_pages_as_markdown_and_text(spark, sf):
    """No markup is left, every heading, link and item has its mark, and no hidden text shows."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    digest, plain = rows_of(spark, sf, "STR20"), rows_of(spark, sf, "STR24")
    shown = rows_of(spark, sf, "FLT20_pages")
    assert set(digest) == set(plain) == set(shown) == set(pages)
    for i, h in pages.items():
        markdown = docs.html_to_markdown(h)
        title = re.search("(?is)<title[^>]*>(.*?)</title>", h)
        assert digest[i] == [(title and docs.tidy(docs.decoded(re.sub("<[^>]+>", "", title[1]))), sha(markdown))]
        assert not re.search(r"(?i)</?(p|div|a|h[1-6]|li|ul|script|style|span)\b[^>]*>", markdown)
        heads = [len(x) for x in re.findall(r"(?m)^(#{1,6}) \S", markdown)]
        assert len(heads) >= len([1 for x in re.findall(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", re.sub(r"(?is)<(script|style|noscript).*?</\1>", "", h)) if re.sub(r"<[^>]+>|\s", "", x[1])])
        visible = docs.visible_html(h)
        assert shown[i] == [(sha(visible),)] and "<!--" not in visible


def test_search_with_diversity(spark, sf):
    """The decayed candidates, reordered by plain greedy marginal relevance."""
    c = search_plans.chunks(spark, sf).drop("source").withColumnRenamed("kind", "source")
    pool = retrieval.search(c, search_plans.QUERY, search_plans.query_vector(spark, sf), NOW_MS, k=40, candidates=1).collect()
    rows = sorted(((r["score"], -r["id"], set(re.findall("[a-z0-9_]+", (r["snippet"] or "").lower())), r["id"]) for r in pool), key=lambda x: x[:2], reverse=True)
    low, high, chosen = min(r[0] for r in rows), max(r[0] for r in rows), []
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    while len(chosen) < min(10, len(rows)):
        left = [r for r in rows if r not in chosen]
        chosen.append(max(left, key=lambda r: (0.7 * (1.0 if high == low else (r[0] - low) / (high - low)) - 0.3 * max((alike(r[2], x[2]) for x in chosen), default=0), r[0], r[1])))
    found = sorted(catalog.QUERIES["EXT1"](spark, sf).collect(), key=lambda r: r["place"])
    assert [r["id"] for r in found] == [r[3] for r in chosen]
