"""Hybrid retrieval: vector and keyword candidates, fused, decayed by age, diversified (RNK1-3, JN1-2, MTH4, DT8-9, WIN6)."""

from __future__ import annotations

import functools
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestream.functions import text, timefns, vector

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def vector_top_k(chunks: DataFrame, query: DataFrame, k: int, embedding: str = "embedding") -> DataFrame:
    """The k chunks of the highest cosine with the one-row query (column q), as (id, vector_score); non-finite scores are dropped, k of 0 or less gives none.

    The query is one row, so it is broadcast; the order and limit become one top-k that ships k rows of each partition.
    """
    scored = chunks.join(F.broadcast(query.limit(1))).select("id", vector.cosine(F.col(embedding), F.col("q")).alias("vector_score"))
    return scored.filter(~F.isnan("vector_score")).orderBy(F.desc("vector_score"), "id").limit(max(0, k))


def query_tokens(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def keyword_rank(chunks: DataFrame, query: str, every: bool = True, body: str = "text") -> DataFrame:
    """(id, rank): negated BM25 of the chunks that hold all query tokens, or any of them; smaller is better.

    Texts are split into tokens nowhere. One scan counts the tokens of all texts and the texts that hold each query token, another the query's tokens; in both a token is
    searched as a word only where the text contains it at all. The corpus figures are one row, which is broadcast.
    """
    words = query_tokens(query)
    if not words:
        return chunks.filter(F.lit(False)).select("id", F.lit(0.0).alias("rank"))
    low = chunks.select("id", F.lower(F.col(body)).alias("t"))
    inside = [F.contains("t", F.lit(w)) for w in words]
    # a query token consists of word characters alone, so as a pattern it stands for itself
    word = [text.word_pattern(w) for w in words]
    stats = low.agg(F.count(F.lit(1)).alias("n"), F.avg(text.token_count(F.col("t"))).alias("avgdl"), *[F.count_if(inside[i] & F.rlike("t", F.lit(word[i]))).alias(f"df{i}") for i in range(len(words))])
    matched = functools.reduce(operator.and_ if every else operator.or_, inside)
    counted = low.filter(matched).select("id", text.token_count(F.col("t")).alias("dl"), *[F.when(inside[i], F.regexp_count("t", F.lit(word[i]))).otherwise(0).alias(f"tf{i}") for i in range(len(words))])
    held = functools.reduce(operator.and_ if every else operator.or_, [F.col(f"tf{i}") > 0 for i in range(len(words))])
    joined = counted.filter(held).join(F.broadcast(stats))

    def part(i: int) -> Column:
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    total = part(0)
    for i in range(1, len(words)):
        total = total + part(i)
    return joined.select("id", (-total).alias("rank"))


def keyword_top_k(chunks: DataFrame, query: str, k: int, every: bool = True, body: str = "text") -> DataFrame:
    """(id, keyword_score) of the k best ranks."""
    best = keyword_rank(chunks, query, every, body).orderBy("rank", "id").limit(max(0, k))
    return best.select("id", vector.rank_score(F.col("rank")).alias("keyword_score"))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Full outer merge on id: (id, vector_score, keyword_score, score); a missing side scores 0. A non-empty keyword snippet wins."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    both = vector_hits.withColumnsRenamed({"snippet": "v_snippet"}).join(keyword_hits.withColumnsRenamed({"snippet": "k_snippet"}), "id", "full_outer")
    snippet = []
    if {"v_snippet", "k_snippet"} <= set(both.columns):
        snippet = [F.coalesce(F.nullif("k_snippet", F.lit("")), F.col("v_snippet")).alias("snippet")]
    return both.select("id", zero("vector_score"), zero("keyword_score"), *snippet).withColumn("score", vector.fused(F.col("vector_score"), F.col("keyword_score"), vector_weight, keyword_weight))


def decay_scores(hits: DataFrame, now_ms: int, half_life_days: float, time_ms: Column) -> DataFrame:
    """Scores times the age's decay; hits without a time keep theirs."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - time_ms) / timefns.DAY_MS)
    return hits.withColumn("score", F.when(time_ms.isNull(), F.col("score")).otherwise(F.col("score") * timefns.decay(age, half_life_days)))


def diversify(hits: DataFrame, share: float = 0.7, by: str = "query_id") -> DataFrame:
    """hits (query_id, id, score, snippet; a few rows a query, as top-k gives them) with ``place``: maximal marginal relevance in greedy order.

    A share of 1 is plain order by score. The selection is sequential, so each query's candidates go to one worker.
    """
    share = min(1.0, max(0.0, share))
    schema = hits.select(by, "id", "score", "snippet").schema.simpleString()[7:-1].replace(":", " ") + ", place int"

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        import re

        rows = group.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        low, high = rows["score"].min(), rows["score"].max()
        relevance = [1.0 if high == low else (s - low) / (high - low) for s in rows["score"]]
        words = [set(re.findall("[a-z0-9_]+", (t or "").lower())) for t in rows["snippet"]]

        def alike(a: set, b: set) -> float:
            return 1.0 if not a and not b else len(a & b) / len(a | b)

        left, order, nearest = list(range(len(rows))), [], [0.0] * len(rows)
        while left:
            best = max(left, key=lambda i: (relevance[i] if share == 1 else share * relevance[i] - (1 - share) * nearest[i], rows["score"][i], -i))
            left.remove(best)
            order.append(best)
            for i in left:
                nearest[i] = max(nearest[i], alike(words[i], words[best]))
        out = rows.iloc[order].reset_index(drop=True)
        out["place"] = pd.Series(range(1, len(out) + 1), dtype="int32")
        return out

    return hits.select(by, "id", "score", "snippet").groupBy(by).applyInPandas(pick, schema)


def within_budget(hits: DataFrame, chars: int, order: list[Column], body: str = "snippet", by: str | None = None) -> DataFrame:
    """Rows in order until the characters are used up; the row that goes over is cut, later ones are dropped. Without ``by`` the hits are one list, a top-k of a few rows."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    before = F.coalesce(F.sum(F.length(body)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = hits.withColumn("_before", before).filter(F.col("_before") < chars)
    return own.withColumn(body, F.expr(f"substring({body}, 1, CAST({chars} - _before AS INT))")).drop("_before")


def search(chunks: DataFrame, query: str, query_vector: DataFrame, now_ms: int, k: int = 10, candidates: int = 4, least: float = 0.0, half_life_days: float = 30.0, share: float | None = None) -> DataFrame:
    """Both candidate sets, fused, decayed, ordered, optionally diversified, then cut: chunks need id, text, embedding, path, source, mtime_ms."""
    pool = k * candidates
    hits = fuse(vector_top_k(chunks, query_vector, pool), keyword_top_k(chunks, query, pool)).join(chunks.select("id", "path", "source", "mtime_ms", F.substring("text", 1, 700).alias("snippet")), "id")
    hits = decay_scores(hits, now_ms, half_life_days, timefns.decay_time_ms(F.col("path"), F.col("source"), F.col("mtime_ms"))).filter(F.col("score") >= least)
    if share is None:
        return hits.orderBy(F.desc("score"), "id").limit(k)
    few = hits.orderBy(F.desc("score"), "id").limit(pool).withColumn("query_id", F.lit(0))
    return diversify(few, share).orderBy("place").limit(k)


def scope_allowed(key: Column, rules: list[dict], default: str = "allow") -> Column:
    """Ordered allow and deny rules on a session key; the first that matches decides. A rule may name channel, chat_type, key_prefix, raw_key_prefix."""
    from lodestream.functions import keys

    raw = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    inner = F.coalesce(keys.rest(key), raw)
    kind = keys.chat_type(key)
    chosen = F.nullif(kind, F.lit("unknown"))
    channel = F.nullif(F.substring_index(inner, ":", 1), F.lit(""))
    chain = None
    for rule in rules:
        test = F.lit(True)
        if rule.get("channel"):
            test = test & F.coalesce(channel == rule["channel"], F.lit(False))
        if rule.get("chat_type"):
            test = test & F.coalesce(chosen == rule["chat_type"], F.lit(False))
        if prefix := (rule.get("raw_key_prefix") or "").strip().lower():
            test = test & F.startswith(raw, F.lit(prefix))
        if prefix := (rule.get("key_prefix") or "").strip().lower():
            test = test & F.startswith(raw if prefix.startswith("agent:") else inner, F.lit(prefix))
        verdict = F.lit(rule["action"] == "allow")
        chain = F.when(test, verdict) if chain is None else chain.when(test, verdict)
    return F.lit(default == "allow") if chain is None else chain.otherwise(F.lit(default == "allow"))

