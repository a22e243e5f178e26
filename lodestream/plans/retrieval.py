"""Retrieval queries (RNK1-3, JN1-2, SET1, SET5, FLT1-2, FLT18, WIN6, EXT1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.functions import text
from lodestream.operators import retrieval as ops
from lodestream.plans.registry import Registry
from lodestream.plans.scalar import NOW_MS
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
QUERY = "the and for"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with the vector of the same number."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("model"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("memory/2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit(".md"))).when(F.col("id") % 3 == 1, F.lit("memory/topic.md")).otherwise(F.lit("sessions/x.jsonl"))
    return d.join(e, "id").withColumns({"path": path, "kind": F.when(F.col("id") % 3 == 2, "sessions").otherwise("memory"), "mtime_ms": F.lit(NOW_MS) - F.col("id") * 3_600_000})


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 3").select(F.col("embedding").alias("q"))


_QV = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)"
_VECTOR = f"SELECT doc_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS vector_score FROM documents JOIN embeddings ON doc_id = vec_id, {_QV} ORDER BY vector_score DESC, id LIMIT "
_BM25 = """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents%s),
    c AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b, len(list_filter(t, lambda x: x = 'for')) AS c FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM c),
    r AS (SELECT id, -(""" + " + ".join(f"greatest(0.000001::DOUBLE, ln((n - d{x} + 0.5::DOUBLE) / (d{x} + 0.5::DOUBLE))) * {x} * 2.2::DOUBLE / ({x} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for x in "abc") + ") AS rank FROM c, s WHERE a > 0 AND b > 0 AND c > 0) "
_SCORE = "CASE WHEN rank < 0 THEN -rank / (1 - rank) ELSE 1 / (1 + rank) END"


@R.add("RNK1", f"SELECT id, round(vector_score, 6) AS score FROM ({_VECTOR} 20)")
def vector_hits(spark, sf_dir):
    return ops.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 20).select("id", F.round("vector_score", 6).alias("score"))


@R.add("RNK3", (_BM25 % "") + f"SELECT id, round({_SCORE}, 6) AS score FROM r ORDER BY rank, id LIMIT 20")
def keyword_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ops.keyword_top_k(docs, QUERY, 20).select("id", F.round("keyword_score", 6).alias("score"))


_FUSED = (_BM25 % " JOIN embeddings ON doc_id = vec_id") + f""", v AS ({_VECTOR} 40), k AS (SELECT id, {_SCORE} AS keyword_score FROM r ORDER BY rank, id LIMIT 40),
    f AS (SELECT id, coalesce(vector_score, 0) AS vs, coalesce(keyword_score, 0) AS ks, 0.7::DOUBLE * coalesce(vector_score, 0) + 0.3::DOUBLE * coalesce(keyword_score, 0) AS score FROM v FULL JOIN k USING (id)) """


def _fused(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return ops.fuse(ops.vector_top_k(c, query_vector(spark, sf_dir), 40), ops.keyword_top_k(c, QUERY, 40))


@R.add("JN2", _FUSED + "SELECT id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(score, 6) AS score FROM f")
def fused_hits(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "score")])


@R.add("SET1", _FUSED + "SELECT id FROM f")
def merged_ids(spark, sf_dir):
    return _fused(spark, sf_dir).select("id")


@R.add("JN1", "SELECT vec_id, source, length(text) AS chars FROM embeddings JOIN documents ON vec_id = doc_id")
def vector_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.length("text").cast("long").alias("chars"))
    return e.join(d, "vec_id")


@R.add("FLT1", "SELECT doc_id FROM documents WHERE lang = 'de'")
def model_filter(spark, sf_dir):
    return filtered(table(spark, sf_dir, "documents"), model="de").select("doc_id")


@R.add("FLT2", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def source_filter(spark, sf_dir):
    return filtered(table(spark, sf_dir, "documents"), sources=["src1", "src2"]).select("doc_id")


def filtered(df: DataFrame, model: str | None = None, sources: list[str] | None = None) -> DataFrame:
    """Both filters are pushed to the scan; the model is left out where only keywords are searched."""
    if model is not None:
        df = df.filter(F.col("lang") == model)
    return df.filter(F.col("source").isin(*sources)) if sources else df


_SCOPE = [{"action": "deny", "chat_type": "group"}, {"action": "allow", "channel": "slack"}, {"action": "deny", "raw_key_prefix": "agent:c:"}, {"action": "deny", "key_prefix": "discord:acc"}]


@R.add("FLT18", "SELECT event_id, event_type NOT IN ('view', 'purchase', 'signup') AS allowed FROM events")
def scope_rules(spark, sf_dir):
    from lodestream.plans.scalar import _KEYS_SPARK

    e = table(spark, sf_dir, "events").withColumn("key", F.expr(_KEYS_SPARK))
    return e.select("event_id", ops.scope_allowed(F.col("key"), _SCOPE).alias("allowed"))


@R.add("SET5", """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(list_concat(a.t, b.t)) = 0 THEN 1 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccards(spark, sf_dir):
    """Token overlap of each turn and the next one of its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("t"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@R.add("WIN6", """SELECT source, doc_id, least(n, 20000 - before)::BIGINT AS chars FROM (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < 20000""")
def char_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("snippet"))
    return ops.within_budget(d, 20_000, [F.col("doc_id")], by="source").select("source", "doc_id", F.length("snippet").cast("long").alias("chars"))


#: The ten longest documents of each source, their relevance and word sets, and the likeness of every two.
_CANDIDATES = """d AS (SELECT source, doc_id, length(text)::DOUBLE AS score, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS o FROM documents),
    c AS (SELECT *, CASE WHEN max(score) OVER q = min(score) OVER q THEN 1 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END AS rel FROM d WHERE o <= 10 WINDOW q AS (PARTITION BY source)),
    p AS (SELECT a.source, a.doc_id AS i, b.doc_id AS j, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END AS alike FROM c a JOIN c b ON a.source = b.source AND a.doc_id <> b.doc_id)"""


@R.add("RNK2", f"""WITH RECURSIVE {_CANDIDATES},
    s AS (SELECT source, [doc_id] AS chosen, 1 AS place FROM c WHERE o = 1 UNION ALL
      SELECT source, list_append(chosen, best), place + 1 FROM (
        SELECT source, chosen, place, arg_max(doc_id, (value, score, -o)) AS best FROM (
          SELECT s.source, s.chosen, s.place, c.doc_id, c.score, c.o, 0.7::DOUBLE * c.rel - (1 - 0.7::DOUBLE) * greatest(0, max(p.alike)) AS value
          FROM s JOIN c ON c.source = s.source AND NOT list_contains(s.chosen, c.doc_id) JOIN p ON p.source = s.source AND p.i = c.doc_id AND list_contains(s.chosen, p.j)
          GROUP BY s.source, s.chosen, s.place, c.doc_id, c.score, c.o, c.rel) GROUP BY source, chosen, place))
    SELECT s.source AS query_id, doc_id AS id, score, CAST(place AS INTEGER) AS place FROM s JOIN c ON c.source = s.source AND c.doc_id = chosen[place]""")
def diversified(spark, sf_dir):
    """Marginal relevance of each source's ten longest documents as candidates."""
    from lodestream.operators.rollups import top_per_group

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.length("text").cast("double").alias("score"), F.col("text").alias("snippet"))
    few = top_per_group(d, "query_id", [F.desc("score"), F.asc("id")], 10)
    return ops.diversify(few, 0.7).select("query_id", "id", F.round("score", 4).alias("score"), "place")


@R.add("JN9", f"WITH {_CANDIDATES}, k AS (SELECT p.*, row_number() OVER (PARTITION BY p.source, i ORDER BY alike DESC, c.o) AS n FROM p JOIN c ON c.source = p.source AND c.doc_id = p.j) SELECT source AS query_id, i AS id, j AS nearest, round(alike, 6) AS alike FROM k WHERE n = 1")
def nearest_candidates(spark, sf_dir):
    """For each candidate of a source the one most like it: the product of a few rows a source with themselves, and a maximum."""
    from lodestream.operators.rollups import top_per_group

    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.length("text").alias("score"), text.token_set(F.col("text")).alias("words"))
    few = top_per_group(d, "source", [F.desc("score"), F.asc("id")], 10, "o")
    other = few.select("source", F.col("id").alias("nearest"), F.col("words").alias("theirs"), (-F.col("o")).alias("o"))
    pairs = few.drop("o").join(other, "source").filter(F.col("id") != F.col("nearest"))
    best = F.max(F.struct(text.jaccard(F.col("words"), F.col("theirs")).alias("alike"), "o", "nearest"))
    return pairs.groupBy(F.col("source").alias("query_id"), "id").agg(best.alias("b")).select("query_id", "id", "b.nearest", F.round("b.alike", 6).alias("alike"))


@R.add("EXT1")
def memory_search(spark, sf_dir):
    """The whole retrieval path with decay and diversity."""
    c = chunks(spark, sf_dir).drop("source").withColumnRenamed("kind", "source")
    hits = ops.search(c, QUERY, query_vector(spark, sf_dir), NOW_MS, k=10, share=0.7)
    return hits.select("id", F.round("score", 6).alias("score"), "place")


@R.add("EXT1_decayed", _FUSED + f""", d AS (SELECT id, score * CASE id % 3 WHEN 1 THEN 1 WHEN 0 THEN exp(-ln(2) / 30 * greatest(0, ({NOW_MS} - epoch_ms(make_timestamp(2024, 1, (id % 28 + 1)::BIGINT, 0, 0, 0::DOUBLE))) / 86400000.0::DOUBLE))
      ELSE exp(-ln(2) / 30 * (id * 3600000) / 86400000.0::DOUBLE) END AS score FROM f) SELECT id, round(score, 6) AS score FROM d ORDER BY d.score DESC, id LIMIT 10""")
def memory_search_plain(spark, sf_dir):
    """Without diversity, which SQL can say."""
    c = chunks(spark, sf_dir).drop("source").withColumnRenamed("kind", "source")
    return ops.search(c, QUERY, query_vector(spark, sf_dir), NOW_MS, k=10).select("id", F.round("score", 6).alias("score"))
