"""The pipeline against brute force of its stages, and the registered queries."""

import hashlib
import random

import pytest

import corpus_pipeline
from lodestream.llm import queries
from tests.llm.conftest import prose
from tests.llm.test_text_operators import without_words
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents table with planted cases, their labels, and a benchmark."""
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    passage, item = prose(rng, 120), prose(rng, 30)
    texts = {i: prose(rng, 300) for i in range(60)}
    texts |= {100: texts[1], 101: texts[1] + " end", 102: prose(rng, 200) + " you stupid idiot.", 103: f"{prose(rng, 200)} {passage}", 104: f"{passage} {prose(rng, 220)}", 105: f"{prose(rng, 100)} {item} {prose(rng, 90)}", 106: None, 107: "", 108: "short"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts, item


def test_stages_take_effect(spark, folder):
    at, texts, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at)
        if i < 4:
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    assert set(texts) - set(kept[0]) == {102}
    assert set(kept[0]) - set(kept[1]) == {100, 101, 107}  # null and empty texts are copies of each other
    ids = sorted(kept[1])
    assert [kept[2][i]["text"] or "" for i in ids] == without_words([texts[i] for i in ids], 48)
    assert kept[2][106]["text"] is None and all(r["n_chars"] == len(r["text"]) for r in kept[2].values() if r["text"] is not None)
    assert set(kept[2]) - set(kept[3]) == {105} and set(kept[4]) == set(kept[3])
    assert all(kept[4][i]["decoded_sha256"] == hashlib.sha256((kept[3][i]["text"] or "").encode()).hexdigest() for i in kept[4])
    run = {r["doc_id"]: r for r in corpus_pipeline.run(spark, at).collect()}
    assert run == kept[4]


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    at, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), queries.ORACLES[name], connect(sf)) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_every_row(spark, sf, name):
    table = {"op4_url_filter": "pages", "op7_embeddings": "embeddings"}.get(name, "documents")
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
