"""Embeddings and URLs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import embeddings, urlfilter


def brute(rows, least):
    ids = [i for i, _ in rows]
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {k: 0 for k in range(len(rows))}, {k: ids[k] for k in range(len(rows))}
    pairs = []
    for a in good:
        for b in good:
            u, v = rows[a][1], rows[b][1]
            if a != b and len(u) == len(v) and np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                links[a] += 1
                pairs.append((a, b))
    change = True
    while change:
        change = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                change = True
    return sorted((ids[k], links[k], root[k]) for k in range(len(rows)))


@pytest.mark.parametrize("block, leaf, span", [(4096, 512, 8 << 20), (16, 4, 1), (16, 4, 5000)])
def test_embedding_groups(spark, monkeypatch, block, leaf, span):
    monkeypatch.setattr(embeddings, "SPAN_BYTES", span)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        c = rng.normal(size=10)
        rows += [(len(rows) + k, (c + rng.normal(size=10) * s).tolist()) for k, s in enumerate([0, 0.1, 0.2, 0.4, 0.4, 0.5, 0.6])]
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, [2 * x for x in rows[0][1]]), (n + 2, None), (n + 3, [0.0] * 10), (n + 4, [None] * 10), (n + 5, [float("nan")] * 10), (n + 6, [float("inf")] * 10), (n + 7, []), (n + 8, [1.0, 2.0]), (n + 9, [2.0, 4.1]), (n + 10, [1e-200] * 10)]
    df = spark.createDataFrame([(i, v, 1, 9) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near(df, 0.9).collect())
    assert out == brute([(i, v if not v or v[0] != 1e-200 else [1.0] * 10) for i, v in rows], 0.9)
    assert embeddings.near(df, 0.9).filter("kept <> (vec_id = component_id)").count() == 0


def test_vectors_without_an_id(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    df = spark.createDataFrame([(None, v), (None, v), (4, v), (2, v), (None, w), (None, None)], "vec_id long, embedding array<double>")
    out = sorted(embeddings.near(df, 0.9).collect(), key=lambda r: (r["vec_id"] or 0))
    assert [tuple(r) for r in out] == [(None, 0, None, False)] * 4 + [(2, 1, 2, True), (4, 1, 2, False)]


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near(df).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near(nulls).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"), ("http://net", "net", "", None, None), ("http://net/", "net", "/", "net/", "block"), ("http://myexample.com/de/x", "myexample.com", "/de/x", None, None),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://x.com?y=/de/", "x.com", "", None, None), ("http://x.com#f", "x.com", "", None, None), ("http://É.NET/x", "É.net", "/x", "net/", "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    out = {r["page_id"]: r for r in urlfilter.judge(pages, spark.createDataFrame([], "url string, label int")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule) and out[i]["verdict"] == (verdict or "allow")


def test_trees_learn_and_generalise(spark):
    good = [(f"https://site{i}.example.org/a/{i}", 0) for i in range(60)]
    bad = [(f"https://free-casino-{i}.example.com/{i}{i}?a=1&b=2", 1) for i in range(60)]
    labelled = spark.createDataFrame([*good, *bad, (None, 1), ("x", None)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://win-big-casino.example.com/77?z=1&q=2"), (2, "http://news.example.org/a/5")], "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, labelled, rules={}).collect()}
    assert out == {1: "block", 2: "allow"}
    plan = urlfilter.judge(pages, labelled)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_trees_equal_the_model_on_held_out_urls(spark):
    """The expression gives the probabilities of Spark's own model, and they tell weakly labelled URLs that it wasn't trained on apart."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = urlfilter.weak_labels(rows).groupBy("url").agg(F.max("label").alias("label"))
    held = urlfilter.fold(F.col("url")) == 0
    model, counts = urlfilter.fit(labelled.filter(~held))
    table = urlfilter._features_of(labelled.filter(held), counts, False).withColumn("own", urlfilter.probability(urlfilter.written(model)))
    from pyspark.ml.functions import vector_to_array

    got = model.transform(table).select("label", "own", vector_to_array("probability")[1].alias("theirs")).collect()
    assert len(got) > 300 and all(abs(r["own"] - r["theirs"]) < 1e-9 for r in got)
    bad, good = [r["own"] for r in got if r["label"]], [r["own"] for r in got if not r["label"]]
    area = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    print("held-out area", area, len(bad), len(good))
    assert bad and area > 0.5


def test_the_share_of_bad_urls_in_the_sample_moves_no_verdict(spark, monkeypatch):
    """Few rows of each label, weighted back, give the mean probability that the labels have."""
    rows = [(f"https://site{i}.example{i % 7}.org/a/{i}", int(i % 20 == 0)) for i in range(2000)]
    monkeypatch.setattr(urlfilter, "TRAINING_ROWS", 100)
    labelled = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    assert urlfilter.judge(pages, labelled, rules={}).agg(F.avg("score")).first()[0] < 0.2


def test_suffix_rates_leave_a_rows_fold_out():
    counts = {("x", 0): (9, 10), ("x", 1): (1, 10), ("y", 2): (0, 5)}
    assert urlfilter.rates(counts, 0)["x"] < urlfilter.rates(counts)["x"] < urlfilter.rates(counts, 1)["x"] and set(urlfilter.rates(counts)) == {"x", "y", "*"}
    assert urlfilter.rates({}) == {"*": 0.5}


def test_url_features_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(pages, urlfilter.weak_labels(pages)).count() == 0 and pages.select(F.lit(1)).count() == 0
