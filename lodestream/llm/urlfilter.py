"""URL filter: policy rules first, else gradient-boosted trees on lexical features, all in DataFrame functions.

The trees are trained by Spark's own gradient boosting on labelled URLs and then written out as one SQL expression, so that
scoring is a projection inside generated code. Features: lengths, depth, digit and vowel ratios, entropy, hyphens, parameters, and
smoothed label statistics of the host's suffix and of the file suffix. These are counts over all labelled URLs; a training row gets those of the
other FOLDS, so that no label tells on itself.

Labels: a frame (url, label) of any origin. ``weak_labels`` makes one where there is none, by a rule: URLs whose host has a word of BAD_WORDS are
bad, other URLs are good. The trees are fitted on at most TRAINING_ROWS URLs of each label, in the order of a hash of the URL, weighted back to the labels' shares of all
labelled URLs, so that the share of bad URLs in the sample moves no verdict.

Cases: a null URL or one without ``://`` has an empty host and path, and no rule fits it. With one label only, or none, everything is
allowed that no rule blocks. Repeated URLs get equal verdicts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: URLs of each label that the trees are trained on.
TRAINING_ROWS = 5_000
#: Suffixes with statistics of their own, the most frequent ones, and parts of the labelled URLs that are counted apart.
SUFFIXES, FOLDS = 200, 5
TREES, DEPTH, SEED = 20, 3, 7
#: Host words of weakly labelled bad URLs (fixed values).
BAD_WORDS = "casino casinos bet bets betting poker pills pill viagra pharmacy adult xxx porn sex escort spam farm warez crack keygen torrent malware phish loan loans payday replica cheap free win prize".split()
#: The policy: rule -> verdict (fixed values). A rule is a host, then the start of a path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "longest_label", "digit_ratio", "vowel_ratio", "entropy", "hyphens", "host_digits", "parameters", "query_length", "suffix_rate", "file_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, _PARTS, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, _PARTS, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    chain = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        chain = F.when(fits, F.lit(rule)) if chain is None else chain.when(fits, F.lit(rule))
    return chain if chain is not None else F.lit(None).cast("string")


def _suffixes(df: DataFrame) -> DataFrame:
    file = F.regexp_extract("path", "\\.([A-Za-z0-9]{1,8})$", 1)
    return df.withColumns({"suffix": F.element_at(F.split("host", "\\."), -1), "file": F.lower(file)})


#: Bad and all labelled URLs of each suffix in each fold: (suffix, fold) -> (bad, all).
Counts = dict[tuple[str, int], tuple[int, int]]


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> dict[str, Counts]:
    """For host and file suffixes the counts of all labelled URLs (url, label), of SUFFIXES suffixes at most."""
    host, path = parts(F.col("url"))
    rows = _suffixes(labelled.withColumns({"host": host, "path": path})).withColumn("fold", fold(F.col("url")))
    found = {}
    for kind in ("suffix", "file"):
        counted = rows.groupBy(kind, "fold").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
        most = counted.groupBy(kind).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), kind).limit(SUFFIXES)  # SUFFIXES rows at most
        found[kind] = {(r[kind], r["fold"]): (r["bad"], r["n"]) for r in counted.join(F.broadcast(most), kind).collect()}
    return found


def rates(counts: Counts, without: int | None = None) -> dict[str, float]:
    """Smoothed bad share of every suffix, and of any other under '*', from all folds but one."""
    total: dict[str, list[int]] = {}
    for (name, k), (bad, n) in counts.items():
        own = total.setdefault(name, [0, 0])
        if k != without:
            own[0] += bad
            own[1] += n
    every = [sum(v[0] for v in total.values()), sum(v[1] for v in total.values())]
    prior = (every[0] + 1) / (every[1] + 2)
    return {name: (bad + 2 * prior) / (n + 2) for name, (bad, n) in total.items()} | {"*": prior}


def _rate(name: str, counts: Counts, training: bool) -> Column:
    """A row's rate; in training that of the folds the row isn't in."""
    tables = [rates(counts, k) for k in range(FOLDS)] if training else [rates(counts)]
    literal = lambda t: F.create_map(*[F.lit(x) for kv in sorted(t.items()) for x in kv])
    of = F.element_at(F.array(*map(literal, tables)), fold(F.col("url")) + 1 if training else F.lit(1))
    return F.coalesce(F.element_at(of, F.col(name)), F.element_at(of, F.lit("*")))


def features(df: DataFrame, counts: dict[str, Counts], training: bool = False) -> DataFrame:
    """df (url, host, path) with FEATURES."""
    text = F.coalesce("url", F.lit(""))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    ratio = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    base = _suffixes(df).withColumns({"_text": text, "_letters": F.array_sort(F.split(F.col("host"), "")), "_labels": F.split("host", "\\.")})
    # entropy of the host's characters: runs of the sorted letters
    base = base.withColumn("_runs", F.expr("transform(array_distinct(_letters), c -> size(filter(_letters, x -> x = c)) / size(_letters))"))
    query = F.regexp_extract("_text", "(?s)\\?([^#]*)", 1)
    made = {
        "url_length": F.length("_text"),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": count("path", "/"),
        "host_labels": F.size("_labels"),
        "longest_label": F.array_max(F.transform("_labels", F.length)),
        "digit_ratio": ratio(count("_text", "[0-9]"), F.length("_text")),
        "vowel_ratio": ratio(count("host", "[aeiou]"), F.length("host")),
        "entropy": F.expr("-aggregate(_runs, 0D, (s, p) -> s + if(p > 0, p * log2(p), 0D))"),
        "hyphens": count("host", "-"),
        "host_digits": count("host", "[0-9]"),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "query_length": F.length(query),
        "suffix_rate": _rate("suffix", counts["suffix"], training),
        "file_rate": _rate("file", counts["file"], training),
    }
    return base.withColumns({k: v.cast("double") for k, v in made.items()}).drop("_text", "_letters", "_labels", "_runs", "suffix", "file")


def weak_labels(urls: DataFrame) -> DataFrame:
    """(url, label): 1 where a word of the host is a bad one."""
    host, _ = parts(F.col("url"))
    return urls.filter("url IS NOT NULL").select("url", F.arrays_overlap(F.split(host, "[.\\-]"), F.array(*map(F.lit, BAD_WORDS))).cast("int").alias("label"))


def _node(node, inputs: tuple[str, ...]) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"if({inputs[split.featureIndex()]} <= {split.threshold()!r}D, {_node(node.leftChild(), inputs)}, {_node(node.rightChild(), inputs)})"


def _features_of(labelled: DataFrame, counts: dict[str, Counts], training: bool) -> DataFrame:
    """Rows (features, and the columns of labelled)."""
    from pyspark.ml.feature import VectorAssembler

    host, path = parts(F.col("url"))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(labelled.withColumns({"host": host, "path": path}), counts, training))


def fit(labelled: DataFrame):
    """Spark's model and the suffix counts; no model if there is nothing to learn."""
    spark = labelled.sparkSession
    known = labelled.filter(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").cast("int").alias("label"))
    counts = suffix_counts(known)
    all_of = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(all_of) < 2:
        return None, counts
    order = [F.xxhash64("url"), F.col("url")]
    some = {y: known.filter(F.col("label") == y).orderBy(*order).limit(TRAINING_ROWS).collect() for y in (0, 1)}  # a bounded sample
    rows = [(r["url"], float(y), all_of[y] / len(some[y]) * len(some[0] + some[1]) / sum(all_of.values())) for y in (0, 1) for r in some[y]]
    from pyspark.ml.classification import GBTClassifier

    table = _features_of(spark.createDataFrame(rows, "url string, label double, weight double"), counts, True).select("features", "label", "weight")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, weightCol="weight").fit(table.coalesce(2)), counts


def written(model) -> str:
    """The model's margin as SQL over FEATURES; '' without a model."""
    if model is None:
        return ""
    return " + ".join(f"{float(w)!r}D * ({_node(t._java_obj.rootNode(), FEATURES)})" for w, t in zip(model.treeWeights, model.trees, strict=True))


def probability(margin: str) -> Column:
    """The probability that a URL is bad, 0 without a model."""
    return F.expr(f"1 / (1 + exp(-2 * ({margin})))") if margin else F.lit(0.0)


def judge(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score): score is the trees' probability that the URL is bad."""
    rules = RULES if rules is None else rules
    model, counts = fit(labelled)
    host, path = parts(F.col("url"))
    rows = features(pages.select("page_id", "url").withColumns({"host": host, "path": path}), counts)
    bad = probability(written(model))
    scored = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), bad.alias("score"))
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    decided = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) if rules else F.lit(None).cast("string")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(decided, own).alias("verdict"), "score")
