"""Document queries whose semantics need Python (STR3, 7, 9-16, 20, 23, 24, 34, FLT20, RNK9, DT5-6, SRC13); SQL where a digest can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import chunking, cron, documents as docs
from lodestream.plans.registry import Registry
from lodestream.plans.scalar import NOW_MS
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("STR3")
def keyword_extraction(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(docs.keyword_arrays(F.col("text")), " ").alias("keywords"))


@R.add("STR7")
def chunker(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), 100, 20).select("doc_id", "start_line", "end_line", "hash")


@R.add("STR7_plain", "SELECT doc_id, CAST(i AS INTEGER) AS start_line, sha256(line) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) + 1 > 1000000)) = 0) WHERE false UNION ALL SELECT doc_id, 1, sha256(text) FROM documents WHERE length(text) + 1 <= 400000")
def chunker_plain(spark, sf_dir):
    """Texts that fit one chunk are that chunk."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), 100_000, 0).select("doc_id", "start_line", "hash")


@R.add("STR9")
def byte_splitter(spark, sf_dir):
    return chunking.exploded(table(spark, sf_dir, "documents"), "doc_id", "text", "part string", lambda t: [(p,) for p in chunking.utf8_parts(t, 1000)]).select("doc_id", F.octet_length("part").alias("bytes"), F.sha2("part", 256).alias("hash"))


@R.add("STR9_whole", "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) > 0")
def byte_splitter_whole(spark, sf_dir):
    """The pieces of a text add up to it."""
    parts = chunking.exploded(table(spark, sf_dir, "documents").filter("octet_length(text) > 0"), "doc_id", "text", "part string", lambda t: [(p,) for p in chunking.utf8_parts(t, 1000)])
    return parts.groupBy("doc_id").agg(F.sum(F.octet_length("part")).alias("bytes"))


@R.add("STR10")
def enforced_chunks(spark, sf_dir):
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents"), 400, 80)
    return chunking.enforce_bytes(chunks, 800).select("doc_id", "start_line", "end_line", F.octet_length("chunk").alias("bytes"), "hash")


@R.add("STR11")
def break_chunker(spark, sf_dir):
    return chunking.exploded(table(spark, sf_dir, "documents"), "doc_id", "text", "part string", lambda t: [(p,) for p in chunking.break_chunks(t, 500, chunking.last_break)]).select("doc_id", F.sha2("part", 256).alias("hash"))


@R.add("STR12")
def block_chunker(spark, sf_dir):
    return chunking.exploded(table(spark, sf_dir, "documents"), "doc_id", "text", "part string", lambda t: [(p,) for p in chunking.paragraph_chunks(t, 200, 800)]).select("doc_id", F.length("part").alias("chars"), F.sha2("part", 256).alias("hash"))


@R.add("STR13", "SELECT page_id, CAST(0 AS INTEGER) AS start, CAST(length(url) + 8 AS INTEGER) AS stop FROM pages")
def fence_spans(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("```\n"), "url", F.lit("\n```\nrest")).alias("body"))
    return chunking.exploded(p, "page_id", "body", "start int, stop int", chunking.fences)


@R.add("STR14", r"""SELECT event_id, 'API_TOKEN=' || CASE WHEN event_id % 2 = 0 THEN substr(t, 1, 6) || '…' || substr(t, length(t) - 3) ELSE '***' END || ' --password ***' AS line FROM (SELECT event_id, 'x' || event_id || 'abcdefghijklmnopqrst' || event_id AS t FROM events)""")
def redaction(spark, sf_dir):
    number = F.col("event_id").cast("string")
    secret = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x"), number, F.lit("abcdefghijklmnopqrst"), number)).otherwise(F.concat(F.lit("s"), number))
    return table(spark, sf_dir, "events").select("event_id", docs.redacted(F.concat(F.lit("API_TOKEN="), secret, F.lit(" --password hunter2"))).alias("line"))


@R.add("STR15")
def document_redaction(spark, sf_dir):
    """Whole documents, never cut in slices."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(docs.redacted(F.col("text")), 256).alias("hash"))


def _fuzzy_sql(key: str, body: str, source: str, query: str) -> str:
    """The score of every word of the query from its characters' leftmost places, counted from 1; a step on, a gap, a word's beginning and the place are written out for each character."""
    parts = []
    for word in query.split():
        found = f"(SELECT {key}, {body} AS b FROM {source})"
        for k, c in enumerate(word):
            at = f"instr(b, '{c}')" if k == 0 else f"CASE WHEN instr(substr(b, p{k - 1} + 1), '{c}') = 0 THEN 0 ELSE p{k - 1} + instr(substr(b, p{k - 1} + 1), '{c}') END"
            before = "0" if k == 0 else f"p{k - 1}"
            run = "0" if k == 0 else f"r{k - 1}"
            found = f"(SELECT *, CASE WHEN p{k} = {before} + 1 THEN {run} + 1 ELSE 0 END AS r{k} FROM (SELECT *, {at} AS p{k} FROM {found} WHERE {'true' if k == 0 else f'p{k - 1} > 0'}))"
        cost = " + ".join(
            f"0.1::DOUBLE * (p{k} - 1) - 5 * r{k} + {'0' if k == 0 else f'CASE WHEN r{k} = 0 THEN 2 * (p{k} - p{k - 1} - 1) ELSE 0 END'} - CASE WHEN p{k} = 1 OR regexp_matches(substr(b, p{k} - 1, 1), '[-\\s_./:#@]') THEN 10 ELSE 0 END"
            for k in range(len(word))
        )
        parts.append(f"SELECT {key}, {cost} AS cost FROM {found} WHERE p{len(word) - 1} > 0")
    return f"SELECT {key}, round(sum(cost), 4) AS fuzzy FROM ({' UNION ALL '.join(parts)}) GROUP BY {key} HAVING count(*) = {len(parts)}"


@R.add("STR16", _fuzzy_sql("p_partkey", "lower(p_name)", "part", "an e"))
def fuzzy_scores(spark, sf_dir):
    return docs.fuzzy_rank(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "an e", "p_name").select("p_partkey", F.round("fuzzy", 4).alias("fuzzy"))


@R.add("RNK9", _fuzzy_sql("c_custkey", "lower(c_name || ' ' || c_mktsegment)", "customer", "cust mach"))
def fuzzy_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", text.search_text(F.col("c_name"), F.col("c_mktsegment"), F.lit("")).alias("search"))
    return docs.fuzzy_rank(c, "cust mach", "search").select("c_custkey", F.round("fuzzy", 4).alias("fuzzy"))


@R.add("STR20")
def markdown(spark, sf_dir):
    return docs.map_texts(table(spark, sf_dir, "pages"), "page_id", "html", title=docs.html_title, markdown=docs.html_to_markdown).select("page_id", "title", F.sha2("markdown", 256).alias("hash"))


@R.add("STR20_title", r"""SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>([\s\S]*?)</title>', 1), '&amp;', '&'), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>')) AS title FROM pages""")
def titles(spark, sf_dir):
    return docs.map_texts(table(spark, sf_dir, "pages"), "page_id", "html", title=docs.html_title)


@R.add("STR23", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?[\x00-\x20]*[A-Za-z0-9:-]+(?:[^>]{0,200}>)?')) AS tag, generate_subscripts(regexp_extract_all(html, '</?[\x00-\x20]*[A-Za-z0-9:-]+(?:[^>]{0,200}>)?'), 1) AS i FROM pages),
    m AS (SELECT page_id, i, CASE WHEN tag LIKE '</%' THEN -1 WHEN tag LIKE '%/>' OR lower(regexp_extract(tag, '^<[\x00-\x20]*([A-Za-z0-9:-]+)', 1)) IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') THEN 0 ELSE 1 END AS d FROM t),
    r AS (SELECT page_id, i, sum(d) OVER w AS level FROM m WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    g AS (SELECT page_id, level - least(0, min(level) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM r)
    SELECT page_id, CAST(coalesce(max(depth), 0) AS INTEGER) AS depth FROM pages LEFT JOIN g USING (page_id) GROUP BY page_id""")
def nesting(spark, sf_dir):
    return docs.map_texts(table(spark, sf_dir, "pages"), "page_id", "html", depth=lambda h: str(docs.nesting_depth(h))).select("page_id", F.col("depth").cast("int").alias("depth"))


@R.add("STR24")
def readable(spark, sf_dir):
    """Sanitised pages as plain text, in one pass and then built-in functions."""
    m = docs.map_texts(table(spark, sf_dir, "pages"), "page_id", "html", markdown=docs.readable_markdown)
    return m.select("page_id", text.strip_invisible(text.markdown_to_text(F.col("markdown"))).alias("body")).select("page_id", F.length("body").alias("chars"), F.sha2("body", 256).alias("hash"))


@R.add("FLT20", "SELECT page_id, '<p>' || url || '</p><b>end</b>' AS shown FROM pages")
def visible_pages(spark, sf_dir):
    source = F.concat(F.lit('<!-- x --><div hidden>no<p>no</p></div><p>'), "url", F.lit('</p><span style="display: none">no</span><i class="a SR-only">no</i><meta name="x"><b>end</b>'))
    p = table(spark, sf_dir, "pages").select("page_id", source.alias("body"))
    return docs.map_texts(p, "page_id", "body", shown=docs.visible_html)


@R.add("FLT20_pages")
def visible_whole_pages(spark, sf_dir):
    return docs.map_texts(table(spark, sf_dir, "pages"), "page_id", "html", shown=docs.visible_html).select("page_id", F.sha2("shown", 256).alias("hash"))


@R.add("STR34", "SELECT page_id, url AS name, 'two words' AS description FROM pages")
def front_matter(spark, sf_dir):
    block = F.concat(F.lit("---\nname: "), "url", F.lit("\ndescription: 'two words'\nempty:\n---\nbody: no"))
    m = table(spark, sf_dir, "pages").select("page_id", docs.front_matter_map(block).alias("m"))
    return m.select("page_id", F.col("m")["name"].alias("name"), F.col("m")["description"].alias("description"))


@R.add("SRC13", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE 2 END AS hits FROM events")
def backend_output(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("WARN: no results found."), F.lit('[{"docid": "a"}, {"docid": "]"}]'), F.lit('noise [{"docid": "a\\"]"}, {"docid": "b"}] tail'), F.lit("nothing here")), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))

    def count(t: str) -> str | None:
        rows = docs.backend_rows(t)
        return None if rows is None else str(len(rows))

    return docs.map_texts(e, "event_id", "raw", hits=count).select("event_id", F.col("hits").cast("int").alias("hits"))


@R.add("DT5_cron", "SELECT p_partkey, 1706745600000 + CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 60) * 60000 + CASE WHEN p_partkey % 60 = 0 THEN 3600000 ELSE 0 END WHEN 1 THEN 9 * 3600000 ELSE 4 * 86400000 + 30 * 60000 END AS next_ms FROM part")
def cron_next(spark, sf_dir):
    minute = (F.col("p_partkey") % 60).cast("string")
    expr = F.element_at(F.array(F.concat(minute, F.lit(" * * * *")), F.lit("0 0 9 * * 1-5"), F.lit("30 0 * * mon")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", cron.fire_column(expr, F.lit(NOW_MS).cast("long")).alias("next_ms"))


@R.add("DT6", "SELECT p_partkey, 1706745600000 - CASE WHEN p_partkey % 2 = 0 THEN 1800000 ELSE 15 * 3600000 END AS previous_ms FROM part")
def cron_previous(spark, sf_dir):
    expr = F.when(F.col("p_partkey") % 2 == 0, "30 * * * *").otherwise("0 9 * * *")
    return table(spark, sf_dir, "part").select("p_partkey", cron.fire_column(expr, F.lit(NOW_MS).cast("long"), backward=True).alias("previous_ms"))
