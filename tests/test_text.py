"""Text, time and number functions on the cases of the reference's own tests."""

import pytest
from pyspark.sql import functions as F

from lodestream.functions import keys, text, timefns, usage, vector


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("query, expected", [("hello world", '"hello" AND "world"'), ("FOO_bar baz-1", '"FOO_bar" AND "baz" AND "1"'), ("金银价格", '"金银价格"'), ("   ", None)])
def test_fts_query(spark, query, expected):
    assert one(spark, text.fts_query(F.lit(query))) == expected


def test_rank_score(spark):
    score = lambda x: one(spark, vector.rank_score(F.lit(float(x))))
    assert score(0) == 1 and score(1) == 0.5 and score(-100) == pytest.approx(100 / 101)
    assert score(-4.2) > score(-2.1) > score(-0.5)
    assert score("nan") == pytest.approx(0.001)


def test_cosine_over_the_shorter_length_and_zero_norm(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vector.cosine(a(1, 0, 5), a(1, 0))) == pytest.approx(1)
    assert one(spark, vector.cosine(a(0, 0), a(1, 0))) == 0
    order = sorted("abc", key=lambda k: -one(spark, vector.cosine({"a": a(1, 0, 0, 0), "b": a(0, 1, 0, 0), "c": a(0.2, 0.2, 0, 0)}[k], a(1, 0, 0, 0))))
    assert order == ["a", "c", "b"]


def test_jaccard_of_empty_sets(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("x"))
    assert one(spark, text.jaccard(none, none)) == 1 and one(spark, text.jaccard(none, some)) == 0 and one(spark, text.jaccard(some, some)) == 1


@pytest.mark.parametrize("given, ms", [("2026-02-05", 1770249600000), (" 2026-02-05 ", 1770249600000), ("2026-2-5", None), ("nope", None), (None, None)])
def test_strict_date(spark, given, ms):
    assert one(spark, timefns.strict_date_ms(F.lit(given).cast("string"))) == ms


@pytest.mark.parametrize("given, minutes", [("UTC-4", -240), ("UTC+5:30", 330), (" UTC+14 ", 840), ("UTC+14:30", None), ("UTC+5:99", None), ("UTC+25", None), ("GMT+5", None)])
def test_utc_offset(spark, given, minutes):
    assert one(spark, timefns.utc_offset_minutes(F.lit(given))) == minutes


DAY = timefns.DAY_MS
FEB_5 = 1770249600000


@pytest.mark.parametrize("options, start, end", [
    ({"start": "2026-02-01", "end": "2026-02-02"}, FEB_5 - 4 * DAY, FEB_5 - 2 * DAY - 1),
    ({"start": "2026-02-01", "end": "2026-02-02", "mode": "specific", "utc_offset": "UTC+5:30"}, FEB_5 - 4 * DAY - 19_800_000, FEB_5 - 2 * DAY - 1 - 19_800_000),
    ({"start": "2026-02-01", "end": "2026-02-02", "mode": "specific", "utc_offset": "bad"}, FEB_5 - 4 * DAY, FEB_5 - 2 * DAY - 1),
    ({"days": 0}, FEB_5, FEB_5 + DAY - 1),
    ({}, FEB_5 - 29 * DAY, FEB_5 + DAY - 1),
    ({"days": 1, "mode": "gateway", "local": "Europe/Paris"}, FEB_5 - 3_600_000, FEB_5 + DAY - 1 - 3_600_000),
])
def test_date_range(options, start, end):
    assert timefns.date_range(FEB_5 + 45_296_000, **options) == timefns.DateRange(start, end)


@pytest.mark.parametrize("given, ms", [("1h30m", 5_400_000), ("500ms", 500), ("2m500ms", 120_500), ("10", 10), ("1.5s", 1500), ("1h x", None), ("", None), ("h", None)])
def test_duration(spark, given, ms):
    assert one(spark, timefns.duration_ms(F.lit(given))) == ms


def test_stagger_of_known_job(spark):
    assert one(spark, timefns.stagger_offset_ms(F.lit("hourly-job-a"), F.lit(300_000))) == 178_507
    for expr, top in (("0 * * * *", True), ("0 0 */2 * * *", True), ("5 * * * *", False), ("0 9 * * *", False)):
        assert one(spark, timefns.is_top_of_hour(F.lit(expr))) is top


def test_decay(spark):
    assert one(spark, timefns.decay(F.lit(30.0), 30)) == pytest.approx(0.5)
    assert one(spark, timefns.decay(F.lit(-5.0), 30)) == 1 and one(spark, timefns.decay(F.lit(5.0), 0)) == 1


def test_every_schedule(spark):
    nxt = lambda now, every, anchor: one(spark, timefns.next_every(F.lit(now), F.lit(every), F.lit(anchor)))
    assert nxt(5, 100, 50) == 50 and nxt(50, 100, 50) == 150 and nxt(151, 100, 50) == 250
    assert nxt(150, 100, 50) == 150 and nxt(250, 100, 50) == 250


def test_active_hours(spark):
    at = lambda h, m=0: F.lit(FEB_5 + (h * 60 + m) * 60_000)
    inside = lambda now, a, b, zone="UTC": one(spark, timefns.within_active_hours(now, a, b, zone))
    assert inside(at(9), "09:00", "17:00") and not inside(at(17), "09:00", "17:00")
    assert inside(at(23), "22:00", "06:00") and inside(at(5, 59), "22:00", "06:00") and not inside(at(6), "22:00", "06:00")
    assert not inside(at(9), "09:00", "09:00") and inside(at(3), "9:00", "x") and inside(at(23, 59), "00:00", "24:00")


@pytest.mark.parametrize("key, kind, agent, depth", [
    ("agent:main:discord:group:x", "group", "main", 0), ("Agent:A:slack:channel:c", "channel", "a", 0), ("agent:m:dm:5", "direct", "m", 0), ("discord:acc:guild-1:channel-2", "channel", None, 0),
    ("", "unknown", None, 0), (None, "unknown", None, 0), ("agent:m:x:subagent:1:subagent:2", "unknown", "m", 2), ("agent:", "unknown", None, 0)])
def test_session_keys(spark, key, kind, agent, depth):
    c = F.lit(key).cast("string")
    assert one(spark, keys.chat_type(c)) == kind and one(spark, keys.agent_id(c)) == agent and one(spark, keys.subagent_depth(c)) == depth


def test_thread_parent(spark):
    assert one(spark, keys.thread_parent(F.lit("agent:a:X:thread:1:topic:2"))) == "agent:a:X:thread:1"
    assert one(spark, keys.thread_parent(F.lit(":thread:1"))) is None and one(spark, keys.thread_parent(F.lit("agent:a:b"))) is None


@pytest.mark.parametrize("raw, expected", [
    ('{"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 2}', (5, 7, 2, None, None)), ('{"prompt_tokens": -3}', (0, None, None, None, None)),
    ('{"prompt_tokens_details": {"cached_tokens": 9}}', (None, None, 9, None, None)), ('{"totalTokens": 4}', (None, None, None, None, 4)), ("{}", None)])
def test_usage_aliases(spark, raw, expected):
    found = one(spark, usage.normalized(F.lit(raw)))
    assert (None if found is None else tuple(found)) == expected


@pytest.mark.parametrize("value, shown", [(950.0, "950"), (1500.0, "1.5k"), (12_345.0, "12k"), (999_600.0, "1.0m"), (3_400_000.0, "3.4m"), (-5.0, "0"), (None, "0")])
def test_token_counts(spark, value, shown):
    assert one(spark, usage.token_count(F.lit(value).cast("double"))) == shown


def test_links_and_slugs(spark):
    assert one(spark, text.links(F.lit("[a](http://x.y/1) http://b.c/2 http://b.c/2 http://localhost/ https://d.e"), 5)) == ["http://b.c/2", "https://d.e"]
    assert one(spark, text.hyphen_slug(F.lit("  Foo  Bar!!x "))) == "foo-bar-x" and one(spark, text.at_hash_slug(F.lit("@#My_Chan nel"))) == "my-chan-nel"
    assert one(spark, text.largest_b_number(F.lit("model-8b 70b, 3b"))) == 8  # neighbours share a delimiter


def test_markdown_and_invisible(spark):
    assert one(spark, text.markdown_to_text(F.lit("# T\n- a [l](u) `c`\n```py\nx\n```\n1. z"))) == "T\na l c\nx\nz"
    assert one(spark, text.strip_invisible(F.lit("a​b‮c\U000e0041d"))) == "abcd"
