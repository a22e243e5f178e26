"""Readers and writers on files of their own."""

import pytest
from pyspark.sql import functions as F

from lodestream.sources import readers, sinks


def test_transcript_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type":"custom"}\n\n{bad\n{"type":"message","message":{"role":"user","content":"a\\n\\n b"}}\n{"type":"message","message":{"role":"assistant","content":[{"type":"text","text":"x"},{"type":"image"},{"type":"text","text":" y "}]}}\n{"type":"message","message":{"role":"system","content":"z"}}\n{"type":"message","message":{"role":"user","content":[]}}')
    out = readers.transcript_lines(readers.lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r["line_no"], r["flat"]) for r in out] == [(4, "User: a b"), (5, "Assistant: x y")]


def test_markdown_files_and_fingerprints(spark, tmp_path):
    for name in ("MEMORY.md", "memory/a.md", "memory/b/c.md", "notes/x.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r["path"].split(str(tmp_path))[-1] for r in readers.markdown_files(spark, str(tmp_path)).collect()}
    assert found == {"/MEMORY.md", "/memory/a.md", "/memory/b/c.md"}
    assert readers.fingerprints(spark, str(tmp_path), glob="*.md").count() == 4


@pytest.mark.parametrize("cursor, body, reset", [(None, "line3\nline4", False), (7, "line3\nline4", False), (12, "line3\nline4", False), (1000, "line3\nline4", True), (0, "line3\nline4", True)])
def test_byte_cursor(spark, cursor, body, reset):
    row = spark.range(1).select(readers.byte_tail(F.lit("line1\nline2\nline3\nline4"), cursor, 16).alias("t")).select("t.*").first()
    assert (row["body"], row["reset"]) == (body, reset)


def test_file_slices(spark):
    get = lambda text, *a: spark.range(1).select(readers.file_slice(F.lit(text).cast("string"), *a)).first()[0]
    assert get("a\nb\nc", 2, 1) == "b" and get("a\nb\nc", 2) == "b\nc" and get("a", 9) == "" and get(None) == ""


def test_embedding_batches(spark):
    lines = ['{"custom_id":"a","response":{"status_code":200,"body":{"data":[{"embedding":[1.0]}]}}}', '{"custom_id":"b","error":{"message":"e"}}', '{"custom_id":"c","response":{"status_code":500,"body":{"error":{"message":"down"}}}}', '{"custom_id":"d","response":{"status_code":200,"body":{"data":[{"embedding":[]}]}}}', "{}"]
    out = {r["custom_id"]: (r["embedding"], r["error"]) for r in readers.batch_output(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert out == {"a": ([1.0], None), "b": (None, "e"), "c": (None, "down"), "d": (None, "empty embedding")}


def test_versions_survive_a_failed_write(spark, tmp_path):
    store = sinks.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        store.read()
    store.replace(spark.range(3))
    with pytest.raises(Exception, match="stopped"):
        store.replace(spark.range(1).select(F.raise_error(F.lit("stopped")).cast("long").alias("id")))
    assert store.read().count() == 3 and store.upsert(spark.range(2, 5), ["id"]) == 2 and store.read().count() == 5


def test_json_store_keeps_the_one_before(spark, tmp_path):
    store = sinks.JsonStore(spark, str(tmp_path / "s.json"))
    assert [store.write("1"), store.write("1"), store.write("2")] == [True, False, True] and store.read() == "2" and (tmp_path / "s.json.bak").read_text() == "1"


def test_rotation(spark, tmp_path):
    for i in range(5):
        (tmp_path / "s").write_text("xxxx")
        assert sinks.rotate(spark, str(tmp_path / "s"), 3, 3, str(i))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["s.bak.2", "s.bak.3", "s.bak.4"]


def test_rotation_keeps_the_largest_numbers(spark, tmp_path):
    for stamp in ("9", "10", "11", "8"):
        (tmp_path / "s").write_text("xxxx")
        assert sinks.rotate(spark, str(tmp_path / "s"), 3, 2, stamp)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["s.bak.10", "s.bak.11"]


def test_log_records(spark):
    lines = ['{"0":"a","1":{"x":1},"_meta":{"logLevelName":"WARN","date":"d","name":"{\\"subsystem\\":\\"s\\",\\"module\\":\\"m\\"}"}}', "nope", '{"time":"t","0":"b"}']
    out = [tuple(r) for r in readers.log_records(spark.createDataFrame([(x,) for x in lines], "line string")).drop("line").collect()]
    assert out == [("d", "warn", "s", "m", 'a {"x":1}'), ("t", None, None, None, "b")]
