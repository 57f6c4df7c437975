import pytest

from fusilade.sources import store as S
from fusilade.streaming.ingest import ingest


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"q": "a"}\n\n{"q": "b"}\n')
    assert sorted(r.q for r in S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "q string").collect()) == ["a", "b"]


def test_upsert_and_replace(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(tuple(r) for r in S.upsert(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "chunks")
    rows = lambda d, *t: spark.createDataFrame([(d, x) for x in t], "document_id int, content string")
    S.replace_chunks(spark, rows(1, "x").unionByName(rows(2, "y", "z")), path)
    S.replace_chunks(spark, rows(2, "w"), path)
    assert sorted((r.document_id, r.content) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "w")]


def test_cache_runs_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert S.cached(spark, str(tmp_path / "stage"), make).count() == 3
    assert len(calls) == 1


def test_strict_zip(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(1, 0.5)], "i int, v double")
    with pytest.raises(Exception, match="differ in length"):
        S.zip_strict(a, b, ["i"]).collect()


def test_html_lines(spark):
    html = "<title>T</title><script>x='<p>no</p>'</script><h1 class=a>Head</h1><p>one<p>two </p>"
    got = S.html_lines(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("line_no").collect()
    assert [(r.line, r["size"]) for r in got] == [("T", 20.0), ("Head", 18.0), ("one", 10.0), ("two", 10.0)]


def test_stream_replaces_documents(spark, tmp_path):
    schema = "document_id int, content string"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b")], [(2, "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        ingest(spark.readStream.schema(schema).json(source), lambda d: d, sink, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.document_id, r.content) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, "c")]
