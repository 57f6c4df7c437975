import pytest

from fusilade import api
from fusilade.operators import lines as L
from fusilade.operators import structure as ST


def test_sign_sections(spark):
    lines = [("16 • Sun Signs", 10.0), ("Preamble of some length to set the body size", 10.0), ("TAURUS", 18.0), ("about the sign", 10.0), ("DEPENDABILITY", 14.0), ("steady people", 10.0),
             ("MERCURY IN ARIES This is quick.", 10.0), ("More of it.", 10.0), ("Venus in Gemini", 14.0), ("light", 10.0), ("Aries Ascendant", 14.0), ("first", 10.0), ("MARS IN LEO", 10.0), ("brave", 10.0)]
    df = spark.createDataFrame([(1, i, line, size) for i, (line, size) in enumerate(lines)], "doc int, i int, line string, size double")
    got = [(r["line"], r["head"], r["meta"] and (r["meta"]["indicator_type"], r["meta"]["sign"])) for r in L.sign_sections(df, ["doc"], ["i"]).orderBy("i").collect()]
    assert got == [
        ("Preamble of some length to set the body size", None, None),
        ("about the sign", "TAURUS", ("sign_chapter", "taurus")),
        ("steady people", "Taurus › DEPENDABILITY", ("sign_section", "taurus")),
        ("This is quick.", "Mercury in Aries", ("planet_in_sign", "aries")),
        ("More of it.", "Mercury in Aries", ("planet_in_sign", "aries")),
        ("light", "Venus in Gemini", ("planet_in_sign", "gemini")),
        ("first", "Aries Ascendant", ("ascendant", "aries")),
        ("brave", "Mars in Leo", ("planet_in_sign", "leo")),
    ]


def test_scan_finds_heading_lines(spark):
    rows = [(1, i, x) for i, x in enumerate(["Sun Conjunct Moon", "Sun Conjunct Moonlight", "Mars Opposition Venus and more", "sun conjunct moon", "words"])]
    got = ST.heading_scan(spark.createDataFrame(rows, "doc int, i int, line string"), ["doc"], ["i"]).collect()
    assert [(r["n"], r["samples"]) for r in got] == [(2, ["Sun Conjunct Moon", "Mars Opposition Venus and more"])]


def test_last_section_is_not_measured(spark):
    rows = [(1, i, x) for i, x in enumerate(["before", "HEAD", "a b", "c", "HEAD", "d"])]
    df = spark.createDataFrame(rows, "doc int, i int, line string")
    assert [(r["section_no"], r["n_tokens"]) for r in ST.section_sizes(df, ["doc"], ["i"], df["line"] == "HEAD").collect()] == [(1, 4)]


@pytest.fixture(scope="module")
def search(spark):
    c = spark.createDataFrame([(1, 1, "Venus", "Venus in love and art", 3, 3), (2, 1, "Mars", "Mars drives and fights", 4, 5), (3, 2, "Moon", "moods of the night", 1, 1)], "chunk_id long, document_id long, head string, content string, page_start int, page_end int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (9, [1.0, 0.0])], "chunk_id long, vec array<double>")
    d = spark.createDataFrame([(1, "Book", "Author"), (2, "Other", None)], "document_id long, title string, author string")
    return api.HybridSearch(c, v, d)


def test_retrieve_inspect_and_answer(spark, search):
    asked = spark.createDataFrame([(1, "What does Venus mean?", [1.0, 0.0]), (2, "zzz", None)], "query_id long, question string, query_vec array<double>")
    found = search.retrieve(asked, top_n=1)
    assert [tuple(r) for r in api.sources(found).collect()] == [(1, 1, "Book (Author), p.3", 1, round(2.7 / 51, 4))]
    seen = {(r["chunk_id"], r["selected"]) for r in search.inspect(asked, top_k=5, top_n=1).collect()}
    assert seen == {(1, True), (2, False)}
    replies = api.answers(api.prompts(asked, found), lambda ps: [p.upper()[:30] for p in ps])
    assert {tuple(r) for r in replies.collect()} == {(1, "QUESTION: WHAT DOES VENUS MEAN"), (2, api.NOTHING_FOUND)}


def test_zero_results_and_floor(spark, search):
    asked = spark.createDataFrame([(1, "Venus", [1.0, 0.0])], "query_id long, question string, query_vec array<double>")
    assert search.retrieve(asked, top_n=0).count() == 0
    high = api.HybridSearch(search.chunks, search.vectors, search.documents, api.Settings(floor=1.0))
    assert high.retrieve(asked).count() == 0
