"""Ingest of the domain's own headings, encoders, filters, gold and routing on small tables."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fusilade import api
from fusilade.operators import encode as EC
from fusilade.operators import evaluation as E
from fusilade.operators import lines as L
from fusilade.operators import retrieval as H
from fusilade.plans import ingest as IN
from fusilade.sources import store as S

PROSE = "the {} brings slow change to the daily work of many people and asks for patience with north node and Venus in all plans"


def books(spark, *rows):
    return IN.registry(spark, [(s, s.title(), None, k, 450, 60) for s, k in rows])


def test_transit_sections(spark):
    page = "\n".join(["opening words " + PROSE.format("sun"), "Sun Conjunct Moon", PROSE.format("moon"), "7", "Saturn in the Seventh House", PROSE.format("saturn"), "Mars Square Ascendant", "Sun Moon Mars"])
    pages = spark.createDataFrame([("hand", 1, page), ("gone", 1, page)], "slug string, page int, text string")
    got = IN.chunk_sources(pages, books(spark, ("hand", "transit_sections"))).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section, r.indicator_type, r.context) for r in got] == [(0, None, None, "transit"), (1, "Sun Conjunct Moon", "transit_aspect", "transit"), (2, "Saturn in the Seventh House", "house_ingress", "transit")]
    assert got[1].content.startswith("Sun Conjunct Moon\n\nthe moon") and got[2].house == 7 and got[2].transiting == "saturn"
    assert got[1].planets == ["moon", "north node", "sun", "venus"] and got[1].aspects == ["conjunct"] and got[1].signs is None


def test_strategies_go_together(spark):
    toc = "(The House of Life; 1)\n(On Planets and Rulers; 3)"  # a section begins a page before its title
    rows = [("libra", 12, toc), ("libra", 17, "The House of Life\n" + PROSE.format("first")), ("libra", 18, PROSE.format("second")), ("libra", 19, "On Planets and Rulers\n" + PROSE.format("third"))]
    rows += [("plain", 1, PROSE.format("fourth")), ("plain", 2, "Sun Moon Mars")]
    pages = spark.createDataFrame(rows, "slug string, page int, text string")
    sized = [("font", 1, i, t, z) for i, (t, z) in enumerate([("Taurus", 20.0), (PROSE.format("bull"), 10.0), ("Dependability", 14.0), (PROSE.format("calf"), 10.0), ("VENUS IN GEMINI " + PROSE.format("air"), 10.0)])]
    layout = spark.createDataFrame(sized, "slug string, page int, line_no int, line string, size double")
    pages = pages.unionByName(spark.createDataFrame([("font", 1, "")], pages.schema))
    got = IN.chunk_sources(pages, books(spark, ("libra", "toc_sections"), ("plain", "token_windows"), ("font", "font_sections")), layout).orderBy("slug", "chunk_index").collect()
    named = [(r.slug, r.chunk_index, r.section, r.indicator_type, r.page_start, r.page_end) for r in got]
    assert named == [
        ("font", 0, "Taurus", "sign_chapter", 1, 1), ("font", 1, "Dependability", "sign_section", 1, 1), ("font", 2, "Venus in Gemini", "planet_in_sign", 1, 1),
        ("libra", 0, "The House of Life", "house_meaning", 17, 17), ("libra", 1, "On Planets and Rulers", "planet_meaning", 18, 19), ("plain", 0, None, None, 1, 2),
    ]
    assert got[1].content.startswith("Taurus › Dependability")
    with pytest.raises(Exception, match="no strategy"):
        IN.chunk_sources(pages, books(spark, ("plain", "unheard_of"))).collect()
    with pytest.raises(ValueError, match="slug"):
        books(spark, ("a", "token_windows"), ("a", "token_windows"))


def test_page_parser(spark):
    rows = [("b", p, f"Running Head\nfirst line of {p}\nand its rest\n\nsecond part-\ntime\nlast of {p}\n{p}") for p in range(1, 6)] + [("b", 6, "Running Head\n6")]
    pages = spark.createDataFrame(rows, "slug string, page int, text string")
    got = {r.page: r.paragraphs for r in IN.page_paragraphs(pages).collect()}
    assert got == {p: [f"first line of {p} and its rest", f"second parttime last of {p}"] for p in range(1, 6)}
    assert L.page_range(pages, "slug", 5, 6).first().text.endswith("\nRunning Head\n6")


def test_binary_pages_and_connection(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"other")
    got = S.read_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\f"), "*.bin").orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(1, "one"), (2, "two")]
    with pytest.raises(ValueError, match="address"):
        S.connect(None, "chunks")
    S.write_csv(spark.createDataFrame([(1, "a,b")], "n int, t string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect() == [Row(n="1", t="a,b")]


def test_encoders(spark):
    df = spark.createDataFrame([(k, "ab" * k if k else None) for k in range(5)], "chunk_id long, text string")
    sizes = lambda: lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    got = {r.chunk_id: r.vec for r in EC.dense(df.coalesce(1), "chunk_id", "text", sizes, 2, batch=3).collect()}
    assert got == {0: None, 1: [2.0, 2.0], 2: [4.0, 2.0], 3: [6.0, 2.0], 4: [8.0, 2.0]}
    with pytest.raises(Exception, match="3 dimensions"):
        EC.dense(df, "chunk_id", "text", sizes, 3).collect()
    logits = lambda: lambda texts, most: [[("a", 1.0), ("a", 3.0), ("b", -1.0), ("c", 0.5)] for _ in texts]
    w = EC.sparse(df.where("chunk_id = 1"), "chunk_id", "text", logits, most=2)
    assert {r.term: round(r.w, 6) for r in w.collect()} == {"a": 1.386294, "c": 0.405465}
    assert {k: round(v, 6) for k, v in H.to_storage(w).first().sparse.items()} == {"a": 1.386294, "c": 0.405465}
    pooled = H.max_pool(spark.createDataFrame([(1, "x", None), (1, "y", 0.0)], "chunk_id long, term string, logit double")).collect()
    assert [(r.term, r.w) for r in pooled] == [("y", 0.0)]
    lit = spark.createDataFrame([([0.123456789, -1.0],), (None,)], "v array<float>").select(H.vector_literal("v").alias("s")).collect()
    assert [r.s for r in lit] == ["[0.12345679,-1.00000000]", None]


def test_dense_leg_of_mixed_lengths(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [])], "query_id long, query_vec array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.5, 0.5, 0.5]), (3, [2.0]), (4, None)], "chunk_id long, vec array<double>")
    assert {(r.query_id, r.chunk_id) for r in H.dense_leg(q, v, 5).collect()} == {(1, 1), (2, 2)}


def test_nested_filter(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('house', 7, 'planets', array('sun', 'moon')) AS meta, array('x', 'y') AS tags, 'en' AS lang UNION ALL SELECT 2, named_struct('house', 7, 'planets', array('sun')), array('x'), 'en' UNION ALL SELECT 3, NULL, NULL, NULL")
    ids = lambda wanted: sorted(r.id for r in H.metadata_filter(df, wanted).collect())
    assert ids({}) == [1, 2, 3] and ids({"lang": "en"}) == [1, 2]
    assert ids({"meta": {"house": 7, "planets": ["moon"]}}) == [1] and ids({"tags": ["x"], "meta": {"planets": ["sun"]}}) == [1, 2]
    assert ids({"tags": ["x", "y"]}) == [1] and ids({"meta": {}}) == [1, 2]


def test_holders_equal_contains(spark):
    texts = ["some words that hold a phrase of words", "phrase", "a phrases of word", "x-ray, beta. gamma-delta", "", None, "beta. gamma"]
    phrases = ["hold a phrase of words", "phrase", "a phrase", "beta. gamma", "ray, beta. gamma-del", "-", "ords that hold a phr"]
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")
    got = sorted((r.chunk_id, r.query_id) for r in E.holders(t, p, "chunk_id", "text", "query_id", "phrase").collect())
    assert got == sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(phrases) if a and b in a)


def test_gold_of_a_label_without_chunk(spark):
    labels = spark.createDataFrame([(1, "b", "s"), (2, "b", "none")], "query_id long, book string, section string")
    c = spark.createDataFrame([(10, "b", "s"), (11, "b", "s")], "chunk_id long, book string, section string")
    assert {r.chunk_id for r in E.resolve_gold(labels.where("query_id = 1"), c, ["book", "section"]).collect()} == {10, 11}
    with pytest.raises(Exception, match="no gold for 2"):
        E.resolve_gold(labels, c, ["book", "section"]).collect()


def test_chunk_of_two_sections(spark):
    gold = spark.createDataFrame([(1, "a", 10), (1, "b", 10), (1, "b", 11)], "query_id long, section string, chunk_id long")
    ranking = spark.createDataFrame([("dense", 1, 10, 1), ("dense", 1, 99, 2)], "leg string, query_id long, chunk_id long, rank int")
    r = E.case_metrics(ranking, gold, ["dense"]).first()
    assert (r.recall_at_1, r.mrr) == (1.0, 1.0) and r.ndcg == pytest.approx(1 / (1 + 1 / 1.584962500721156))


def test_routing(spark):
    found = spark.createDataFrame([(1, 1, "A", "About Mars", 0.05), (1, 2, "B", "and Venus", 0.04), (3, 1, "A", "x", 0.03)], "query_id long, rank int, book string, content string, score double")
    cases = spark.createDataFrame([(1, True, "B", ["VENUS"]), (2, True, None, []), (3, False, None, None), (4, True, "A", ["x"])], "query_id long, in_scope boolean, book string, terms array<string>")
    got = E.routing(found, cases)
    assert {r.query_id: (r.book_first, r.book_any, r.term_hit, r.passed) for r in got.collect()} == {1: (False, True, True, True), 2: (False, False, True, True), 3: (False, False, True, True), 4: (False, False, False, False)}
    assert tuple(E.routing_summary(got).first()) == (4, 0.0, 50.0, 67.0, 100.0, 75.0)
    assert tuple(E.routing_summary(got.where("query_id = 3")).first())[1:4] == (None, None, None)


def test_interface(spark):
    legs = {n: spark.createDataFrame([(1, c, r, 1.0) for r, c in enumerate(ids, 1)], "query_id long, chunk_id long, rank int, score double") for n, ids in (("fts", [1, 2]), ("dense", [2, 3]), ("sparse", [2, 1]))}
    api.register_sql(spark, legs)
    want = [(r.chunk_id, r.score) for r in H.top(H.fuse(legs, H.WEIGHTS), 2).orderBy("rank").collect()]
    assert [(r.chunk_id, r.score) for r in spark.sql("SELECT * FROM hybrid_search(match_count => 2) ORDER BY rank").collect()] == want
    only = spark.sql("SELECT * FROM hybrid_search(fts_weight => 0, sparse_weight => 0)").collect()
    assert [r.chunk_id for r in only] == [2, 3]
    g = api.Gateway({"m": lambda asked, t, n: [["a", "", "b"] if "x" in q else f"{t} {n}" for q in asked]}, "m")
    assert g.generate(["x", "y"]) == ["ab", "0.2 1024"]
    with pytest.raises(KeyError):
        api.Gateway({}, "m").generate(["x"])
    plain, none = api.traced(legs["fts"], None)
    assert none is None and plain is legs["fts"]
    watched, seen = api.traced(legs["fts"], "fts")
    watched.collect()
    assert seen.get == {"rows": 2, "least": 1.0, "most": 1.0}
    found = spark.createDataFrame([(1, 1, "B, p.1", "text")], "query_id long, rank int, citation string, content string")
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, question string")
    replies = spark.createDataFrame([(1, "so"), (2, "none")], "query_id long, answer string")
    said = {r.query_id: tuple(r)[1:] for r in api.judge(found, asked, replies, lambda p: ["I say [1, 0.5, 0]" for _ in p]).collect()}
    assert said == {1: (1.0, 0.5, 0.0), 2: (None, None, None)}


def test_search_with_a_stored_term_table(spark):
    c = spark.createDataFrame([(k, k, "head", f"shared words and number{k} running", 1, 1) for k in range(5)], "chunk_id long, document_id long, head string, content string, page_start int, page_end int")
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "chunk_id long, vec array<double>")
    d = c.select("document_id", F.lit("T").alias("title"), F.lit(None).cast("string").alias("author"))
    q = spark.createDataFrame([(1, "number3 runs", [0.0, 1.0])], "query_id long, question string, query_vec array<double>")
    a = api.HybridSearch(c, v, d).retrieve(q, 3).select("rank", "chunk_id", "score").orderBy("rank").collect()
    b = api.HybridSearch(c, v, d, terms=H.postings(c)).retrieve(q, 3).select("rank", "chunk_id", "score").orderBy("rank").collect()
    assert a == b and a[0].chunk_id == 3
