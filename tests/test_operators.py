import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fusilade.operators import evaluation as E
from fusilade.operators import lines as L
from fusilade.operators import retrieval as H
from fusilade.operators import windows as W


def greedy(counts, target, overlap):
    """The packing written as a plain loop."""
    out, cur, used, i, new = [], [], 0, 0, False
    while i < len(counts):
        if new and used + counts[i] > target:
            out.append((cur[0], cur[-1]))
            keep, total = [], 0
            for j in reversed(cur):
                if total + counts[j] > overlap:
                    break
                keep.insert(0, j)
                total += counts[j]
            cur, used, new = keep, total, False
        cur.append(i)
        used += counts[i]
        new, i = True, i + 1
    if new:
        out.append((cur[0], cur[-1]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 80), st.integers(0, 30))
def test_windows_cover_lines_and_keep_the_overlap(counts, target, overlap):
    spans = W.bounds(np.array(counts), target, overlap)
    assert {i for s, e in spans for i in range(s, e + 1)} == set(range(len(counts)))
    ends = [e for _, e in spans]
    assert ends == sorted(set(ends))
    for (_, e), (s, e2) in zip(spans, spans[1:], strict=False):
        assert sum(counts[s : e + 1]) <= overlap
        assert sum(counts[s : e2 + 1]) <= target or e2 == e + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 80))
def test_windows_without_overlap_are_greedy(counts, target):
    assert W.bounds(np.array(counts), target, 0) == greedy(counts, target, 0)


def test_window_content(spark):
    rows = spark.createDataFrame([(1, 0, 4, "alpha beta", "HEAD"), (1, 1, 5, "gamma delta", "HEAD")], "doc int, i int, page int, line string, head string")
    w = W.token_windows(rows, ["doc"], "i", head="head", page="page", target=1000, overlap=0).collect()
    assert len(w) == 1 and w[0].content == "HEAD\n\nalpha beta gamma delta" and (w[0].page_start, w[0].page_end) == (4, 5)


def metrics(spark, ranking, sections, k=10):
    r = spark.createDataFrame([("l", 0, c, i + 1) for i, c in enumerate(ranking)] or [("l", 9, 0, 1)], "leg string, query_id int, chunk_id int, rank int")
    g = spark.createDataFrame([(0, f"s{i}", c) for i, s in enumerate(sections) for c in s], "query_id int, section string, chunk_id int")
    return E.case_metrics(r, g, ["l"], ks=(1, 2, 3), ndcg_k=k).first()


@pytest.mark.parametrize(("ranking", "sections", "k", "want"), [
    ([2, 9, 8], [{1, 2}, {7}], 10, {"recall_at_3": 0.5}),
    ([9, 1, 7], [{1, 2}, {7}], 10, {"recall_at_2": 0.5, "recall_at_3": 1.0}),
    ([9, 2, 7, 1], [{1, 2, 7}], 10, {"mrr": 0.5}),
    ([9, 9, 7], [{7}], 10, {"mrr": 1 / 3}),
    ([], [{7}], 10, {"mrr": 0.0, "ndcg": 0.0, "recall_at_3": 0.0}),
    ([1, 2, 7, 9], [{1, 2, 7}], 4, {"ndcg": 1.0}),
    ([8, 9, 7], [{7}], 3, {"ndcg": 0.5}),
    ([7, 8, 9], [{7}], 6, {"ndcg": 1.0}),
])
def test_metrics(spark, ranking, sections, k, want):
    got = metrics(spark, ranking, sections, k)
    for name, value in want.items():
        assert got[name] == pytest.approx(value)


def test_prune(spark):
    w = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([0, 5, 0, 3, 1])], "chunk_id int, term int, w double")
    assert {(r.term, r.w) for r in H.prune(w, 2).collect()} == {(1, 5.0), (3, 3.0)}
    assert H.prune(w, 10).count() == 3


def test_fusion_bounds_and_legs_alone(spark):
    leg = lambda ids: spark.createDataFrame([(0, c, i + 1, 1.0) for i, c in enumerate(ids)], "query_id int, chunk_id int, rank int, score double")
    legs = {"fts": leg([1, 2]), "dense": leg([1, 3]), "sparse": leg([1])}
    fused = H.fuse(legs, H.WEIGHTS)
    best = H.top(fused, 1).first()
    assert best.chunk_id == 1 and best.score == pytest.approx(2.7 / 51, abs=1e-9)
    alone = H.ablate(fused, 5).where("leg = 'dense'").orderBy("rank").collect()
    assert [r.chunk_id for r in alone] == [1, 3]


def test_metadata_filter_contains(spark):
    c = spark.createDataFrame([(1, "en", ["a", "b"]), (2, "en", ["a"]), (3, None, None)], "chunk_id int, lang string, tags array<string>")
    assert [r.chunk_id for r in H.metadata_filter(c, {"lang": "en", "tags": ["b"]}).collect()] == [1]
    assert H.metadata_filter(c, {}).count() == 3


def test_gold_is_required(spark):
    cases = spark.createDataFrame([(1,), (2,)], "query_id int")
    gold = spark.createDataFrame([(1, 5)], "query_id int, chunk_id long")
    with pytest.raises(Exception, match="no gold for 2"):
        E.require_gold(cases, gold).collect()


def test_toc(spark):
    d = spark.createDataFrame([(1, "(The Houses of  Heaven; 3) and (Planets And Their Rulers; 9) and (Other Title; 9)")], "doc int, text string")
    toc = L.toc_entries(d, "doc", "text")
    assert sorted((r.title, r.page) for r in toc.collect()) == [("Planets And Their Rulers", 9), ("The Houses of Heaven", 3)]
    pages = spark.createDataFrame([(1, 20, "THE HOUSES OF HEAVEN."), (1, 26, "planets and their rulers"), (1, 2, "the houses of heaven")], "doc int, page int, line string")
    assert L.toc_offset(toc, pages, "doc").first().offset == 17


def test_font_sections_and_running_lines(spark):
    rows = [(1, i, t, s) for i, (t, s) in enumerate([("Head One", 18.0), ("body", 10.0), ("more", 10.0), ("16 • Sun", 18.0), ("Head Two", 18.0), ("text", 10.0)])]
    s = L.font_sections(spark.createDataFrame(rows, "doc int, i int, line string, size double"), ["doc"], ["i"]).orderBy("i").collect()
    assert [(r.section_no, r.head) for r in s] == [(1, "Head One")] * 3 + [(2, "Head Two")] * 2
    pages = spark.createDataFrame([(1, p, f"The Title\nline {p}\n\nmore {p}\nlast {p}") for p in range(5)] + [(1, 5, None)], "doc int, page int, text string")
    assert [(r.line, r.n) for r in L.running_lines(pages, "doc", "page").collect()] == [("The Title", 5)]
    assert L.clean_lines(pages, "doc", "page").where(F.col("line") == "The Title").count() == 0


def dense_by_hand(queries, vectors, depth):
    out = []
    for q, a in queries:
        found = []
        for c, b in vectors:
            if a and b and None not in [*a, *b] and all(np.isfinite([*a, *b])) and any(a) and any(b):
                found.append((-round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 9) + 0.0, c))
        out += [(q, c, r, -s) for r, (s, c) in enumerate(sorted(found)[:depth], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "step"), [(4096, 1024), (3, 2)])
def test_dense_leg_equals_brute_force(spark, block, step):
    rng = np.random.default_rng(5)
    vectors = [(int(c), rng.normal(size=4).tolist()) for c in rng.permutation(40)]
    vectors += [(100 + k, [1.0, 2.0, 0.0, 1.0]) for k in range(9)]  # ties
    vectors += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 1.0])]
    queries = [(k, rng.normal(size=4).tolist()) for k in range(7)] + [(7, [1.0, 2.0, 0.0, 1.0]), (8, None), (9, [0.0] * 4)]
    q, v = spark.createDataFrame(queries, "query_id int, query_vec array<double>"), spark.createDataFrame(vectors, "chunk_id int, vec array<double>").repartition(3)
    got = H.dense_leg(q, v, 5, block, step)
    assert [f.dataType.simpleString() for f in got.schema[:2]] == ["int", "int"]
    got, want = sorted((r.query_id, r.chunk_id, r["rank"], r.score) for r in got.collect()), dense_by_hand(queries, vectors, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-9)


def test_dense_leg_without_rows(spark):
    q, v = spark.createDataFrame([(1, [1.0])], "query_id long, query_vec array<double>"), spark.createDataFrame([(1, [1.0])], "chunk_id long, vec array<double>")
    assert H.dense_leg(q.where("false"), v, 3).count() == 0
    assert H.dense_leg(q, v.where("false"), 3).count() == 0


def test_english_leg(spark):
    c = spark.createDataFrame([(1, "Houses", "Houses and the housing of planets"), (2, None, "one planet"), (3, "None", "of the and"), (4, "x", None)], "chunk_id long, head string, content string")
    q = spark.createDataFrame([(1, "the planets housed"), (2, "of the")], "query_id long, question string")
    got = H.fts_leg(q, H.postings(c, english=True), 5, english=True).collect()
    # hous: 1 x heading, 2 x body; planet: 1 x body
    assert sorted((r.query_id, r.chunk_id, r["rank"], r.score) for r in got) == [(1, 1, 1, 1.3), (1, 2, 2, 0.1)]
    assert H.fts_leg(q, H.postings(c.where("false"), english=True), 5, english=True).count() == 0
