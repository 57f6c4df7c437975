"""Cases that once went wrong: few labels, extreme vectors, forced clashes, shared folders."""

import random

import numpy as np
import pytest

from fusilade.llm import common, covertree, jaccard, toxicity


@pytest.mark.parametrize("n", [0, 1, 2, 4, 30])
def test_toxicity_with_few_labels(spark, n):
    docs = spark.createDataFrame([(i, f"you are number {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 40 and all(0 <= r.score <= 1 for r in got)
    if "constant" in model:
        assert model["constant"] == (sum(i % 2 for i in range(n)) / n if n else 0.0)


def test_sample_bounds_rows_of_shared_ids(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int")
    assert toxicity.sample_rows(docs, labels, "toxic", "doc_id", "text", 25).count() == 20
    assert toxicity.sample_rows(docs, labels, "toxic", "doc_id", "text", 5).count() == 0


@pytest.mark.parametrize("common_share", [0.001, 2.0])
def test_extreme_vectors(spark, monkeypatch, common_share):
    monkeypatch.setattr(covertree, "COMMON", common_share)  # 2: no vector is common
    rows = [(1, [1e-200, 0.0, 0.0]), (2, [1e200, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [0.0, 5e-324, 0.0]), (6, [0.0, 1.7e308, 1e307]), (7, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 7: (4, 1), 5: (1, 5), 6: (1, 5)}


@pytest.mark.parametrize("common_share", [0.001, 2.0])
def test_jaccard_with_clashing_names(spark, monkeypatch, common_share):
    """The first words of the names of sets that don't link agree: sizes and second words tell them apart."""
    base = [f"w{k}" for k in range(60)]
    names, clash = jaccard.classes, []
    for w in (base, base[::-1], [f"v{k}" for k in range(60)]):
        raw = np.frombuffer(" ".join(w).encode(), np.uint8)
        clash.append(names(*jaccard.shingles(raw, np.array([0, len(raw)])))[1][0])

    def clashing(h, counts):
        c1, c2 = names(h, counts)
        return np.where(np.isin(c2, clash), 7, c1), c2

    monkeypatch.setattr(jaccard, "classes", clashing)
    monkeypatch.setattr(jaccard, "COMMON", common_share)
    rows = [(1, base), (2, base), (3, [*base[:-1], "x"]), (4, base[::-1]), (5, [f"v{k}" for k in range(60)]), (6, base[:40]), (5, base[:-1])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [(1, 57, 1), (2, 57, 1), (3, 57, 1), (4, 57, 4), (5, 56, 1), (5, 57, 5), (6, 37, 6)]


def test_texts_of_one_id_stay_apart_in_the_join(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(5, a), (5, b), (6, a[:-1]), (7, b[:-1])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect())
    assert got == [(5, 57, 5), (5, 57, 5), (6, 56, 5), (7, 56, 5)]


@pytest.mark.parametrize("same", [True, False])
def test_tree_join_loses_no_component(same):
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (40, 200, 3)]
    sets = []
    for i in range(300):
        s = base[i % 3].copy()
        s[rng.integers(0, len(s), rng.integers(0, max(1, len(s) // 8)))] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
        sets.append(np.unique(s))
    left, right = (sets, sets) if same else (sets[:120], sets[120:])
    tally: dict[str, int] = {}
    a = jaccard.Tree(left)
    edges = jaccard.tree_join(a, a if same else jaccard.Tree(right), same, 85, tally)
    assert all(jaccard.linked(left[i], right[j], 85) for i, j in edges)
    assert tally["pairs"] >= tally["nodes"] >= tally["bounds"] >= tally["verified"] >= len(edges)
    shift = 0 if same else len(left)
    found, want = common.Union(shift + len(right)), common.Union(shift + len(right))
    for i, j in edges:
        found.join(i, j + shift)
    for i, s in enumerate(left):
        for j, t in enumerate(right):
            if jaccard.linked(s, t, 85) and not (same and i == j):
                want.join(i, j + shift)
    assert [found.find(i) for i in range(shift + len(right))] == [want.find(i) for i in range(shift + len(right))]


def test_a_word_that_thousands_of_sets_share(spark):
    rng = random.Random(3)
    rows = [(i, f"one very common phrase {' '.join(f'{rng.randrange(10**9)}' for _ in range(3))}") for i in range(3000)] + [(5000, "one very common phrase")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 3001


def test_shared_folder(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
