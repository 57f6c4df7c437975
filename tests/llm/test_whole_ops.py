import pandas as pd

import corpus_pipeline as cp
from fusilade.llm import mixing, quality


def taken(rows, want):
    """Sizes of the rows (key, size) that the cut block gives."""
    f = mixing._fill(pd.DataFrame([(0, 0, float(want), k, n) for k, n in rows], columns=["__s", "__block", "want", "__key", "size"]), "size").iloc[0]
    spans = list(zip(f["lows"], f["limits"], f["gaps"], strict=True))
    return [n for k, n in rows if any(lo <= k <= hi and n <= gap for lo, hi, gap in spans)]


def test_cut_block_takes_rows_behind_one_that_is_too_long():
    assert taken([(-9, 1000), (1, 30), (2, 50), (3, 40), (4, 15)], 100) == [30, 50, 15]
    rows = [(2 * i + j, n) for i in range(12) for j, n in enumerate((1, 100 - i))]
    assert sum(taken(rows, 100)) == 12 and taken([(1, 60), (1, 60), (2, 5)], 100) == [5]


def test_documents_of_many_lines_teach(spark):
    good, bad = "\n".join(["A plain line of words."] * 450), "\n".join(["$$$ ### !!! ||| 000"] * 450)
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(8)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    assert "w" in model
    assert {r.doc_id: r.predicted for r in quality.score(docs, model).collect()} == {i: i % 2 for i in range(8)}


def test_texts_that_share_an_id_are_kept_apart(spark):
    words = [f"w{i}" for i in range(100)]
    a, near, b, c = " ".join(words), " ".join([*words[:99], "x"]), " ".join(words[::-1]), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a, "en", "s", 1), (2, near, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "z", 2), (3, c, "en", "a", 2), (3, a, "en", "s", 1), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text, r.source) for r in cp.jaccard_stage(spark, docs, "").collect()}
    assert got == {(1, a, "s"), (2, b, "s"), (3, c, "a"), (3, None, "s")}
