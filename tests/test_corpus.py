import numpy as np
import pyarrow as pa
import pytest

from fusilade.functions import text as X
from fusilade.operators import corpus as C
from fusilade.operators import evaluation as E
from fusilade.operators import retrieval as H
from pyspark.sql import functions as F

DOCS = [
    (1, "Red fox", "Red fox\nthe red fox and the dog's bone"), (2, None, None), (3, "", ""), (4, "fox", "fox fox FOX stubborn zebra"),
    (5, "dup", "dup red"), (5, "dup2", "dup2 fox, red"), (6, "x", "aKb Kelvin İstanbul ñandú fox"), (7, "red", "red red red dog's running runs"),
]
ASKED = [(1, "What is the red fox?"), (2, "running dog's zebra kelvin akb"), (3, "stubborn i stanbul"), (4, "nothing here")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, head string, content string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, question string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded(chunks):
    """The term table by exploding and grouping all tokens."""
    one = lambda c, h, b: F.transform(X.tokens(c), lambda t: F.struct(t.alias("lexeme"), F.lit(h).alias("h"), F.lit(b).alias("b")))
    rows = chunks.select("chunk_id", F.explode(F.concat(one("head", 1, 0), one("content", 0, 1))).alias("t")).select("chunk_id", "t.*")
    return rows.groupBy("chunk_id", "lexeme").agg(F.sum("h").alias("tf_head"), F.sum("b").alias("tf_body"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_term_table_holds_no_tokens_of_other_texts(spark, chunks):
    got = H.postings(chunks)
    assert "Generate" not in plan(got) and "Aggregate keys: [chunk_id" not in plan(got) and "lexeme" not in plan(got).split("MapInArrow")[1].split("\n", 1)[1]
    assert rows(got, "chunk_id", "lexeme", "tf_head", "tf_body") == rows(exploded(chunks), "chunk_id", "lexeme", "tf_head", "tf_body")


@pytest.mark.parametrize("english", [False, True])
def test_legs_over_texts_equal_legs_over_the_term_table(spark, chunks, asked, english):
    table, columns = exploded(chunks), ("query_id", "chunk_id", "rank", "score")
    posts = H.english_postings(table) if english else table
    tf = H.body_terms(table)
    idf = H.idf(tf, chunks)
    for depth, most in ((1, 2), (2, 3), (10, 256)):
        mine = H.sparse_vectors(H.term_counts(asked, X.focus_query("question"), "query_id"), idf, "query_id", most)
        want = {"fts": H.fts_leg(asked, posts, depth, english), "sparse": H.sparse_leg(mine, H.sparse_vectors(tf, idf, "chunk_id", most), depth)}
        got = H.text_legs(asked, chunks, depth, most=most, english=english)
        assert "Generate" not in plan(got)
        for name, leg in want.items():
            assert rows(got.where(F.col("leg") == name), *columns) == rows(leg, *columns)
            assert rows(H.text_legs(asked, chunks, depth, (name,), most, english), *columns) == rows(leg, *columns)


def test_legs_with_a_vocabulary_too_large_and_without_rows(spark, chunks, asked):
    columns = ("leg", "query_id", "chunk_id", "rank", "score")
    assert rows(H.text_legs(asked, chunks, 5, vocabulary=1), *columns) == rows(H.text_legs(asked, chunks, 5), *columns)
    assert H.text_legs(asked.where("false"), chunks, 5).count() == 0 and H.text_legs(asked, chunks.where("false"), 5).count() == 0


def test_a_null_chunk_id_is_one_chunk(spark, asked):
    c = spark.createDataFrame([(None, "red", "red fox"), (None, "a", "red"), (1, "b", "fox red red")], "chunk_id long, head string, content string")
    got = H.text_legs(asked, c, 5, ("fts",)).where("query_id = 1").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(None, 1.3), (1, 0.3)]


def test_best_rows_are_the_same_however_a_task_gives_them_out(monkeypatch):
    r = np.random.default_rng(5)
    query, chunk, score = r.integers(0, 40, 5000), r.permutation(5000), r.integers(0, 30, 5000) / 7

    def first(parts, depth=3):
        q, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.lexsort((c, -s, q))
        return [(int(a), int(b)) for k in range(40) for a, b in zip(q[o][q[o] == k][:depth], c[o][q[o] == k][:depth], strict=True)]

    def run():
        best = C.Best(40, 3, 9)
        out = [got for k in range(0, 5000, 100) for got in best.add(query[k : k + 100], chunk[k : k + 100], score[k : k + 100])]
        return out + list(best.rows())

    whole = run()
    monkeypatch.setattr(C, "HELD", 100)
    assert len(whole) == 1 and sum(len(x[0]) for x in whole) == 120
    assert first(whole) == first([(query, chunk, score)]) == first(run())


def test_pairs_are_scored_in_parts_of_whole_rows(monkeypatch):
    asked = C.Asked(np.array([0, 1, 2, 0]), pa.array(["a", "a", "a", "b"]), np.array([1.0, 2.0, 3.0, 10.0]))
    row, place, value = np.array([0, 0, 1, 3, 3]), np.array([0, 1, 0, 0, 1]), np.array([1, 1, 2, 1, 3])
    want = {(0, 0): 11.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 2.0, (1, 1): 4.0, (1, 2): 6.0, (3, 0): 31.0, (3, 1): 2.0, (3, 2): 3.0}
    for most in (1, 4, 5, 1 << 21):
        monkeypatch.setattr(C, "MOST_PAIRS", most)
        assert {(int(a), int(b)): float(s) for r, q, v in C.scored(row, place, [value], asked, 3) for a, b, s in zip(r, q, v, strict=True)} == want


def test_holders_read_a_text_once(spark):
    texts = [(1, "one two three four five"), (2, "xone two three four fivex"), (3, "a b"), (4, None), (5, ""), (5, "zz one two"), (6, "One two three four five"), (7, "…")]
    said = [(1, "one two three four five"), (2, "two three"), (3, "b"), (4, ""), (5, None), (6, "…"), (7, "ne two three fou"), (8, "e two three four fiv"), (9, "wo three fo"), (10, "one two")]
    t, p = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(said, "p long, s string")
    got = E.holders(t, p, "k", "t", "p", "s", keep=("t",))
    assert "Generate" not in plan(got) and "Join" not in plan(got)
    want = sorted((k, q, x) for k, x in texts for q, s in said if x is not None and s is not None and s in x)
    assert rows(got, "k", "p", "t") == want


def test_hashes_of_terms_do_not_depend_on_what_stands_beside_them(monkeypatch):
    terms = pa.array([f"{a}{b}" for a in ("", "a", "b'", "zz") for b in range(500)] + ["", "a" * 300])
    whole = C.term_hash(terms)
    assert len(set(whole.tolist())) == len(terms)
    monkeypatch.setattr(C, "HASHED", 7)
    assert np.array_equal(C.term_hash(terms), whole) and C.term_hash(terms.slice(3, 1))[0] == whole[3]
