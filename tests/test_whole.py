from fusilade.plans import queries as P
from fusilade.sources import store as S

SF = "/root/testdata/sf0.001"


def test_sparse_vectors_keep_256_terms(spark):
    got = {r.chunk_id: r.terms for r in P.QUERIES["sparse_prune_256"](spark, SF).collect()}
    pruned = {r.chunk_id: r.terms for r in P.QUERIES["sparse_prune"](spark, SF).collect()}
    assert max(pruned.values()) == 64 and max(got.values()) == 256
    assert all(got[k] == n for k, n in pruned.items() if n < 64) and any(64 < n < 256 for n in got.values())


def test_sparse_match_on_a_term_beyond_64(spark, tmp_path):
    sf, common = str(tmp_path), " ".join(f"w{i} w{i}" for i in range(100))
    docs = [(1, f"{common} rare", "en", "a"), (2, "other text", "en", "a"), (3, "more rare text", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "rare")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    assert {r.chunk_id for r in P.QUERIES["sparse_leg"](spark, sf).collect()} == {3}
    assert {r.chunk_id for r in P.QUERIES["sparse_leg_256"](spark, sf).collect()} == {1, 3}


def test_html_keeps_text_in_and_after_inline_tags(spark):
    html = "<h4>Head</h4><ul><li><a href=x>link</a></li></ul><p><b>bold</b> and<br/>after <i>it</i>, 1 < 2<!-- <p>no --><div>box<p>in</div>out<footer>foot</footer><p clas"
    got = S.html_lines(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("line_no").collect()
    body = ["link", "bold and", "after it, 1 < 2", "box", "in", "out", "foot"]
    assert [(r.line, r["size"]) for r in got] == [("Head", 13.0), *((x, 10.0) for x in body)]
