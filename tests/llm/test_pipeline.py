import importlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    cp = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(cp.STAGES) - 1:
            assert set(docs.columns) == set(cp.COLUMNS)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 0
    assert docs.where("n_tokens <> size(token_ids)").count() == 0
    assert cp.run(spark, SF).count() == docs.count()


def test_stages_on_awkward_rows(spark):
    cp = importlib.import_module("corpus_pipeline")
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here twice over", "en", "a", 26), (3, "same words here twice over", "en", "a", 26), (None, "no id", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()
    assert cp.jaccard_stage(spark, docs, SF).where("doc_id = 3").count() == 1


@pytest.mark.parametrize("name", ["op4_embeddings", "op5_jaccard"])
def test_sql(spark, name):
    from fusilade.llm import queries as Q

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), c.sql(Q.ORACLES[name]).df()
    columns = sorted(want.columns)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert got.equals(want)
