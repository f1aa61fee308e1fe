"""The pipeline's stages, each on its own input, and the registered queries with SQL."""

import duckdb
import pytest

import corpus_pipeline as cp
from sequora.llm import minhash_dedup, mixing, pii, queries, quality
from sequora.llm.runtime import materialise

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = db.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(tuple(map(plain, r))) for r in cur.fetchall())
    assert sorted(names) == sorted(df.columns) and sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect()) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    now = docs
    for name, stage in cp.STAGES:
        now = got[name] = materialise(stage(spark, now, SF), spark)
    assert [n for n, _ in cp.STAGES] == list(got) and all(got[n].columns == docs.columns for n in list(got)[:-1])
    good, distinct, clean, mix, packed = got.values()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), spark)
    assert ids(good) == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert ids(distinct) == {r.doc_id for r in minhash_dedup.near_duplicates(good, spark).where("kept").collect()} and distinct.count() == len(ids(distinct))
    assert ids(clean) == ids(distinct) and not any(pii.base_spans(r.text or "") for r in clean.collect())
    taken = {r.doc_id for r in mixing.mix(clean).where("taken > 0").collect()}
    assert ids(mix) == taken and ids(packed) == taken
    assert sorted(map(repr, cp.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(repr, packed.drop("sequence_id", "offset").collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
