"""Every query with SQL against DuckDB, and under other partitionings."""

import duckdb
import pytest

import __spark_entry__ as entry
from sequora.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cur = db.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in cur.fetchall())
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", ["user_sequences", "history_dropout", "ad_anchor_weights", "inbatch_negatives", "split_users", "build_vocab_large"])
def test_partitioning_changes_nothing(spark, name):
    def rows():
        return sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == rows()
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_embedding_text(spark):
    row = registry.QUERIES["embedding_text"](spark, SF).orderBy("id").first()
    vector = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").first()["embedding"]
    assert row["text"] == " ".join("%.6g" % x for x in vector)
