"""The vector operators against brute force, odd rows and recall."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sequora.llm import embedding_dedup, nearest
from sequora.llm.embedding_dedup import spherical_kmeans
from sequora.llm.runtime import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, e string, rep long, q boolean"


def vectors():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 16))
    for i in range(0, 100, 2):
        x[i + 1] = x[i] + rng.standard_normal(16) * rng.choice([0.01, 0.05, 0.1, 0.3])
    x[200:240] = x[200] + rng.standard_normal((40, 16)) * 0.08
    x[250:260] = x[250]
    return x.astype(np.float32)


def odd_rows(x):
    rows = [(i, [float(a) for a in v], 1, "e", 1, True) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5, [-0.0] * 16]
    rows += [(1000 + i, v, None, None, None, None) for i, v in enumerate(odd)]
    return [*rows, (None, [1.0] * 16, 1, "e", 1, True), rows[250], rows[3]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(odd_rows(vectors()), SCHEMA)


def brute_links(x, threshold=0.95):
    x = x.astype(float)
    size = np.linalg.norm(x, axis=1)
    s = x @ x.T / (size[:, None] * size) >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(s, label[None], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    return s.sum(1), label


@pytest.mark.parametrize("cells", [300, 20])
def test_near_duplicate_vectors(spark, table, cells):
    """With the reach that can miss no pair, in one cell and in many."""
    x = vectors()
    links, label = brute_links(x)
    got = embedding_dedup.near_duplicates(table, spark, per_cell=cells, reach=(2 - 2 * 0.95) ** 0.5).collect()
    assert len(got) == table.count()
    for r in got:
        if r.vec_id is None or r.vec_id >= 1000:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], label[r.vec_id], label[r.vec_id] == r.vec_id)


def test_blocks_of_a_cell(spark, table, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOME_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "ALL_ROWS", 70)
    links, label = brute_links(vectors())
    got = embedding_dedup.near_duplicates(table, spark, per_cell=100, reach=0.4).where("vec_id < 1000").collect()
    assert all((r.n_links, r.component_id) == (links[r.vec_id], label[r.vec_id]) for r in got)


def test_many_cells_in_a_block_and_parts(spark, table, monkeypatch):
    """Cells share blocks, rows visit several cells of a block, blocks have parts: each pair counts once."""
    monkeypatch.setattr(embedding_dedup, "ALL_ROWS", 100_000)
    links, label = brute_links(vectors())
    got = embedding_dedup.near_duplicates(table, spark, per_cell=10).where("vec_id < 1000").collect()
    assert all((r.n_links, r.component_id) == (links[r.vec_id], label[r.vec_id]) for r in got)


def test_batches_that_leave_a_worker_are_bounded(monkeypatch):
    """However many cells a row visits: before, a batch came out once for each of them, all in one batch."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((10_000, 64)).astype(np.float32)
    centroids = spherical_kmeans(x[:3000] / np.linalg.norm(x[:3000], axis=1)[:, None].astype(float), 200, rounds=2)
    ids = pa.array(np.arange(len(x)))
    hashes = pa.array(rng.integers(-(1 << 62), 1 << 62, len(x)))
    batch = pa.RecordBatch.from_arrays([hashes, hashes, ids, ids, pa.array([v.tobytes() for v in x])], ["h1", "h2", "rep", "copies", "e"])
    near = embedding_dedup._assign(iter([batch]), centroids, 0.3162, np.float32)
    near = pa.Table.from_batches(near).combine_chunks().to_batches()
    assert len(near) == 1 and near[0].nbytes < 2 * batch.nbytes
    home = np.bincount(near[0].column("home").to_numpy(), minlength=200)
    first, number = embedding_dedup.blocks_of_cells(centroids, home, 500)
    n = int((first + number).max())
    held = np.bincount(first[home > 0], weights=home[home > 0], minlength=n)
    assert held.sum() == len(x) and (number[home > 0] == 1).all() and held.max() <= 500
    out = list(embedding_dedup._deal(iter(near), first, number, np.full(n, 3)))
    assert max(b.nbytes for b in out) < 1.1 * embedding_dedup.OUT_BYTES
    rows = pa.Table.from_batches(out)
    assert rows.num_rows == len({(p, v, i) for p, v, i in zip(*(rows[c].to_pylist() for c in ("place", "visitor", "rep")), strict=True)})
    assert 3 * len(x) + len(x) < rows.num_rows <= 3 * len(x) + n * len(x)


def test_recall_of_links_at_the_default_reach(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.standard_normal((3000, 64)) * 0.32 / 8  # cosines about the threshold
    both = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    want = brute_links(both)[0].sum()
    got = embedding_dedup.near_duplicates(df, spark, per_cell=300).agg(F.sum("n_links")).first()[0]
    assert 0.97 * want <= got <= want


def test_no_link_is_missed_by_default(spark, monkeypatch):
    """The registered parameters, several cells, few dimensions: many linked rows lie deep on one side of a boundary."""
    fitted = []
    monkeypatch.setattr(embedding_dedup, "spherical_kmeans", lambda x, k: fitted.append(k) or spherical_kmeans(x, k))
    x = np.random.default_rng(12).standard_normal((9000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    links, label = np.zeros(len(x), int), np.arange(len(x))
    pairs = []
    for i in range(0, len(x), 1000):
        s = (x[i : i + 1000] @ x.T) >= 0.95
        s[np.arange(1000), np.arange(i, i + 1000)] = False
        links[i : i + 1000] = s.sum(1)
        pairs.append(np.argwhere(s) + [i, 0])
    a, b = np.concatenate(pairs).T
    while (label[a] != label[b]).any():
        np.minimum.at(label, a, label[b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(embedding_dedup.near_duplicates(df, spark).collect())
    assert fitted == [4] and links.sum() > 2000
    assert [r.n_links for r in got] == links.tolist()
    assert [r.component_id for r in got] == label.tolist()


def brute_nearest(x, q, k):
    s = (x * x[q]).sum(1)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k]


def test_nearest(spark, table):
    x = vectors().astype(float)
    got = nearest.search(table, spark, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    hits = 0
    for q in range(0, 300, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(r.score == pytest.approx(float(x[q] @ x[r.vec_id]), abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(brute_nearest(x, q, 20).tolist()))
    assert hits >= 0.95 * 300


def test_recall_of_each_query(spark):
    """The registered query on the largest test table: mean recall and that of the worst query."""
    from sequora.llm.queries import op4_nearest_products

    d = "/root/testdata/sf0.1"
    rows = sorted(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in op4_nearest_products(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in ids[ids % 20 == 0].tolist():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        recall.append(len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.97 and min(recall) >= 0.85, (np.mean(recall), min(recall))


def test_nearest_recall_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32)) * rng.uniform(0.5, 2, (6000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, spark, F.col("vec_id") % 100 == 0, block_rows=1500, chunk_rows=25).collect()
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & set(brute_nearest(x, q, 20).tolist())) for q in range(0, 6000, 100))
    assert hits >= 0.9 * 20 * 60


def test_nearest_beside_one_long_row(spark):
    """One row three times as long as the rest takes nothing from the recall among the rest."""
    rng = np.random.default_rng(15)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, spark, F.col("vec_id") % 200 == 0).collect()
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & set(brute_nearest(x, q, 20).tolist())) for q in range(0, 20_000, 200))
    assert hits >= 0.97 * 20 * 100


def test_nearest_of_equal_lengths(spark):
    """One range of lengths holds all rows; it is dealt to several blocks."""
    x = np.random.default_rng(16).choice([-1.0, 1.0], (3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, spark, F.col("vec_id") % 100 == 0, block_rows=700).collect()
    assert len(got) == 30 * 20
    hits = 0
    for q in range(0, 3000, 100):
        want = (x[brute_nearest(x, q, 20)] @ x[q]).min()
        hits += sum(r.score >= want for r in got if r.query_id == q)
    assert hits >= 0.97 * 30 * 20


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = nearest.search(df, spark, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 2, 1]
    assert nearest.search(df.limit(1), spark, F.lit(True)).count() == 0
    for empty in (df.limit(0), df.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert nearest.search(empty, spark, F.lit(True)).count() == 0
        assert embedding_dedup.near_duplicates(empty, spark).count() == empty.count()


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(5, 5), (7, 3), (3, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert got == {x: root(x) for x in list(up)}
