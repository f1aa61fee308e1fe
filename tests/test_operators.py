"""Golden cases and properties of the operators."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sequora.functions import arrays as A
from sequora.functions import metrics as M
from sequora.functions import text as X
from sequora.operators import clean, monitor, proximity, ranking, retrieval, sampling, sequences, vocab
from sequora.operators.taxonomy import FIVE_DOMAINS, THREE_DOMAIN_POSITIVES, THREE_DOMAINS
from sequora.plans import registry
from sequora.plans.registry import Registry


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def longs(*x):
    return F.lit(list(x)).cast("array<bigint>")


IDS, ACTS = (4, 7, 3, 4, 5, 7, 7), (0, 0, 0, 1, 0, 0, 1)


@pytest.mark.parametrize(("ids", "n", "inputs", "labels", "length"), [((10, 20, 30, 40), 6, [10, 20, 30, 0, 0, 0], [20, 30, 40, 0, 0, 0], 3), (IDS, 5, [7, 3, 4, 5, 7], [3, 4, 5, 7, 7], 5)])
def test_next_event(spark, ids, n, inputs, labels, length):
    assert one(spark, *sequences.next_event_example(longs(*ids), n)) == [inputs, labels, length]


def test_conditional_and_next_positive(spark):
    ids, acts = longs(*IDS), F.lit(list(ACTS))
    assert one(spark, A.conditional_labels(ids, acts), A.next_positive(ids, acts)) == [[0, 0, 4, 0, 0, 7, 0], [4, 4, 4, 7, 7, 7, 0]]


def test_mask_of_items_that_come_again(spark):
    df = spark.createDataFrame([(1, i, x, a) for i, (x, a) in enumerate(zip(IDS, ACTS, strict=True))], "u long, p int, id long, a int")
    out = sequences.positive_later(df, "u", ["p"], "id", F.col("a") > 0).orderBy("p").select(F.when(F.col("again"), -1).otherwise(F.col("id"))).collect()
    assert [r[0] for r in out] == [-1, -1, 3, 4, 5, -1, 7]


def test_metrics(spark):
    ranks = [1, 2, 5, 10, 11, 0]
    got = one(spark, *(M.ndcg(F.lit(r), 10) for r in ranks))
    assert got == pytest.approx([1 / math.log2(r + 1) if 0 < r <= 10 else 0 for r in ranks])
    assert one(spark, *(M.hit_rate(F.lit(r), 10) for r in (1, 10, 11, 100))) == [1, 1, 0, 0]
    assert one(spark, M.mrr(F.lit(4)), M.mrr(F.lit(0)), M.mrr(F.lit(0), 2501)) == pytest.approx([0.25, 0, 1 / 2501])


@pytest.mark.parametrize(("scores", "rank"), [((4, 5, 3, 1), 2), ((5, 5, 5, 5), 1)])
def test_label_rank(spark, scores, rank):
    df = spark.createDataFrame([(1, float(s), i == 0) for i, s in enumerate(scores)], "q int, s double, y boolean")
    assert retrieval.label_rank(df, "q", "s", F.col("y")).first()["target_rank"] == rank


@pytest.mark.parametrize(("dt", "weight"), [(0, 4.00), (60, 3.84), (180, 2.82), (300, 1.75), (600, 1.01)])
def test_anchor_weight(spark, dt, weight):
    df = spark.createDataFrame([(1, 1000, 3), (1, 1000 + dt, 1)], "u int, t long, k int")
    out = proximity.around(df, "u", "t", F.col("k") == 1, F.lit(True)).where("k = 3").first()["weight"]
    assert out == pytest.approx(weight, abs=0.006)


@pytest.mark.parametrize(("dt", "weight"), [(7200, 2.1), (1800, 3.34)])
def test_weight_of_a_later_anchor(spark, dt, weight):
    df = spark.createDataFrame([(1, 1000, 3), (1, 1000 + dt, 1)], "u int, t long, k int")
    out = proximity.ahead(df, "u", "t", F.col("k") == 1, F.lit(True), 3.0, 7200, 86400).where("k = 3").first()["weight"]
    assert out == pytest.approx(weight, abs=0.01)


@pytest.mark.parametrize(("text", "item"), [("hello", 103734), ("", 202046), ("a b", 228192)])
def test_hash_item_id(spark, text, item):
    assert one(spark, X.hash_item_id(F.lit(text))) == [item]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_hash_item_id_is_md5(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.hash_item_id(F.col("t"))).collect()]
    assert got == [20 + int(hashlib.md5(t.encode()).hexdigest(), 16) % 499980 for t in texts]


@pytest.mark.parametrize(
    ("url", "domain", "words"),
    [
        ("https://www.shop.example/a-b/c%20d?q=1", "shop.example", "www.shop.example a b c d"),
        ("www.shop.example/x", "shop.example", "www.shop.example x"),
        ("shop.example", "shop.example", "shop.example"),
        ("two words", "two words", "two words"),
        ("http://u@Host.example:8080/p_q+r", "u@Host.example:8080", "host.example p q+r"),
        (None, "", ""),
        ("  ", "", ""),
    ],
)
def test_urls(spark, url, domain, words):
    u = F.lit(url).cast("string")
    assert one(spark, X.url_to_domain(u), X.normalize_url(u)) == [domain, words]


def test_event_text(spark):
    t = lambda *x: F.lit(list(x)).cast("array<string>") if x else F.array().cast("array<string>")
    kind = F.lit("view")
    assert one(spark, X.event_text(t(" a", "b "), kind), X.event_text(t(), kind), X.event_text(F.array(F.lit(None).cast("string"), F.lit("")), kind), X.event_text(F.lit(None).cast("array<string>"), kind)) == ["a b", "view", "view", "view"]
    assert one(spark, X.event_text_v2(F.lit(" T "), F.lit("http://www.a.b/c"), kind), X.event_text_v2(F.lit(None).cast("string"), F.lit(None).cast("string"), kind)) == ["T a.b", "view"]


@pytest.mark.parametrize(("text", "seconds"), [("2024-01-02 03:04", 1704164640), ("2024-1-2 3:4", 1704164640), ("2024-01-02 03:04:05", 0), ("2024-13-02 03:04", 0), ("2024-01-02 24:04", 0), ("x", 0), (None, 0)])
def test_parse_minute(spark, text, seconds):
    assert one(spark, X.parse_minute(F.lit(text).cast("string"))) == [seconds]


def test_explode_clean_and_dedup(spark):
    raw = spark.createDataFrame(
        [(1, '[{"time":"2024-01-01T00:00:00Z","Type":"MSN","Market":"x","Texts":["a"]},{"time":"2024-01-01T00:00:00Z","Type":"MSN","Market":"b","Texts":["a"]},{"time":"2009-01-01T00:00:00Z","Type":"MSN","Texts":["a","b"]}]'), (2, "[]"), (3, None), (4, "oops")],
        "user_id long, EventsOnlyWithAd string",
    )
    flat = clean.after(clean.fill_missing(clean.explode_events(raw, keep=("user_id",))))
    assert [(r.title, r.url, r.market) for r in clean.dedup(flat, ["user_id", "time", "type", "title", "url"], ["market"]).collect()] == [("a", X.MISSING_URL, "b")]


def test_vocabularies(spark):
    df = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (1, "a", 3), (0, "b", 4)], "d int, t string, p int")
    assert {(r.d, r.t, r.item_id) for r in vocab.build(df, ["t"], "d").collect()} == {(0, "a", 20), (0, "b", 21), (1, "a", 20)}
    assert {(r.d, r.t, r.item_id) for r in vocab.build_first_seen(df, "d", "t", ["p"]).collect()} == {(0, "b", 0), (0, "a", 1), (1, "a", 0)}
    big = spark.range(500).select(F.lit(1).alias("d"), F.col("id").cast("string").alias("t"))
    assert sorted(r.item_id for r in vocab.build_large(big, ["t"], "d", buckets=7).collect()) == list(range(20, 520))
    assert one(spark, vocab.smallest_offset(F.lit(999)), vocab.smallest_offset(F.lit(1000)), *vocab.decode(F.lit(3_000_000_021))) == [1000, 10000, 3, 21]


def test_cut_to_last_positive(spark):
    df = spark.createDataFrame([(1, ["a", "p", "b", "p", "c"]), (2, ["a"]), (3, []), (4, ["p", None])], "u int, t array<string>")
    out = sequences.cut_to_last_positive(df, "t", ["p"], ["t"]).orderBy("u").collect()
    assert [r.t for r in out] == [["a", "p", "b", "p"], [], [], ["p"]]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 99), max_size=12), st.integers(1, 8))
def test_pad_truncate(spark, x, n):
    (got,) = one(spark, A.pad_truncate(F.lit(x).cast("array<bigint>") if x else F.array().cast("array<bigint>"), n))
    assert got == (x[-n:] + [0] * n)[:n]


def test_history_sampling(spark):
    df = spark.range(400).select((F.col("id") % 7).alias("u"), F.col("id").alias("t"))
    out = sequences.sample_history(df, "u", ["t"], 0.25, 20, 3)
    rows = {u: sorted(t for v, t in out.collect() if v == u) for u in range(7)}
    for u, got in rows.items():
        own = [t for t in range(400) if t % 7 == u]
        assert got[-1] == own[-1] and len(got) == 6 and set(got) <= set(own[-21:])
    with pytest.raises(ValueError, match="rate"):
        sequences.sample_history(df, "u", ["t"], 0, 20, 3)


def test_splits_cover_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "u")
    got = sampling.hash_split(df, "u", 0.9, 1).collect()
    assert sorted(r.u for r in got) == list(range(1000)) and 850 < sum(r.split == "train" for r in got) < 950
    assert sampling.eval_users(df, "u", F.col("u") > 500, 30, 1).where("split = 'eval'").agg(F.count("*"), F.min("u")).first()[0] == 30


def test_negatives(spark):
    pool = spark.createDataFrame([(0, 5), (0, 6), (1, 9)], "domain int, item long")
    out = sampling.domain_negatives(spark.createDataFrame([(0,), (1,), (2,)], "domain int"), pool, "item", 6, 2).collect()
    assert {r.domain for r in out} == {0, 1} and len(out) == 12 and all(r.negative == 9 for r in out if r.domain == 1)
    rows = spark.range(64).select(F.lit(0).alias("b"), F.col("id").alias("p"), (F.col("id") % 4).alias("s"), (F.col("id") % 10).alias("i"))
    drawn = sampling.in_batch_negatives(rows, "b", "p", "s", "i", 4, 1).join(rows.drop("b"), "p").collect()
    assert len(drawn) > 200 and all(r.negative != r.i for r in drawn)


def test_negatives_of_skewed_batches(spark):
    """Every draw with a fitting row gives one, however much of the batch one sequence or item holds."""
    p = F.col("id")
    rows = spark.range(200).select(F.floor(p / 100).alias("b"), (p % 100).alias("p"), F.when(p % 100 < 90, 0).otherwise(p % 5).alias("s"), F.when(p < 100, p).otherwise(F.when(p < 195, 1000).otherwise(p)).alias("i"))
    at = {(r.b, r.p): r for r in rows.collect()}
    got = sampling.in_batch_negatives(rows, "b", "p", "s", "i", 3, 1).collect()
    fit = {key: {o.i for o in at.values() if o.b == r.b and o.s != r.s and o.i != r.i} for key, r in at.items()}
    assert len(got) == len({(r.b, r.p, r.j) for r in got}) == 3 * sum(map(bool, fit.values())) and all(r.negative in fit[r.b, r.p] for r in got)
    drawn = [r.negative for r in got if r.b == 0 and at[r.b, r.p].s == 0]
    assert len(drawn) == 276 and all(15 <= drawn.count(i) <= 60 for i in fit[0, 0])  # 34.5 each


def test_topk_blocks(spark):
    items = spark.range(200).select("id", F.array(F.sin("id"), F.cos("id"), (F.col("id") % 3).cast("double")).alias("v"))
    got = retrieval.mips_topk(items.where("id < 7"), items, 5, blocks=3, chunks=2).collect()
    v = {i: (math.sin(i), math.cos(i), float(i % 3)) for i in range(200)}
    for q in range(7):
        want = sorted(range(200), key=lambda i: (-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i))[:5]
        assert [r.item_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    with pytest.raises(ValueError, match="unknown"):
        retrieval.topk("magic")


def test_topk_has_k_rows_however_many_are_seen(spark, tmp_path):
    """The registered query where 100 of each query's best are seen."""
    rows = [(i, 0, [1000.0 - i // 50 if i % 50 == 0 else 1.0 + i / 1e5] + [1.0] * 63) for i in range(5000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["topk_exclude_seen"](spark, str(tmp_path)).orderBy("rank").collect()
    assert len(got) == 50 and [r.item_id for r in got] == [i for i in range(4999, 4900, -1) if i % 50][:50]


def test_mixture_of_products(spark):
    """Equal gates make it the mean of the components' products."""
    items = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(1.0), F.sin("id"), F.cos("id"), F.sin(F.col("id") * 2), (F.col("id") % 3).cast("double")).alias("v"))
    got = retrieval.mixture_topk(items.where("id = 3"), items, 4, 2).orderBy("rank").collect()
    v = {i: (math.sin(i), math.cos(i), math.sin(2 * i), float(i % 3)) for i in range(50)}
    want = sorted(range(50), key=lambda i: -sum(a * b for a, b in zip(v[3], v[i], strict=True)))[:4]
    assert [r.item_id for r in got] == want and got[0].score == pytest.approx(sum(a * b for a, b in zip(v[3], v[want[0]], strict=True)) / 2)


def test_pool_index_is_dense_over_buckets(spark):
    pool = spark.createDataFrame([(i * 977,) for i in range(300)] + [(977,)], "item long")
    rows = sampling.indexed(pool, "item", width=1000).orderBy("idx").collect()
    assert [(r.item, r.idx, r.n) for r in rows] == [(i * 977, i, 300) for i in range(300)]


def test_monitor(spark):
    p = spark.createDataFrame([("r", b, v) for b, v in ((1000, 0.2), (2000, 0.1), (3000, 0.3), (4000, 0.3))], "run string, batch long, v double")
    assert [(r.best, r.best_at) for r in monitor.best_so_far(p, "run", "batch", "v").orderBy("batch").collect()] == [(0.2, 1000), (0.2, 1000), (0.3, 3000), (0.3, 3000)]
    assert [r.best for r in monitor.best_so_far(p, "run", "batch", "v", "min").orderBy("batch").collect()] == [0.2, 0.1, 0.1, 0.1]
    q = spark.createDataFrame([("a", 9000, 0.1), ("a", 12000, 0.1), ("b", 12000, 0.15), ("b", 20000, 0.15), ("c", 20000, 0.18), ("c", 40000, 0.2)], "run string, batch long, v double")
    assert [r.reason for r in monitor.early_stop(q, "run", "batch", "v", 40000).orderBy("run", "batch").collect()] == [None, "early_reject", None, "reject", None, "max_batches"]


def test_reports_leave_nothing_out(spark):
    df = spark.createDataFrame([("a", "g", 1), ("b", None, 2), ("b", "h", 0)], "t string, g string, r int")
    out = {(r.scope, r.name): r.n for r in ranking.by_type_and_group(df, "t", "g", "r").collect()}
    assert out == {("overall", "Overall"): 3, ("type", "a"): 1, ("type", "b"): 2, ("group", "g"): 1, ("group", None): 1, ("group", "h"): 1}


def test_taxonomies(spark):
    t = FIVE_DOMAINS
    assert one(spark, *(f(F.lit(x)) for f in (t.type_id, t.group, t.domain) for x in ("NativeClick", "AbandonCart", "??"))) == [1, 10, 0, "Ad", "Purchase", "Others", 0, 3, -1]
    assert t.table(spark).count() == 14 and len(THREE_DOMAINS) == len(THREE_DOMAIN_POSITIVES) == 3
    with pytest.raises(ValueError, match="mode"):
        t.mode("some")


def test_registry():
    r = Registry()
    r.register("op", "x", len)
    assert r.build("op", "x", [1, 2]) == 2 and r.has("op", "x") and r.names("op") == ["x"]
    with pytest.raises(ValueError, match="taken"):
        r.register("op", "x", max)
    with pytest.raises(KeyError):
        r.get("op", "y")
