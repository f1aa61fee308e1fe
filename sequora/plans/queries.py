"""One query for each operator, over whole tables, with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequora.functions import arrays as A
from sequora.functions import metrics as M
from sequora.functions import text as X
from sequora.operators import clean, monitor, proximity, ranking, ratings, retrieval, sampling, sequences, vocab
from sequora.operators.taxonomy import STREAM
from sequora.plans.registry import query
from sequora.plans.tables import EV, RANK, case, events, h60, rank_of, read

ORDER = ["t", "event_id"]
USER = "PARTITION BY user_id ORDER BY t, event_id"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def csv(c: Column | str) -> Column:
    return X.numbers_to_csv(F.col(c) if isinstance(c, str) else c)


# Sources -----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id", "user_id", "event_type", "value")


@query(f"WITH {EV} SELECT event_id, k, 0 AS malformed FROM ev")
def parse_props_json(s: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return read(s, d, "events").select("event_id", parsed["k"].alias("k"), (parsed["k"].isNull() & F.col("props").isNotNull()).cast("int").alias("malformed"))


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def row_counts(s: SparkSession, d: str) -> DataFrame:
    one = lambda t: read(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("events").unionByName(one("orders")).unionByName(one("lineitem"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def range_scan(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 1100)).select("o_orderkey", "o_custkey")


# Projections and filters -------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, t FROM ev")
def unix_seconds(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", "t")


@query(f"WITH {EV} SELECT event_id, type_id > 0 AND t > 0 AS valid, id <> 0 AS supervised FROM ev")
def validity_mask(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", _valid().alias("valid"), (F.col("id") != 0).alias("supervised"))


@query(f"SELECT event_id, {h60("'user'", 'user_id', 'event_id')} AS row_key FROM events")
def stable_row_key(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id", X.hash60("user", F.col("user_id"), F.col("event_id")).alias("row_key"))


@query("SELECT event_id, NULL::VARCHAR AS demand_type, value FROM events")
def optional_columns(s: SparkSession, d: str) -> DataFrame:
    df = clean.with_optional(clean.with_optional(read(s, d, "events"), "demand_type", "string"), "value", "double")
    return df.select("event_id", "demand_type", "value")


@query("WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM p")
def part_offsets(s: SparkSession, d: str) -> DataFrame:
    return sampling.offsets(read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n")


@query(f"WITH {EV}, n AS (SELECT user_id, id, row_number() OVER ({USER}) - 1 AS pos FROM ev) SELECT user_id, pos, id FROM n")
def explode_sequences(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.collect(events(s, d), "user_id", ORDER, ["id"])
    return rows.select("user_id", F.posexplode("id").alias("pos", "id"))


_PAIR = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END"


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Orders as events with 0, 1 or 2 texts."""
    k = F.col("o_orderkey")
    texts = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array("o_orderpriority")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    return read(s, d, "orders").select("o_orderkey", texts.alias("texts"), "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS url FROM orders")
def title_url_extract(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("o_orderkey", F.get("texts", F.lit(0)).alias("title"), F.get("texts", F.lit(1)).alias("url"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '__MISSING_TITLE__' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN '__MISSING_URL__' ELSE o_orderstatus END AS url FROM orders")
def null_placeholders(s: SparkSession, d: str) -> DataFrame:
    return clean.fill_missing(title_url_extract(s, d))


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")
def filter_valid_time(s: SparkSession, d: str) -> DataFrame:
    return clean.after(read(s, d, "events"), "ts", "2024-01-10 12:00:00").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def filter_event_types(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def filter_ads_only(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").where(F.col("event_type").isin(*STREAM.mode("ads_only"))).select("event_id", "event_type")


@query(f"WITH {EV} SELECT event_id, domain::INT AS domain FROM ev WHERE domain >= 0")
def map_domain(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("domain >= 0").select("event_id", "domain")


@query(f"WITH {EV} SELECT event_id, type_id, grp FROM ev")
def map_group(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", "type_id", "grp")


@query(f"WITH {EV} SELECT event_id, domain * 1000000000 + k + 20 AS encoded_id FROM ev")
def encode_ids(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", vocab.encode(F.col("domain"), F.col("k") + 20).alias("encoded_id"))


@query(f"WITH {EV} SELECT event_id, id // 1000000000 AS domain_id, id % 1000000000 AS item_id FROM ev")
def decode_ids(s: SparkSession, d: str) -> DataFrame:
    domain, item = vocab.decode(F.col("id"))
    return events(s, d).select("event_id", domain.alias("domain_id"), item.alias("item_id"))


@query(f"WITH {EV} SELECT domain, ('1' || repeat('0', length(max(id % 1000000000)::VARCHAR)))::BIGINT AS domain_offset FROM ev GROUP BY domain")
def domain_offset(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy(F.col("domain").cast("long").alias("domain")).agg(vocab.smallest_offset(F.max(F.pmod("id", F.lit(vocab.OFFSET)))).alias("domain_offset"))


_STAMP = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d %-H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN epoch(o_orderdate)::BIGINT ELSE 0 END AS seconds FROM orders")
def parse_minute_ts(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    form = lambda p: F.date_format(t, p)
    stamp = F.when(k % 4 == 0, form("yyyy-MM-dd HH:mm")).when(k % 4 == 1, form("yyyy-M-d H:mm")).when(k % 4 == 2, form("yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return read(s, d, "orders").select("o_orderkey", X.parse_minute(stamp).alias("seconds"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 5")
def min_len_filter(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.collect(read(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return clean.min_length(rows, "o_orderkey", 5).select("o_custkey", F.size("o_orderkey").cast("long").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT')")
def users_with_positive(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.collect(read(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderpriority"])
    return clean.with_any(rows, "o_orderpriority", ["1-URGENT"]).select("o_custkey", F.size("o_orderpriority").cast("long").alias("n"))


_FREQUENT = f"{EV}, f AS (SELECT domain, text, count(*) AS c FROM ev GROUP BY ALL), vocab AS (SELECT domain, text, row_number() OVER (PARTITION BY domain ORDER BY text) + 19 AS item_id FROM f WHERE c >= (SELECT avg(c) FROM f))"


def _frequent(e: DataFrame) -> DataFrame:
    """A vocabulary of the texts that are met as often as the average one, or more."""
    counts = e.groupBy("domain", "text").agg(F.count("*").alias("c"))
    mean = counts.agg(F.avg("c").alias("mean"))
    return vocab.build(counts.crossJoin(mean).where("c >= mean"), ["text"], "domain")


@query(f"WITH {_FREQUENT} SELECT count(*) AS n_rows, count_if(v.text IS NULL) AS n_missing FROM ev LEFT JOIN vocab v USING (domain, text)")
def vocab_miss_count(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return vocab.misses(e, _frequent(e), ["domain", "text"])


@query(f"WITH {EV} SELECT event_id, id > 0 AND id < 1000000000 AS in_0, id >= 2000000000 AND id < 3000000000 AS in_2 FROM ev")
def domain_mask(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", vocab.in_domain(F.col("id"), 0).alias("in_0"), vocab.in_domain(F.col("id"), 2).alias("in_2"))


# Vocabularies and joins --------------------------------------------------------------------------------------------------

_VOCAB = f"{EV}, vocab AS (SELECT domain, text, row_number() OVER (PARTITION BY domain ORDER BY text) + 19 AS item_id FROM (SELECT DISTINCT domain, text FROM ev))"


@query(f"WITH {EV} SELECT DISTINCT domain::INT AS domain, text FROM ev")
def distinct_items(s: SparkSession, d: str) -> DataFrame:
    return vocab.distinct_items(events(s, d), ["domain", "text"])


@query(f"WITH {_VOCAB} SELECT domain::INT AS domain, text, item_id FROM vocab")
def build_vocab(s: SparkSession, d: str) -> DataFrame:
    return vocab.build(events(s, d), ["text"], "domain")


@query(f"WITH {EV}, u AS (SELECT DISTINCT domain, text FROM ev) SELECT domain::INT AS domain, count(*) AS n, 20::BIGINT AS min_id, count(*) + 19 AS max_id, count(*) AS n_ids FROM u GROUP BY domain")
def build_vocab_large(s: SparkSession, d: str) -> DataFrame:
    built = vocab.build_large(events(s, d), ["text"], "domain", buckets=64)
    return built.groupBy("domain").agg(F.count("*").alias("n"), F.min("item_id").alias("min_id"), F.max("item_id").alias("max_id"), F.count_distinct("item_id").alias("n_ids"))


@query(f"WITH {EV}, f AS (SELECT domain, text, min(event_id) AS f FROM ev GROUP BY ALL) SELECT domain::INT AS domain, text, row_number() OVER (PARTITION BY domain ORDER BY f) - 1 AS item_id FROM f")
def build_vocab_first_seen(s: SparkSession, d: str) -> DataFrame:
    return vocab.build_first_seen(events(s, d), "domain", "text", ["event_id"])


@query(f"WITH {_VOCAB} SELECT count(*) AS n, min(item_id) AS min_id, max(item_id) AS max_id FROM vocab")
def vocab_stats(s: SparkSession, d: str) -> DataFrame:
    return vocab.stats(build_vocab(s, d))


@query(f"WITH {_VOCAB} SELECT domain::INT AS domain, count(*) AS n, max(item_id) AS max_id, count(*) + 20 AS shard_size FROM vocab GROUP BY domain")
def vocab_summary(s: SparkSession, d: str) -> DataFrame:
    return vocab.summary(build_vocab(s, d), "domain")


@query(f"WITH {_VOCAB} SELECT domain * 1000000000 + item_id AS encoded_id, text FROM vocab")
def inverse_vocab(s: SparkSession, d: str) -> DataFrame:
    return build_vocab(s, d).select(vocab.encode(F.col("domain"), F.col("item_id")).alias("encoded_id"), "text")


@query(f"WITH {_VOCAB} SELECT e.event_id, v.item_id, e.domain * 1000000000 + v.item_id AS encoded_id FROM ev e LEFT JOIN vocab v USING (domain, text)")
def join_vocab(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    joined = vocab.attach(e, vocab.build(e, ["text"], "domain"), ["domain", "text"])
    return joined.select("event_id", "item_id", vocab.encode(F.col("domain"), F.col("item_id")).alias("encoded_id"))


@query(f"WITH {_FREQUENT} SELECT e.event_id, v.item_id FROM ev e JOIN vocab v USING (domain, text)")
def join_vocab_inner(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return vocab.attach(e, _frequent(e), ["domain", "text"], "inner").select("event_id", "item_id")


@query(f"WITH {EV} SELECT event_id, id FROM ev WHERE domain = 0 UNION ALL SELECT event_id, id FROM ev WHERE domain = 1 UNION ALL SELECT event_id, id FROM ev WHERE domain = 2")
def union_domains(s: SparkSession, d: str) -> DataFrame:
    one = lambda n: events(s, d).where(F.col("domain") == n).select("event_id", "id")
    return one(0).unionByName(one(1)).unionByName(one(2))


_RATINGS = "SELECT o_custkey, l_partkey, l_quantity, o_orderdate, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _ratings(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_custkey", "l_partkey", "l_quantity", "o_orderdate", "l_orderkey", "l_linenumber")


@query(f"WITH r AS ({_RATINGS}) SELECT l_orderkey, l_linenumber, c_mktsegment FROM r LEFT JOIN customer ON o_custkey = c_custkey")
def ratings_user_join(s: SparkSession, d: str) -> DataFrame:
    users = read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return ratings.with_users(_ratings(s, d), users, "o_custkey").select("l_orderkey", "l_linenumber", "c_mktsegment")


@query(f"WITH r AS ({_RATINGS}), c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS u, count(*) OVER (PARTITION BY l_partkey) AS i FROM r) SELECT l_orderkey, l_linenumber FROM c WHERE u >= 30 AND i >= 30")
def kcore_filter(s: SparkSession, d: str) -> DataFrame:
    return ratings.kcore(_ratings(s, d), "o_custkey", "l_partkey", 30).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def categorical_remap(s: SparkSession, d: str) -> DataFrame:
    brands = read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return vocab.attach(read(s, d, "lineitem"), brands, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query(f"WITH {EV} SELECT event_id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS first_value FROM ev LEFT JOIN embeddings ON vec_id = k")
def embedding_lookup(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    found = retrieval.lookup(events(s, d), vectors, ["k"])
    return found.select("event_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), r6(F.get("embedding", F.lit(0)).cast("double")).alias("first_value"))


# Proximity ---------------------------------------------------------------------------------------------------------------


def _click() -> Column:
    return F.col("type_id").isin(1, 2)


def _valid() -> Column:
    return (F.col("type_id") > 0) & (F.col("t") > 0)



@query(
    f"""WITH {EV}, n AS (SELECT *, min(CASE WHEN type_id IN (1, 2) THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) AS a FROM ev)
SELECT event_id, round(1 + CASE WHEN type_id IN (1, 2) THEN 0 ELSE 3.0::DOUBLE * coalesce(exp(-(a - t) / 7200.0::DOUBLE), 0) END, 6) AS weight FROM n"""
)
def ad_proximity_weights(s: SparkSession, d: str) -> DataFrame:
    return proximity.ahead(events(s, d), "user_id", "t", _click(), _valid(), 3.0, 7200, 86400).select("event_id", r6("weight").alias("weight"))


_AROUND = f"""{EV}, n AS (SELECT *, min(CASE WHEN type_id IN (1, 2) THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING) - t AS a,
  t - max(CASE WHEN type_id IN (1, 2) THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS b FROM ev),
w AS (SELECT *, 1 + CASE WHEN type_id IN (1, 2) THEN 0 ELSE 3.0::DOUBLE * ({case("event_type", "gate", "0")}) * greatest(coalesce(exp(-0.5 * pow(a / 1800.0::DOUBLE, 2)), 0),
  coalesce(0.5::DOUBLE * exp(-0.5 * pow(b / 1800.0::DOUBLE, 2)), 0)) END AS weight FROM n)"""


def _weights(s: SparkSession, d: str) -> DataFrame:
    return proximity.around(events(s, d), "user_id", "t", _click(), _valid(), 4.0, 1800.0, 7200, 3600, 1.0, 0.5, STREAM.gate(F.col("type_id")))


@query(f"WITH {_AROUND} SELECT event_id, round(weight, 6) AS weight FROM w")
def ad_anchor_weights(s: SparkSession, d: str) -> DataFrame:
    return _weights(s, d).select("event_id", r6("weight").alias("weight"))


@query(
    f"""WITH {EV}, v AS (SELECT ev.*, embedding FROM ev JOIN embeddings ON vec_id = k),
p AS (SELECT a.event_id, max(exp(-0.5 * pow((a.t - b.t) / 3600.0::DOUBLE, 2)) * least(greatest((list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 0.2) / 1.2, 0), 1)) AS best
  FROM v a JOIN v b ON a.user_id = b.user_id AND b.type_id IN (1, 2) AND a.type_id NOT IN (1, 2) AND abs(a.t - b.t) <= 7200 GROUP BY a.event_id)
SELECT v.event_id, round(1 + 3.0::DOUBLE * coalesce(best, 0), 6) AS weight FROM v LEFT JOIN p ON v.event_id = p.event_id"""
)
def ad_anchor_semantic(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    rows = events(s, d).join(vectors, "k")
    return proximity.around_similar(rows, "user_id", "event_id", "t", "embedding", _click(), _valid(), 4.0, 3600.0, 7200, -0.2, 1.0).select("event_id", r6("weight").alias("weight"))


_DIAGNOSTICS = "count(*) AS n, round(avg(weight), 6) AS mean_weight, round(max(weight), 6) AS max_weight, round(avg((weight > 1)::INT), 6) AS frac_gt_1, round(avg((weight >= 1.5)::INT), 6) AS frac_ge_1_5, round(avg((weight >= 2)::INT), 6) AS frac_ge_2, round(avg((weight >= 3)::INT), 6) AS frac_ge_3, round(avg((weight >= 3.5)::INT), 6) AS frac_ge_3_5"


@query(f"WITH {_AROUND} SELECT grp, {_DIAGNOSTICS} FROM w GROUP BY grp")
def weight_diagnostics(s: SparkSession, d: str) -> DataFrame:
    out = proximity.diagnostics(_weights(s, d), "weight", "grp")
    return out.select("grp", "n", *(r6(c).alias(c) for c in out.columns if c not in ("grp", "n")))


@query(
    f"""WITH {_AROUND}, e AS (SELECT id, event_type, (a IS NOT NULL OR b IS NOT NULL)::INT AS near FROM n), t AS (SELECT event_type, avg(near) AS p_type FROM e GROUP BY event_type),
i AS (SELECT id, event_type, count(*) AS n, sum(near)::DOUBLE AS near FROM e GROUP BY ALL),
x AS (SELECT id, n, near, CASE WHEN n >= 20 THEN (near + 100 * p_type) / (n + 100) ELSE p_type END AS p FROM i JOIN t USING (event_type)),
z AS (SELECT (SELECT avg(near) FROM e) AS low, (SELECT quantile_cont(p, 0.95) FROM x) AS high)
SELECT id, n, near, round(p, 6) AS p, round(least(greatest((p - low) / greatest(high - low, 1e-9), 0), 1), 4) AS gate FROM x, z"""
)
def empirical_anchor_prob(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t")
    hit = F.when(_click(), F.col("t"))
    near = F.min(hit).over(w.rangeBetween(0, 7200)).isNotNull() | F.max(hit).over(w.rangeBetween(-3600, -1)).isNotNull()
    out = proximity.near_probability(events(s, d).withColumn("near_", near), "id", "event_type", F.col("near_"))
    return out.select("id", "n", "near", r6("p").alias("p"), F.round("gate", 4).alias("gate"))


# Aggregations ------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_events(s: SparkSession, d: str) -> DataFrame:
    return clean.dedup(read(s, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(f"WITH {EV} SELECT user_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY t, event_id) AS ids, string_agg(event_type, ',' ORDER BY t, event_id) AS types, string_agg(t::VARCHAR, ',' ORDER BY t, event_id) AS times FROM ev GROUP BY user_id")
def user_sequences(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.collect(events(s, d), "user_id", ORDER, ["id", "event_type", "t"])
    return rows.select("user_id", F.size("id").cast("long").alias("n"), csv("id").alias("ids"), F.array_join("event_type", ",").alias("types"), csv("t").alias("times"))


@query(f"WITH r AS ({_RATINGS}) SELECT o_custkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_quantity::INT) AS items, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_quantity::INT) AS stars FROM r GROUP BY o_custkey")
def rating_sequences(s: SparkSession, d: str) -> DataFrame:
    rows = _ratings(s, d).withColumn("stars", F.col("l_quantity").cast("int"))
    out = sequences.collect(rows, "o_custkey", ["o_orderdate", "l_orderkey", "l_linenumber"], ["l_partkey", "stars"])
    return out.select("o_custkey", csv("l_partkey").alias("items"), csv("stars").alias("stars"))


@query("WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS n_users, min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS mean_len, median(n) AS median_len FROM u")
def seq_len_stats(s: SparkSession, d: str) -> DataFrame:
    users = read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return ratings.length_stats(users, F.col("n")).withColumn("mean_len", r6("mean_len"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def type_histogram(s: SparkSession, d: str) -> DataFrame:
    return ratings.histogram(read(s, d, "events"), "event_type").withColumn("share", r6("share"))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def categorical_codes(s: SparkSession, d: str) -> DataFrame:
    return ratings.codes(read(s, d, "customer"), "c_mktsegment", "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@query(f"WITH {EV} SELECT id, arg_max(value, event_id) AS value FROM ev GROUP BY id")
def last_value_dedup(s: SparkSession, d: str) -> DataFrame:
    return retrieval.last_by_id(events(s, d), "id", "event_id", "value")


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE embedding IS NOT NULL) SELECT label, pos::INT AS pos, round(avg(v), 6) AS mean FROM x GROUP BY label, pos")
def mean_pooling(s: SparkSession, d: str) -> DataFrame:
    return retrieval.mean_pool(read(s, d, "embeddings"), "label", "embedding", F.col("embedding").isNotNull()).withColumn("mean", r6("mean"))


# Ranking reports ---------------------------------------------------------------------------------------------------------

_RECORDS = f"{EV}, rec AS (SELECT *, r AS target_rank, CASE WHEN r BETWEEN 1 AND 10 THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END AS ndcg, (r BETWEEN 1 AND 10)::INT AS hr, CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END AS mrr FROM (SELECT *, {RANK} AS r FROM ev))"
_MEANS = "round(avg(ndcg), 6) AS ndcg, round(avg(hr), 6) AS hr, round(avg(mrr), 6) AS mrr, count(*) AS n"


def _records(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).withColumn("target_rank", rank_of(F.col("event_id")))


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumns({c: r6(c) for c in ("ndcg", "hr", "mrr")})


@query(f"WITH {_RECORDS} SELECT event_id, round(ndcg, 6) AS ndcg_10, hr::DOUBLE AS hr_10, round(mrr, 6) AS mrr, CASE WHEN r BETWEEN 1 AND 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS hr_200, round(CASE WHEN r BETWEEN 1 AND 50 THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END, 6) AS ndcg_50, round(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 1.0::DOUBLE / 2501 END, 6) AS mrr_floor FROM rec")
def ranking_metrics(s: SparkSession, d: str) -> DataFrame:
    r = F.col("target_rank")
    return _records(s, d).select("event_id", r6(M.ndcg(r, 10)).alias("ndcg_10"), M.hit_rate(r, 10).alias("hr_10"), r6(M.mrr(r)).alias("mrr"), M.hit_rate(r, 200).alias("hr_200"), r6(M.ndcg(r, 50)).alias("ndcg_50"), r6(M.mrr(r, 2501)).alias("mrr_floor"))


@query(f"WITH {_RECORDS} SELECT grp, {_MEANS} FROM rec GROUP BY grp UNION ALL SELECT 'Overall', {_MEANS} FROM rec")
def metrics_by_group(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.by_group(_records(s, d), "grp", "target_rank"))


@query(f"WITH {_RECORDS} SELECT 'overall' AS scope, 'Overall' AS name, {_MEANS} FROM rec UNION ALL SELECT 'type', event_type, {_MEANS} FROM rec GROUP BY event_type UNION ALL SELECT 'group', grp, {_MEANS} FROM rec GROUP BY grp")
def metrics_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.by_type_and_group(_records(s, d), "event_type", "grp", "target_rank"))


@query(f"WITH {_RECORDS} SELECT id // 1000000000 AS domain_id, {_MEANS} FROM rec GROUP BY domain_id")
def metrics_by_domain(s: SparkSession, d: str) -> DataFrame:
    rows = _records(s, d).withColumn("domain_id", vocab.decode(F.col("id"))[0])
    return _rounded(rows.groupBy("domain_id").agg(*ranking.metric_columns(F.col("target_rank"), 10)))


@query(f"WITH {_RECORDS} SELECT {_MEANS} FROM rec WHERE type_id IN (1, 2)")
def metrics_ads_only(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.masked(_records(s, d), "target_rank", _click()))


_LOGITS = """o AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_discount END) / 0.05::DOUBLE AS p, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS part, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS w FROM lineitem GROUP BY l_orderkey),
g AS (SELECT o.l_orderkey, any_value(p) AS p, any_value(w) AS w, list(CASE WHEN l_partkey = part THEN -5e4::DOUBLE ELSE l_discount / 0.05::DOUBLE END) FILTER (l_linenumber > 1) AS neg FROM o JOIN lineitem USING (l_orderkey) WHERE o.p IS NOT NULL GROUP BY o.l_orderkey),
f AS (SELECT *, greatest(p, list_max(neg)) AS m FROM g WHERE neg IS NOT NULL),
loss AS (SELECT *, m + ln(exp(p - m) + list_sum(list_transform(neg, lambda v: exp(v - m)))) - p AS loss FROM f)"""


def _logits(s: SparkSession, d: str) -> DataFrame:
    """Orders as queries: line 1 is the positive, the other lines are negatives, those of the same part masked."""
    one = F.col("l_linenumber") == 1
    line = F.struct("l_partkey", F.col("l_discount").alias("x"))
    o = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(one, F.col("l_discount"))).alias("p"), F.max(F.when(one, F.col("l_partkey"))).alias("part"), F.max(F.when(one, F.col("l_quantity"))).alias("w"), F.collect_list(F.when(~one, line)).alias("rest"))
    neg = F.transform("rest", lambda r: F.when(r["l_partkey"] == F.col("part"), F.lit(-5e4)).otherwise(r["x"] / 0.05))
    return o.where(F.col("p").isNotNull() & (F.size("rest") > 0)).withColumn("neg", neg)


@query(f"WITH {_LOGITS} SELECT round(sum(loss * w) / sum(w), 6) AS loss FROM loss")
def weighted_softmax_loss(s: SparkSession, d: str) -> DataFrame:
    rows = _logits(s, d).withColumn("l", M.log_softmax_loss(F.col("p"), F.col("neg")))
    return ranking.weighted_mean(rows, F.col("l"), F.col("w"), "loss").withColumn("loss", r6("loss"))


@query(f"WITH {_LOGITS}, m AS (SELECT p * 0.05 AS pos, list_avg(neg) * 0.05 AS neg FROM loss) SELECT round(avg(pos), 6) AS positive, round(avg(neg), 4) AS negative, round(avg(pos - neg), 4) AS gap FROM m")
def similarity_gap(s: SparkSession, d: str) -> DataFrame:
    neg = F.aggregate("neg", F.lit(0.0), lambda a, v: a + v) / F.size("neg") * 0.05
    rows = _logits(s, d).select(F.col("p").alias("pos"), neg.alias("neg"))
    return rows.agg(r6(F.avg("pos")).alias("positive"), F.round(F.avg("neg"), 4).alias("negative"), F.round(F.avg(F.col("pos") - F.col("neg")), 4).alias("gap"))


@query("WITH x AS (SELECT l_linestatus, (l_discount - 0.05) * 100.0::DOUBLE AS z, (l_returnflag = 'R')::INT AS y FROM lineitem) SELECT l_linestatus, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce FROM x GROUP BY l_linestatus")
def bce_loss(s: SparkSession, d: str) -> DataFrame:
    z, y = (F.col("l_discount") - 0.05) * 100.0, (F.col("l_returnflag") == "R").cast("int")
    return read(s, d, "lineitem").groupBy("l_linestatus").agg(r6(F.avg(M.bce(z, y))).alias("bce"))


_GATES = "x AS (SELECT p_partkey, p_brand, [(p_size % 5 + 1)::DOUBLE, (p_size % 3 + 1)::DOUBLE, (p_size % 2 + 1)::DOUBLE] AS g FROM part), p AS (SELECT p_partkey, p_brand, list_transform(g, lambda v: v / list_sum(g)) AS p FROM x)"


def _gates(s: SparkSession, d: str) -> DataFrame:
    g = F.array(*((F.col("p_size") % n + 1).cast("double") for n in (5, 3, 2)))
    return read(s, d, "part").withColumn("g", g).withColumn("p", F.transform("g", lambda v: v / (F.get("g", F.lit(0)) + F.get("g", F.lit(1)) + F.get("g", F.lit(2)))))


@query(f"WITH {_GATES} SELECT p_partkey, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-8))), 6) AS entropy FROM p")
def gate_entropy(s: SparkSession, d: str) -> DataFrame:
    return _gates(s, d).select("p_partkey", r6(A.entropy(F.col("p"))).alias("entropy"))


@query(f"WITH {_GATES}, e AS (SELECT p_partkey, unnest(p) AS v, generate_subscripts(p, 1) AS expert, list_position(p, list_max(p)) AS top FROM p), f AS (SELECT expert, avg((expert = top)::INT) AS f, avg(v) AS m FROM e GROUP BY expert) SELECT round(count(*) * sum(f * m), 6) AS load_balance FROM f")
def gate_load_balance(s: SparkSession, d: str) -> DataFrame:
    top = F.array_position("p", F.array_max("p"))
    rows = _gates(s, d).select(top.alias("top"), F.posexplode("p").alias("expert", "v")).withColumn("chosen", F.col("expert") + 1 == F.col("top"))
    return ranking.load_balance(rows, "expert", "v", "chosen").withColumn("load_balance", r6("load_balance"))


@query("WITH o AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN any_value(p) IS NULL THEN 0 ELSE 1 + count_if(l_linenumber <> 1 AND l_extendedprice > p) END AS target_rank FROM lineitem JOIN o USING (l_orderkey) GROUP BY l_orderkey")
def label_rank(s: SparkSession, d: str) -> DataFrame:
    return retrieval.label_rank(read(s, d, "lineitem"), "l_orderkey", "l_extendedprice", F.col("l_linenumber") == 1)


@query(f"WITH {EV} SELECT event_id, CASE domain WHEN 0 THEN 32.0 WHEN 3 THEN 2.0 WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM ev")
def supervision_weights(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", ranking.domain_weights(F.col("id"), {0: 32.0, 3: 2.0}, F.col("domain"), [0, 1, 2, 3]).alias("weight"))


@query(f"WITH {EV}, w AS (SELECT *, CASE WHEN domain = 1 THEN 0 ELSE value END AS w FROM ev), n AS (SELECT *, coalesce(max((w <> 0)::INT) OVER ({USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM w) SELECT event_id, CASE WHEN later = 1 THEN 0 ELSE w END::DOUBLE AS w FROM n")
def keep_last_supervised(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).withColumn("w", F.when(F.col("domain") == 1, 0.0).otherwise(F.col("value")))
    return sequences.keep_last_nonzero(rows, "user_id", ORDER, "w").select("event_id", "w")


# Monitoring --------------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_type, event_id, max(value) OVER w AS best, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, before IS NULL OR value > before AS improved FROM b)
SELECT event_type, event_id, best, improved, max(CASE WHEN improved THEN event_id END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best_at FROM i""")
def best_checkpoint(s: SparkSession, d: str) -> DataFrame:
    points = read(s, d, "events").select("event_type", "event_id", "value")
    return monitor.best_so_far(points, "event_type", "event_id", "value").select("event_type", "event_id", "best", "improved", "best_at")


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 1000 AS batch, value / (200 + user_id % 7 * 300) AS hr FROM events),
b AS (SELECT *, coalesce(max(hr) OVER (PARTITION BY user_id ORDER BY batch ROWS UNBOUNDED PRECEDING), 0) AS best FROM p)
SELECT user_id, batch, CASE WHEN batch >= 40000 THEN 'max_batches' WHEN batch < 10000 THEN NULL WHEN batch >= 12000 AND best < 0.145 THEN 'early_reject' WHEN best >= 0.1744 THEN NULL WHEN batch >= 20000 AND best < 0.1634 THEN 'reject' END AS reason FROM b""")
def early_stop(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    points = read(s, d, "events").select("user_id", (n * 1000).cast("long").alias("batch"), (F.col("value") / (200 + F.col("user_id") % 7 * 300)).alias("hr"))
    return monitor.early_stop(points, "user_id", "batch", "hr", 40_000).select("user_id", "batch", "reason")


@query("WITH r AS (SELECT user_id, avg((event_type <> 'error')::INT) AS o, avg((event_type = 'click')::INT) AS a FROM events GROUP BY user_id) SELECT user_id, round(0.4 * o + 0.6 * a, 6) AS score, o >= 0.58 AND a >= 0.2121 AS accepted FROM r")
def run_score(s: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    runs = read(s, d, "events").groupBy("user_id").agg(share(F.col("event_type") != "error").alias("o"), share(F.col("event_type") == "click").alias("a"))
    return monitor.scores(runs, "o", "a").select("user_id", r6("score").alias("score"), "accepted")


# Sequence labels ---------------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, n AS (SELECT event_id, id, lead(id) OVER ({USER}) AS label_id, lead(event_type) OVER ({USER}) AS label_type, lead(t) OVER ({USER}) AS label_t FROM ev) SELECT * FROM n WHERE label_id IS NOT NULL")
def next_event_labels(s: SparkSession, d: str) -> DataFrame:
    return sequences.next_labels(events(s, d), "user_id", ORDER, {"id": "label_id", "event_type": "label_type", "t": "label_t"}).select("event_id", "id", "label_id", "label_type", "label_t")


@query(f"WITH {EV} SELECT event_id, coalesce(first_value(CASE WHEN positive THEN id END IGNORE NULLS) OVER ({USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS label FROM ev")
def next_positive_labels(s: SparkSession, d: str) -> DataFrame:
    return sequences.next_positive(events(s, d), "user_id", ORDER, "id", F.col("positive")).select("event_id", "label")


@query(f"WITH {EV}, n AS (SELECT *, coalesce(max(positive::INT) OVER (PARTITION BY user_id, k ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS again FROM ev) SELECT event_id, CASE WHEN again AND {h60('5', 'user_id')} % 1000000 < 500000 THEN -1 ELSE id END AS id FROM n")
def mask_future_positive(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.positive_later(events(s, d), "user_id", ORDER, "k", F.col("positive"))
    masked = F.col("again") & (X.unit_hash(5, F.col("user_id")) < 0.5)
    return rows.select("event_id", F.when(masked, -1).otherwise(F.col("id")).alias("id"))


@query(f"WITH {EV}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS b FROM ev) SELECT event_id, user_id FROM n WHERE b <= 10")
def truncate_last_n(s: SparkSession, d: str) -> DataFrame:
    return sequences.tail(events(s, d), "user_id", ORDER, 10).select("event_id", "user_id")


_SEQ = f"{EV}, q AS (SELECT user_id, list(id ORDER BY t, event_id) AS ids, list(event_type ORDER BY t, event_id) AS types, list(positive::INT ORDER BY t, event_id) AS acts, list(t ORDER BY t, event_id) AS ts FROM ev GROUP BY user_id)"


def _seq(s: SparkSession, d: str, last: int | None = None) -> DataFrame:
    """Each user's events as arrays; only the last ones, cut before they meet in an array, where no more is needed."""
    rows = events(s, d).withColumn("act", F.col("positive").cast("int"))
    rows = rows if last is None else sequences.tail(rows, "user_id", ORDER, last)
    return sequences.collect(rows, "user_id", ORDER, ["id", "event_type", "act", "t"]).withColumnsRenamed({"id": "ids", "event_type": "types", "act": "acts", "t": "ts"})


@query(f"WITH {_SEQ}, x AS (SELECT user_id, ids[1:len(ids)-1] AS i, ids[2:] AS l FROM q) SELECT user_id, least(len(i), 50)::INT AS length, array_to_string((i[greatest(len(i)-49, 1):] || list_transform(range(50), lambda v: 0::BIGINT))[1:50], ',') AS input_ids, array_to_string((l[greatest(len(l)-49, 1):] || list_transform(range(50), lambda v: 0::BIGINT))[1:50], ',') AS label FROM x")
def pad_truncate(s: SparkSession, d: str) -> DataFrame:
    inputs, labels, n = sequences.next_event_example(F.col("ids"), 50)
    return _seq(s, d, 51).select("user_id", n.alias("length"), csv(inputs).alias("input_ids"), csv(labels).alias("label"))


@query(f"WITH {EV}, n AS (SELECT user_id, t, event_id, CASE WHEN lead(positive) OVER ({USER}) THEN lead(id) OVER ({USER}) ELSE 0 END AS l FROM ev) SELECT user_id, string_agg(l::VARCHAR, ',' ORDER BY t, event_id) AS labels FROM n GROUP BY user_id")
def conditional_labels(s: SparkSession, d: str) -> DataFrame:
    return _seq(s, d).select("user_id", csv(A.conditional_labels(F.col("ids"), F.col("acts"))).alias("labels"))


@query(f"WITH {_SEQ} SELECT user_id, array_to_string(ids[greatest(len(ids)-19, 1):], ',') AS forward, array_to_string(list_reverse(ids)[1:20], ',') AS backward FROM q")
def chronological_toggle(s: SparkSession, d: str) -> DataFrame:
    ids = F.col("ids")
    return _seq(s, d, 20).select("user_id", csv(sequences.chronological(ids, 20)).alias("forward"), csv(sequences.chronological(ids, 20, False)).alias("backward"))


@query(f"WITH {_SEQ} SELECT count(*) AS n, count_if(len(ids) <> len(types) OR len(ids) <> len(ts)) AS n_mismatched FROM q")
def array_len_check(s: SparkSession, d: str) -> DataFrame:
    off = (F.size("ids") != F.size("types")) | (F.size("ids") != F.size("ts"))
    return _seq(s, d).agg(F.count("*").alias("n"), F.count_if(off).alias("n_mismatched"))


@query(f"WITH {_SEQ} SELECT user_id, ids[len(ids)] AS label_id, types[len(ids)] AS label_type FROM q")
def last_item_label(s: SparkSession, d: str) -> DataFrame:
    last = F.size("ids") - 1
    return _seq(s, d, 1).select("user_id", F.get("ids", last).alias("label_id"), F.get("types", last).alias("label_type"))


@query(f"WITH {_SEQ} SELECT user_id, array_to_string(ids[1:len(ids)-1], ',') AS input_ids, ids[len(ids)] AS label FROM q WHERE acts[len(acts)] > 0")
def eval_examples(s: SparkSession, d: str) -> DataFrame:
    return _seq(s, d).where(F.try_element_at("acts", F.lit(-1)) > 0).select("user_id", csv(A.all_but_last(F.col("ids"))).alias("input_ids"), F.try_element_at("ids", F.lit(-1)).alias("label"))


@query(f"WITH {_SEQ}, c AS (SELECT *, coalesce(list_max(list_transform(acts, lambda a, i: CASE WHEN a > 0 THEN i ELSE 0 END)), 0) AS cut FROM q) SELECT user_id, cut::INT AS n, array_to_string(ids[1:cut], ',') AS ids, array_to_string(types[1:cut], ',') AS types FROM c")
def truncate_to_last_positive(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.cut_to_last_positive(_seq(s, d), "types", STREAM.positives(), ["ids", "types"])
    return rows.select("user_id", F.size("ids").alias("n"), csv("ids").alias("ids"), F.array_join("types", ",").alias("types"))


@query(f"WITH {_SEQ}, p AS (SELECT user_id, len(ts) AS n, ts, ts[len(ts)] + 60 AS target FROM q) SELECT user_id, array_to_string(list_transform(ts || [0], lambda x, i: CASE WHEN i = n THEN target ELSE x END), ',') AS times FROM p")
def append_target_slot(s: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return _seq(s, d).select("user_id", csv(A.append_at(ts, F.size(ts) - 1, F.try_element_at(ts, F.lit(-1)) + 60)).alias("times"))


@query(f"WITH {EV}, g AS (SELECT event_id, lead(t) OVER ({USER}) - t AS gap FROM ev) SELECT event_id, least(greatest(floor(ln(greatest(abs(gap), 1)::DOUBLE) / 0.301), 0), 128)::BIGINT AS bucket FROM g WHERE gap IS NOT NULL")
def time_gap_buckets(s: SparkSession, d: str) -> DataFrame:
    gap = F.lead("t").over(Window.partitionBy("user_id").orderBy(*ORDER)) - F.col("t")
    return events(s, d).withColumn("gap", gap).where("gap is not null").select("event_id", sequences.gap_bucket(F.col("gap")).alias("bucket"))


@query(f"WITH {_SEQ} SELECT user_id, array_to_string(ids[1:greatest(len(ids)-2, 0)], ',') AS ids FROM q")
def leave_last_n_out(s: SparkSession, d: str) -> DataFrame:
    return _seq(s, d).select("user_id", csv(A.all_but_last(F.col("ids"), 2)).alias("ids"))


# Sampling and splits -----------------------------------------------------------------------------------------------------


@query(f"WITH u AS (SELECT user_id, count_if(event_type = 'click') AS clicks FROM events GROUP BY user_id), e AS (SELECT user_id FROM u WHERE clicks >= 5 ORDER BY {h60('7', 'user_id')}, user_id LIMIT 20) SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM e) THEN 'eval' ELSE 'train' END AS split FROM u")
def split_users(s: SparkSession, d: str) -> DataFrame:
    users = read(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"))
    return sampling.eval_users(users, "user_id", F.col("clicks") >= 5, 20, 7).select("user_id", "split")


@query(f"WITH u AS (SELECT user_id, user_id % 4 AS chunk, count_if(event_type = 'click') AS clicks FROM events GROUP BY user_id), e AS (SELECT user_id, chunk, row_number() OVER (ORDER BY chunk, {h60('9', 'user_id')}, user_id) AS i FROM u WHERE clicks >= 5) SELECT user_id, chunk FROM e WHERE i <= 60")
def chunked_eval_sample(s: SparkSession, d: str) -> DataFrame:
    users = read(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"))
    return sampling.eval_users_by_chunk(users, "user_id", F.col("user_id") % 4, F.col("clicks") >= 5, 60, 9)


@query(f"WITH u AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS pos, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 5) SELECT o_custkey, CASE WHEN NOT pos OR {h60('42', 'o_custkey')} % 1000000 < 950000 THEN 'train' ELSE 'eval' END AS split FROM u")
def train_eval_split(s: SparkSession, d: str) -> DataFrame:
    users = read(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("pos"), F.count("*").alias("n")).where("n >= 5")
    return sampling.hash_split(users, "o_custkey", 0.95, 42, F.col("pos")).select("o_custkey", "split")


@query("SELECT DISTINCT user_id, CASE WHEN user_id <= 0.9 * (SELECT count(DISTINCT user_id) FROM events) THEN 'train' ELSE 'test' END AS split FROM events")
def split_by_user_id(s: SparkSession, d: str) -> DataFrame:
    return ratings.split_by_share(read(s, d, "events").select("user_id").distinct(), "user_id", 0.9)


@query(f"SELECT event_id FROM events WHERE {h60('3', 'user_id', 'event_id')} % 1000000 < 300000")
def positional_sampling(s: SparkSession, d: str) -> DataFrame:
    return sampling.positional(read(s, d, "events"), 3, ["user_id", "event_id"], 0.3).select("event_id")


@query(
    f"""WITH {EV}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS back FROM ev), w AS (SELECT *, count(*) OVER (PARTITION BY user_id) - 1 AS n FROM b WHERE back <= 31),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, back = 1 ORDER BY {h60('11', 'user_id', 't', 'event_id')}, t, event_id) AS i FROM w) SELECT event_id, user_id FROM c WHERE back = 1 OR i <= greatest(ceil(n * 0.4::DOUBLE), 1)"""
)
def history_dropout(s: SparkSession, d: str) -> DataFrame:
    return sequences.sample_history(events(s, d), "user_id", ORDER, 0.4, 30, 11).select("event_id", "user_id")


@query(f"SELECT event_id, row_number() OVER (ORDER BY {h60('1', 'event_id')}, event_id) AS place FROM events")
def deterministic_shuffle(s: SparkSession, d: str) -> DataFrame:
    # the place is made explicit here to compare it; sampling.shuffled alone sorts by range without one task
    rows = sampling.shuffled(read(s, d, "events").select("event_id"), 1, "event_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(X.hash60(1, F.col("event_id")), "event_id")).cast("long"))


@query("SELECT event_id FROM events WHERE event_id % 4 = 2")
def modulo_shard(s: SparkSession, d: str) -> DataFrame:
    return sampling.owned(read(s, d, "events"), "event_id", 4, 2).select("event_id")


@query("SELECT event_id, event_id % 8 AS shard FROM events")
def shard_rotation(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id", sampling.rotated_shard(F.col("event_id"), 8).alias("shard"))


@query("SELECT p_partkey // 64 AS shard, min(p_partkey) AS first_id, max(p_partkey) AS last_id, count(*) AS n FROM part GROUP BY shard HAVING count(*) >= 10")
def shard_plan(s: SparkSession, d: str) -> DataFrame:
    return retrieval.shard_plan(read(s, d, "part"), "p_partkey", 64, 10)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 640")
def limit_batches(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id").orderBy("event_id").limit(10 * 64)


@query(f"WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS n FROM part), a AS (SELECT event_id, j, {h60('13', 'event_id', 'j')} % (SELECT count(*) FROM part) AS idx FROM events, range(0, 2) r(j)) SELECT event_id, j::INT AS j, p_partkey AS negative FROM a JOIN p USING (idx)")
def uniform_negatives(s: SparkSession, d: str) -> DataFrame:
    return sampling.uniform_negatives(read(s, d, "events").select("event_id"), ["event_id"], read(s, d, "part").select("p_partkey"), "p_partkey", 2, 13)


_POOL = f"{EV}, p AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY domain) AS n FROM (SELECT DISTINCT domain, id FROM ev))"


@query(f"WITH {_POOL}, a AS (SELECT domain, j, {h60('19', 'domain', 'j')} % n AS idx FROM (SELECT DISTINCT domain, n FROM p), range(0, 5) r(j)) SELECT domain::INT AS domain, j::INT AS j, id AS negative FROM a JOIN p USING (domain, idx)")
def domain_negatives(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return sampling.domain_negatives(e, e.select("domain", "id"), "id", 5, 19)


_BATCH = f"""{EV}, b AS (SELECT event_id // 64 AS batch, event_id % 64 AS place, user_id, id FROM ev), z AS (SELECT batch, count(*) AS n FROM b GROUP BY batch),
asks AS (SELECT b.*, j, a, {h60('23', 'batch', 'place', 'j', 'a')} % n AS q FROM b JOIN z USING (batch), range(0, 3) r(j), range(0, 4) x(a)),
tried AS (SELECT k.batch, k.place, k.j, arg_min(m.id, k.a) AS negative FROM asks k JOIN b m ON m.batch = k.batch AND m.place = k.q WHERE m.user_id <> k.user_id AND m.id <> k.id GROUP BY ALL),
rest AS (SELECT DISTINCT batch, place, user_id, id, j FROM asks ANTI JOIN tried USING (batch, place, j)),
got AS (SELECT * FROM tried UNION ALL SELECT k.batch, k.place, k.j, arg_min(m.id, ({h60('23', 'k.batch', 'k.place', 'k.j', chr(39) + 'rest' + chr(39), 'm.place')}, m.place)) AS negative
  FROM rest k JOIN b m ON m.batch = k.batch WHERE m.user_id <> k.user_id AND m.id <> k.id GROUP BY ALL)"""


def _batches(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return events(s, d).select(F.floor(k / 64).alias("batch"), F.pmod(k, F.lit(64)).alias("place"), "user_id", "id")


@query(f"WITH {_BATCH} SELECT batch, place, j::INT AS j, negative FROM got")
def inbatch_negatives(s: SparkSession, d: str) -> DataFrame:
    return sampling.in_batch_negatives(_batches(s, d), "batch", "place", "user_id", "id", 3, 23)


@query(
    f"""WITH {_BATCH}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM ev)),
u AS (SELECT batch, place, j, {h60('29', 'batch', 'place', 'j')} % (SELECT count(*) FROM p) AS idx FROM b, range(0, 3) r(j))
SELECT batch, place, j::INT AS j, negative FROM got WHERE j < 1 UNION ALL SELECT batch, place, (j + 1)::INT, id FROM u JOIN p USING (idx) WHERE j < 2"""
)
def hybrid_negatives(s: SparkSession, d: str) -> DataFrame:
    rows = _batches(s, d)
    own = sampling.in_batch_negatives(rows, "batch", "place", "user_id", "id", 3, 23)
    rest = sampling.uniform_negatives(rows.select("batch", "place"), ["batch", "place"], rows.select("id"), "id", 3, 29)
    return sampling.hybrid(own, rest, ["batch", "place"], 3, 0.5)


# Text --------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderpriority || ' ' || o_orderstatus END AS text FROM orders")
def event_text(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("o_orderkey", X.event_text(F.col("texts"), F.col("o_orderstatus")).alias("text"))


_HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')"


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_HOST} ELSE 'Page ' || page_id || ' ' || {_HOST} END AS text FROM pages")
def event_text_v2(s: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("page_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Page "), F.col("page_id").cast("string"), F.lit("\t")))
    return read(s, d, "pages").select("page_id", X.event_text_v2(title, F.col("url"), F.lit("UNK")).alias("text"))


@query(f"SELECT page_id, {_HOST} AS domain FROM pages")
def url_to_domain(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pages").select("page_id", X.url_to_domain(F.col("url")).alias("domain"))


@query("SELECT c_custkey, c_name AS title FROM customer")
def normalize_title(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_custkey", X.normalize_title(F.concat(F.lit(" \t"), "c_name", F.lit("\n "))).alias("title"))


@query(
    """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, concat_ws(' ', host, nullif(array_to_string(list_filter(regexp_split_to_array(url_decode(path), '[-/\\s_]+'), lambda w: length(w) BETWEEN 1 AND 31), ' '), '')) AS text FROM u"""
)
def normalize_url(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("text"))


@query("SELECT o_orderkey, o_orderpriority || ' [SEP] ' || o_orderstatus AS prompt, 'Title: ' || o_orderpriority || ' </s> URL: ' || o_orderstatus AS labelled FROM orders")
def prompt_text(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_orderpriority"), F.col("o_orderstatus")
    return read(s, d, "orders").select("o_orderkey", X.prompt_text(a, b).alias("prompt"), X.prompt_text(a, b, "labelled").alias("labelled"))


@query("WITH q AS (SELECT o_custkey, list(o_orderpriority || ' [SEP] ' || o_orderstatus ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string((p[greatest(len(p)-4, 1):] || ['', '', '', '', ''])[1:5], '|') AS prompts FROM q")
def user_prompts(s: SparkSession, d: str) -> DataFrame:
    rows = sequences.collect(read(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_orderstatus"])
    prompts = F.zip_with("o_orderpriority", "o_orderstatus", lambda a, b: X.prompt_text(a, b))
    padded = F.slice(F.concat(A.last_n(prompts, 5), F.array_repeat(F.lit(""), 5)), 1, 5)
    return rows.select("o_custkey", F.array_join(padded, "|").alias("prompts"))


@query("SELECT c_custkey, (20 + (('0x' || md5(c_name))::UHUGEINT % 499980))::BIGINT AS item_id FROM customer")
def hash_item_id(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_custkey", X.hash_item_id(F.col("c_name")).alias("item_id"))


@query("SELECT o_orderkey, year(o_orderdate)::VARCHAR AS year, 'Order ' || o_orderkey AS title FROM orders")
def title_year(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit(")"))
    year, title = X.title_year(name)
    return read(s, d, "orders").select("o_orderkey", year.alias("year"), title.alias("title"))


@query("SELECT p_partkey, array_to_string(list_transform(str_split(p_name, ' '), lambda w: ('0x' || substr(md5(w), 1, 15))::BIGINT % 511), ',') AS features FROM part")
def feature_hashing(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select("p_partkey", csv(X.hashed_features(F.col("p_name"), " ", 511)).alias("features"))


@query(f"WITH {_SEQ} SELECT user_id, array_to_string(ids, ',') AS csv FROM q")
def seq_to_csv(s: SparkSession, d: str) -> DataFrame:
    return _seq(s, d).select("user_id", csv("ids").alias("csv"))


@query(f"WITH {_SEQ} SELECT user_id, len(ids)::INT AS n, list_sum(ids)::BIGINT AS total FROM q")
def csv_to_seq(s: SparkSession, d: str) -> DataFrame:
    back = seq_to_csv(s, d).withColumn("x", X.csv_to_numbers(F.col("csv")))
    return back.select("user_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


# Vectors -----------------------------------------------------------------------------------------------------------------

_N = "sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query(f"SELECT vec_id, (unnest(range(len(embedding))))::INT AS pos, round(unnest(list_transform(embedding::DOUBLE[], lambda v: v / greatest({_N}, 1e-6))), 6) AS v FROM embeddings")
def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", F.posexplode(A.l2_normalize(F.col("embedding"))).alias("pos", "v")).withColumn("v", r6("v"))


@query("WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), y AS (SELECT vec_id, e, m, list_avg(list_transform(e, lambda v: (v - m) * (v - m))) AS s FROM x) SELECT vec_id, (unnest(range(len(e))))::INT AS pos, round(unnest(list_transform(e, lambda v: (v - m) / sqrt(s + 1e-6))), 6) AS v FROM y")
def layer_norm(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", F.posexplode(A.layer_norm(F.col("embedding"))).alias("pos", "v")).withColumn("v", r6("v"))


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / greatest(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-12), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pairwise_cosine(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", r6(A.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


_ASK = "q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label), sc AS (SELECT q.query_id, c.vec_id AS item_id, list_inner_product(e.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score, c.label FROM q JOIN embeddings e ON e.vec_id = q.query_id, embeddings c)"


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query set is the first vector of each label; candidates are all vectors."""
    e = read(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("id"), F.min_by("embedding", "vec_id").alias("v"))
    return first.select("id", "v"), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(f"WITH {_ASK}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc) SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 100")
def mips_topk(s: SparkSession, d: str) -> DataFrame:
    queries, items = _asked(s, d)
    return retrieval.topk("brute_force", queries, items, 100).select("query_id", "item_id", "rank")


@query(f"WITH {_ASK}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS i FROM sc), r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p WHERE i <= 50) SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 50")
def sharded_topk(s: SparkSession, d: str) -> DataFrame:
    queries, items = _asked(s, d)
    return retrieval.topk("sharded", queries, items, "label", 50).select("query_id", "item_id", "rank")


@query(f"WITH {_ASK}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE item_id % 50 <> 0) SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 50")
def topk_exclude_seen(s: SparkSession, d: str) -> DataFrame:
    queries, items = _asked(s, d)
    seen = queries.select(F.col("id").alias("query_id")).crossJoin(items.where("id % 50 = 0").select(F.col("id").alias("item_id")))
    return retrieval.topk_unseen(queries, items, seen, 50).select("query_id", "item_id", "rank")


@query("WITH x AS (SELECT vec_id // 48 AS shard, vec_id % 48 AS row_id, embedding FROM embeddings), e AS (SELECT DISTINCT shard, r AS row_id FROM x, range(0, 48) t(r)) SELECT e.shard, e.row_id::INT AS row_id, coalesce(round(x.embedding[1]::DOUBLE, 6), 0) AS first_value FROM e LEFT JOIN x USING (shard, row_id)")
def dense_shard(s: SparkSession, d: str) -> DataFrame:
    shard, row = retrieval.shard_of(F.col("vec_id"), 48)
    held = read(s, d, "embeddings").select(shard.alias("shard"), row.cast("int").alias("row_id"), "embedding")
    return retrieval.dense(held, "shard", "row_id", "embedding", 64, 48).select("shard", "row_id", r6(F.get("embedding", F.lit(0)).cast("double")).alias("first_value"))


@query(
    """WITH q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pair AS (SELECT q.query_id, c.vec_id AS item_id, list_transform(range(1, 5), lambda p: exp(a.v[p] + c.v[p])) AS g,
  list_transform(range(1, 5), lambda p: list_inner_product(a.v[5 + (p - 1) * 15:4 + p * 15], c.v[5 + (p - 1) * 15:4 + p * 15])) AS dots FROM q JOIN e a ON a.vec_id = q.query_id, e c),
sc AS (SELECT query_id, item_id, list_inner_product(g, dots) / list_sum(g) AS score FROM pair), r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc)
SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 30"""
)
def mixture_topk(s: SparkSession, d: str) -> DataFrame:
    queries, items = _asked(s, d)
    return retrieval.topk("mixture", queries, items, 30, 4).select("query_id", "item_id", "rank")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -label ELSE label END AS label FROM embeddings")
def partial_shard_merge(s: SparkSession, d: str) -> DataFrame:
    old = read(s, d, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 4 = 0").withColumn("label", -F.col("label"))
    return retrieval.latest(old, new, ["vec_id"])


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding::DOUBLE[], lambda v: format('{:.6g}', v)), ' ') AS text FROM embeddings")
def embedding_text(s: SparkSession, d: str) -> DataFrame:
    return retrieval.as_text(read(s, d, "embeddings"), "vec_id", "embedding")
