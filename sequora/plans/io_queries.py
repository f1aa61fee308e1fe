"""Queries that write a table in each output form and read it back in the matching input form."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.functions import text as X
from sequora.operators import clean, ranking, retrieval, sampling, vocab
from sequora.operators.taxonomy import FIVE_DOMAINS
from sequora.plans.pipeline import event_pipeline
from sequora.plans.queries import ORDER, csv, r6
from sequora.plans.registry import Registry, query
from sequora.plans.tables import EV, RANK, events, h60, rank_of, read
from sequora.sources import readers, writers
from sequora.streaming import incremental

_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; where that is unset and all runs in one process, in a local one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sequora-io-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        folder = f"file://{_OWN[0]}"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _lines(s: SparkSession, d: str) -> DataFrame:
    """One line of the text log for each user, and the user."""
    one = F.struct(F.col("event_type").alias("Type"), F.array("text", F.lit("u")).alias("Texts"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"))
    rows = events(s, d).groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("json"))
    return rows.select("user_id", F.concat_ws("\t", F.col("user_id").cast("string"), "json").alias("line"))


_LOG = f"WITH {EV} SELECT user_id, event_type, text, strftime(ts, '%Y-%m-%d %H:%M') AS minute, (floor(epoch(ts) / 60)::BIGINT * 60) AS seconds FROM ev"


def _logged(rows: DataFrame) -> DataFrame:
    e = rows.where("not bad").select(F.col("uid").cast("long").alias("user_id"), F.explode("events").alias("e"))
    return e.select("user_id", F.col("e.Type").alias("event_type"), F.get("e.Texts", F.lit(0)).alias("text"), F.col("e.time").alias("minute"), X.parse_minute(F.col("e.time")).alias("seconds"))


@query(_LOG)
def log_scan(s: SparkSession, d: str) -> DataFrame:
    """A text log with a header in each file, lines without a tab and malformed JSON among the others."""
    path = scratch(s, "log")
    odd = s.createDataFrame([("no tab here",), ("7\t[broken",)], "line string")
    writers.log_lines(_lines(s, d).select("line").unionByName(odd), "line", path)
    return _logged(readers.log(s, path))


@query(f"WITH {EV}, u AS (SELECT user_id, user_id % 3 AS c, count(*) AS n FROM ev GROUP BY ALL) SELECT 'train_chunk_' || c || '.tsv' AS chunk, count(*) AS n_users, sum(n)::BIGINT AS n_events FROM u GROUP BY c")
def chunk_parts(s: SparkSession, d: str) -> DataFrame:
    """Chunk files, each made into a part of a Parquet table of its own."""
    path, lines = scratch(s, "chunks"), _lines(s, d)
    for c in range(3):
        writers.single_file(s, lambda to, c=c: writers.log_lines(lines.where(F.col("user_id") % 3 == c).select("line").coalesce(1), "line", to), f"{path}/in/train_chunk_{c}.tsv")
    writers.parquet(readers.chunks(s, f"{path}/in").withColumn("n", F.size("events")), f"{path}/out", by=["chunk"])
    back = s.read.parquet(f"{path}/out")
    return back.groupBy("chunk").agg(F.count("*").alias("n_users"), F.sum("n").cast("long").alias("n_events"))


@query("SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment, round(c_acctbal, 2) AS balance FROM customer")
def delimited_scan(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "delimited")
    writers.delimited(read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2)), path, "::")
    return readers.delimited(s, path, "user_id long, name string, segment string, balance double")


@query("SELECT p_partkey AS item_id, p_brand AS brand, p_size::INT AS size FROM part")
def renamed_csv_scan(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "csv")
    read(s, d, "part").select("p_partkey", "p_brand", "p_size").write.option("header", True).csv(path)
    return readers.renamed_csv(s, path, "p_partkey long, p_brand string, p_size int", {"p_partkey": "item_id", "p_brand": "brand", "p_size": "size"})


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey::INT AS nation FROM supplier")
def headerless_csv_scan(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "csv")
    read(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.csv(path)
    return readers.delimited(s, path, "id long, name string, nation int", ",", "utf-8")


_ROWS = "(vec_id // 100)::BIGINT AS shard, (vec_id % 100)::BIGINT AS row, round(embedding[1]::DOUBLE, 6) AS first_value, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    shard, row = retrieval.shard_of(F.col("vec_id"), 100)
    return read(s, d, "embeddings").select(shard.alias("shard"), row.alias("row"), "embedding")


def _read_back(rows: DataFrame) -> DataFrame:
    shard = F.regexp_extract("path", r"shard_([0-9]+)\.npy", 1).cast("long")
    rows = rows.select(shard.alias("shard"), "row", F.get("values", F.lit(0)).alias("first"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("sum"))
    signed = lambda rounded, x: F.when(rounded == 0, x * 0.0).otherwise(rounded)  # noqa: E731  (SQL's round keeps the sign of zero)
    return rows.select("shard", "row", signed(r6("first"), F.col("first")).alias("first_value"), signed(F.round("sum", 4), F.col("sum")).alias("total"))


@query(f"SELECT {_ROWS} FROM embeddings")
def npy_shards(s: SparkSession, d: str) -> DataFrame:
    """Embedding shards as .npy files, read whole."""
    path = scratch(s, "npy")
    writers.npy_shards(_vectors(s, d), path, "shard", "row", "embedding", 64, dtype="float32")
    return _read_back(readers.arrays(s, path))


@query(f"SELECT {_ROWS} FROM embeddings")
def npy_row_ranges(s: SparkSession, d: str) -> DataFrame:
    """The same files read by ranges of rows, several to a file, however large a file is."""
    path = scratch(s, "npy")
    writers.npy_shards(_vectors(s, d), path, "shard", "row", "embedding", 64, dtype="float32")
    return _read_back(readers.npy_rows(s, path, rows=30))


@query(f"SELECT user_id::VARCHAR AS user_id, event_type AS target_type, ({RANK})::INT AS target_rank, 10 AS top_k FROM events")
def rank_record_files(s: SparkSession, d: str) -> DataFrame:
    """Rank records, appended in two writes and read back."""
    path, e = scratch(s, "ranks"), read(s, d, "events")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("target_type"), rank_of(F.col("event_id")).cast("int").alias("target_rank"), F.lit(10).alias("top_k"))
    for half in (0, 1):
        writers.append_records(rows.where(F.col("event_id") % 2 == half).drop("event_id"), path)
    return readers.rank_records(s, path)


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def report_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "report")
    rows = read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    writers.report(rows, path)
    return readers.metadata(s, path, multi_line=False).select("event_type", "n", "mean_value")


@query("SELECT count(*) AS n, 'orders' AS name, max(o_orderkey) AS top FROM orders")
def metadata_file(s: SparkSession, d: str) -> DataFrame:
    """One JSON object over several lines."""
    path = scratch(s, "metadata")
    row = read(s, d, "orders").agg(F.count("*").alias("n"), F.lit("orders").alias("name"), F.max("o_orderkey").alias("top"))
    text = row.select(F.to_json(F.struct("n", "name", "top"), {"pretty": "true"}).alias("value"))
    text.coalesce(1).write.text(path)
    return readers.metadata(s, path).select("n", "name", "top")


@query("SELECT 'events' AS name, true AS found UNION ALL SELECT 'nothing', false")
def existence_probe(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(n, readers.exists(s, f"{d}/{n}.parquet")) for n in ("events", "nothing")], "name string, found boolean")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 2::BIGINT AS n_files FROM orders")
def parquet_coalesced(s: SparkSession, d: str) -> DataFrame:
    """An overwritten table in so many files."""
    path, rows = scratch(s, "parquet"), read(s, d, "orders").select("o_orderkey")
    writers.parquet(rows.limit(3), path)
    writers.parquet(rows.repartition(4), path, files=2)
    back = s.read.parquet(path)
    return back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("_metadata.file_name").alias("n_files"))


@query("WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT least(i // (n // 7), 6)::BIGINT AS part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM x GROUP BY ALL")
def parquet_row_ranges(s: SparkSession, d: str) -> DataFrame:
    """Seven files of equal row ranges; the last takes the remainder."""
    path = scratch(s, "ranges")
    writers.row_ranges(read(s, d, "orders").select("o_orderkey"), path, "o_orderkey", 7)
    return s.read.parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT ('1' || repeat('0', length(max(o_orderkey)::VARCHAR)))::BIGINT AS domain_offset FROM orders")
def offset_tsv(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "offset")
    writers.one_row_tsv(read(s, d, "orders").agg(vocab.smallest_offset(F.max("o_orderkey")).alias("domain_offset")), path)
    return readers.delimited(s, path, "domain_offset long", "\t", "utf-8", header=True)


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding::DOUBLE[], lambda v: format('{:.6g}', v)), ' ') AS text FROM embeddings")
def embeddings_tsv(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "embeddings")
    writers.embeddings_tsv(read(s, d, "embeddings"), path, "vec_id", "embedding")
    return readers.delimited(s, path, "id long, text string", "\t", "utf-8")


@query(f"WITH {EV} SELECT user_id, string_agg(id::VARCHAR, ',' ORDER BY t, event_id) AS ids FROM ev GROUP BY user_id")
def sequences_csv(s: SparkSession, d: str) -> DataFrame:
    from sequora.operators import sequences

    path = scratch(s, "sequences")
    rows = sequences.collect(events(s, d), "user_id", ORDER, ["id"]).withColumnRenamed("id", "ids")
    writers.sequences_csv(rows, path, "user_id", ["ids"])
    return s.read.schema("user_id long, ids string").option("header", True).csv(path).select("user_id", csv(X.csv_to_numbers(F.col("ids"))).alias("ids"))


@query(f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS n_unsorted, true AS finished FROM ev")
def sorted_intermediate(s: SparkSession, d: str) -> DataFrame:
    """Rows sorted by user and time, written once and read in that order; the write is complete or absent."""
    path = scratch(s, "sorted")
    writers.sorted_parquet(events(s, d).select("user_id", *ORDER), path, ["user_id", *ORDER])
    from pyspark.sql import Window

    back = s.read.parquet(path).select("*", F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    w = Window.partitionBy("f", "b").orderBy("i")
    now, last = F.struct("user_id", *ORDER), F.lag(F.struct("user_id", *ORDER)).over(w)
    return back.withColumn("off", last > now).agg(F.count("*").alias("n"), F.count_if("off").alias("n_unsorted")).withColumn("finished", F.lit(writers.finished(s, path)))


_SYNTH = f"WITH u AS (SELECT user_id::BIGINT AS user_id, ({h60('0', 'user_id', chr(39) + 'n' + chr(39))} % 191 + 10)::INT AS n FROM range(0, 50) r(user_id)), i AS (SELECT user_id, n, unnest(range(1, n + 1)) AS i FROM u)"


@query(f"{_SYNTH} SELECT user_id, i::INT - 1 AS pos, (CASE WHEN i = n THEN 0 ELSE {h60('0', 'user_id', 'i', chr(39) + 'd' + chr(39))} % 4 END * 1000000000 + {h60('0', 'user_id', 'i', chr(39) + 'i' + chr(39))} % 1000 + 20)::BIGINT AS id, i::BIGINT * 60 + 1700000000 AS t FROM i")
def synthetic_sequences(s: SparkSession, d: str) -> DataFrame:
    rows = readers.synthetic_sequences(s, 50)
    both = rows.select("user_id", F.posexplode(F.arrays_zip(F.col("encoded_ids").alias("id"), F.col("timestamps_unix").alias("t"))).alias("pos", "x"))
    return both.select("user_id", "pos", F.col("x.id").alias("id"), F.col("x.t").alias("t"))


@query(
    f"WITH x AS (SELECT domain::INT AS domain_id, item::BIGINT AS item_id, j, 2 * ({h60('42', 'domain', 'item', 'j')} / 1152921504606846976.0::DOUBLE) - 1 AS v FROM range(0, 3) a(domain), range(0, 40) b(item), range(0, 16) c(j)) "
    "SELECT domain_id, item_id, round(max(CASE WHEN j = 0 THEN v END) / greatest(sqrt(sum(v * v)), 1e-6), 6) AS first_value, 1.0::DOUBLE AS length FROM x GROUP BY ALL"
)
def synthetic_embeddings(s: SparkSession, d: str) -> DataFrame:
    from sequora.functions import arrays as A

    return readers.synthetic_embeddings(s, 40, 16, 3).select("domain_id", "item_id", r6(F.get("embedding", F.lit(0))).alias("first_value"), r6(A.norm(F.col("embedding"))).alias("length"))


@query(f"WITH {EV}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS row, row_number() OVER (ORDER BY user_id, t, event_id) - 1 AS i FROM ev) SELECT i AS position, user_id AS file, row::INT AS row, event_id FROM n WHERE (i + 3) % 11 = 0")
def rows_by_position(s: SparkSession, d: str) -> DataFrame:
    """Rows by their number over many files (here users): file and row in it."""
    from pyspark.sql import Window

    e = events(s, d)
    rows = e.withColumn("row", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("int")).withColumnRenamed("user_id", "file")
    files = e.groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("n"))
    asked = s.range(8, e.count(), 11).withColumnRenamed("id", "position")
    return sampling.rows_at(asked, "position", rows, sampling.offsets(files, "file", "n"), "file", "row").select("position", "file", "row", "event_id")


@query("WITH c AS (SELECT p_partkey AS i, (p_size % 10) AS category FROM part) SELECT event_id, category + 1 AS category FROM (SELECT event_id, greatest(event_id % (SELECT count(*) FROM part) - 1, 0) AS place FROM events) e JOIN (SELECT row_number() OVER (ORDER BY i) - 1 AS place, category FROM c) x USING (place)")
def category_of_item(s: SparkSession, d: str) -> DataFrame:
    """Items by 1-based id (0, padding, as 1) to their category, which counts from 1."""
    parts = read(s, d, "part")
    n = parts.count()
    table = sampling.indexed(parts, "p_partkey").join(parts, "p_partkey").select(F.col("idx").alias("place"), (F.col("p_size") % 10).alias("category"))
    e = read(s, d, "events").select("event_id", (F.col("event_id") % n).alias("item"))
    return vocab.category(e, "item", table, "place", "category").select("event_id", "category")


_POOLS = f"""{EV}, p AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY domain) AS n FROM (SELECT DISTINCT domain, id FROM ev)),
w AS (SELECT * FROM (VALUES (0, 0, 0.0::DOUBLE, 0.75::DOUBLE), (0, 1, 0.75, 1.0), (1, 1, 0.0, 1.0), (2, 0, 0.0, 0.5), (2, 2, 0.5, 1.0)) v(domain, pool, low, high)),
a AS (SELECT DISTINCT domain, j, ({h60('31', 'domain', 'j', chr(39) + 'pool' + chr(39))} % 1000000) / 1000000.0::DOUBLE AS u FROM w, range(0, 8) r(j)),
b AS (SELECT a.domain, j, pool FROM a JOIN w ON a.domain = w.domain AND u >= low AND u < high),
c AS (SELECT b.*, {h60('31', 'b.domain', 'j', chr(39) + 'item' + chr(39))} % n AS idx FROM b JOIN (SELECT DISTINCT domain, n FROM p) p ON p.domain = pool)"""


@query(f"WITH {_POOLS} SELECT c.domain::INT AS domain, j::INT AS j, pool::INT AS pool, id AS negative FROM c JOIN p ON p.domain = pool AND p.idx = c.idx")
def pooled_negatives(s: SparkSession, d: str) -> DataFrame:
    """Negatives of each domain from pools of other domains, by weight."""
    e = events(s, d)
    return sampling.pooled_negatives({0: {0: 3.0, 1: 1.0}, 1: {1: 1.0}, 2: {0: 1.0, 2: 1.0}}, e.select("domain", "id"), "id", 8, 31)


_PAIRS = "x AS (SELECT (l_discount - 0.05) * 100.0::DOUBLE AS p, (l_tax - 0.04) * 50.0::DOUBLE AS n, l_quantity AS w, (l_suppkey <> l_partkey)::INT::DOUBLE AS ok FROM lineitem)"


@query(f"WITH {_PAIRS} SELECT round(sum(0.5 * w * ok * (greatest(p, 0) - p + ln(1 + exp(-abs(p))) + greatest(n, 0) + ln(1 + exp(-abs(n))))) / sum(w * ok), 6) AS loss FROM x")
def bce_pair_loss(s: SparkSession, d: str) -> DataFrame:
    """A positive and a sampled negative logit for each row; rows whose negative is the positive itself count nothing."""
    from sequora.functions import metrics as M

    p, n = (F.col("l_discount") - 0.05) * 100.0, (F.col("l_tax") - 0.04) * 50.0
    w = F.col("l_quantity") * (F.col("l_suppkey") != F.col("l_partkey")).cast("double")
    return ranking.weighted_mean(read(s, d, "lineitem"), M.bce_pair(p, n), w, "loss").withColumn("loss", r6("loss"))


@query("WITH x AS (SELECT [(p_size % 5)::DOUBLE, (p_size % 3)::DOUBLE, (p_size % 2)::DOUBLE] AS g FROM part), z AS (SELECT list_max(g) + ln(list_sum(list_transform(g, lambda v: exp(v - list_max(g))))) AS z FROM x) SELECT round(avg(z * z), 6) AS z_loss FROM z")
def router_z_loss(s: SparkSession, d: str) -> DataFrame:
    from sequora.functions import arrays as A

    g = F.array(*((F.col("p_size") % n).cast("double") for n in (5, 3, 2)))
    return read(s, d, "part").agg(r6(F.avg(F.pow(A.log_sum_exp(g), F.lit(2.0)))).alias("z_loss"))


@query(f"WITH {EV} SELECT event_id, grp IN ('Ad', 'Browsing') OR event_type = 'purchase' AS wanted FROM ev")
def union_of_type_groups(s: SparkSession, d: str) -> DataFrame:
    """Membership in the union of sets of types."""
    e = events(s, d)
    groups = e.where(F.col("grp").isin("Ad", "Browsing")).select("event_type").distinct()
    wanted = groups.unionByName(s.createDataFrame([("purchase",)], "event_type string")).distinct().withColumn("wanted", F.lit(True))
    return e.join(wanted, "event_type", "left").select("event_id", F.coalesce("wanted", F.lit(False)).alias("wanted"))


@query(f"WITH {EV}, q AS (SELECT user_id, event_id % 4 AS rank, list(id ORDER BY t, event_id) AS ids FROM ev GROUP BY ALL) SELECT user_id, sum(len(ids))::BIGINT AS n, max(len(ids))::BIGINT AS longest, sum(list_sum(ids))::BIGINT AS total FROM q GROUP BY user_id")
def gathered_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of different lengths from several ranks, padded to the longest, gathered, and trimmed to their lengths again."""
    from sequora.functions import arrays as A
    from sequora.operators import sequences

    e = events(s, d).withColumn("rank", F.col("event_id") % 4).withColumn("owner", F.struct("user_id", "rank"))
    rows = sequences.collect(e, "owner", ORDER, ["id"]).select("owner.user_id", "owner.rank", "id")
    parts = [rows.where(F.col("rank") == r) for r in range(4)]
    whole = A.gathered(parts, "id")
    return whole.groupBy("user_id").agg(F.sum(F.size("id")).cast("long").alias("n"), F.max(F.size("id")).cast("long").alias("longest"), F.sum(F.aggregate("id", F.lit(0).cast("long"), lambda a, v: a + v)).alias("total"))


@query(f"SELECT event_id, round(ln(event_id + 1), 6) AS natural, round(log10(event_id + 1), 6) AS decimal_, ceil(log10(event_id + 1))::BIGINT AS digits FROM events")
def logarithms(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") + 1
    return read(s, d, "events").select("event_id", r6(F.log(n)).alias("natural"), r6(F.log10(n)).alias("decimal_"), F.ceil(F.log10(n)).cast("long").alias("digits"))


@query("SELECT 'brute_force' AS name, true AS known UNION ALL SELECT 'sharded', true UNION ALL SELECT 'mixture', true UNION ALL SELECT 'other', false")
def registered_methods(s: SparkSession, d: str) -> DataFrame:
    """Operators by category and name; an unknown name is an error."""
    methods = Registry()
    few, options = s.createDataFrame([(1, [1.0, 1.0], 0)], "id long, v array<double>, shard int"), {"sharded": ("shard", 1), "mixture": (1, 1)}
    for name, f in retrieval.METHODS.items():
        methods.register("topk", name, f)

    def known(name: str) -> bool:
        try:
            retrieval.topk(name, few, few, *options.get(name, (1,)))
        except (KeyError, ValueError):
            return False
        return methods.has("topk", name)

    return s.createDataFrame([(n, known(n)) for n in ("brute_force", "sharded", "mixture", "other")], "name string, known boolean")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(s: SparkSession, d: str) -> DataFrame:
    """Windowed counts by Structured Streaming over all there is, each window's last state."""
    path = scratch(s, "stream")
    stream = s.readStream.schema(read(s, d, "events").schema).parquet(_folder(s, d, path))
    out = incremental.window_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return incremental.run_to_end(out, f"{path}/out", f"{path}/state", "complete")


@query(f"WITH {EV}, r AS (SELECT user_id, id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS back FROM ev) SELECT user_id, count(*)::INT AS n, string_agg(id::VARCHAR, ',' ORDER BY t, event_id) AS ids FROM r WHERE back <= 5 GROUP BY user_id")
def stream_latest_sequences(s: SparkSession, d: str) -> DataFrame:
    """Each user's last five events, kept as state by Structured Streaming."""
    path = scratch(s, "stream")
    writers.parquet(events(s, d).select("user_id", "t", "event_id", "id"), f"{path}/in")
    stream = s.readStream.schema("user_id long, t long, event_id long, id long").parquet(f"{path}/in")
    return incremental.run_to_end(incremental.latest_sequences(stream, 5).select("user_id", "n", "ids"), f"{path}/out", f"{path}/state", "update", ["user_id"])


def _folder(s: SparkSession, d: str, path: str) -> str:
    """The events as a folder, which a stream needs."""
    writers.parquet(read(s, d, "events"), f"{path}/in")
    return f"{path}/in"


@query(
    f"""WITH {EV}, f AS (SELECT DISTINCT user_id, date_trunc('second', ts) AS ts, event_type, text FROM ev WHERE event_type IN ('click', 'view', 'purchase')), c AS (SELECT user_id, count(*) AS n, count(DISTINCT text) AS items FROM f GROUP BY user_id)
SELECT user_id, n::INT AS n, items::INT AS items FROM c WHERE n >= 5"""
)
def resumable_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Raw JSON to events, vocabulary, encoded events, sequences and split; a second run reads what the first has written."""
    path = scratch(s, "pipeline")
    named = {"click": "NativeClick", "view": "MSN", "purchase": "EdgeSearchQuery"}
    kind = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    e = events(s, d).where(F.col("event_type").isin(*named))
    one = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), kind[F.col("event_type")].alias("Type"), F.array("text", F.lit("u")).alias("Texts"))
    raw = e.groupBy("user_id").agg(F.to_json(F.collect_list(one)).alias("EventsOnlyWithAd"))
    job = event_pipeline(s, raw, path, FIVE_DOMAINS)
    job.run()
    done = job.run()
    rows = done["split"].where(F.col("split").isNotNull())
    return rows.select("user_id", F.size("encoded_id").alias("n"), F.size(F.array_distinct("encoded_id")).alias("items"))
