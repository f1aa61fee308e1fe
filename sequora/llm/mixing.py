"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Targets share 150 % of all words by weight; a source stops at twice its size and
the excess is shared by weight among the rest.  The total is cut into blocks of
equal size: 64 words, or a 64th of the smallest target where that is less, and
one word at least, so that a small source comes as near to its target as a large
one.  Seats (blocks) go to sources by the highest quotients target/(2i+1), then
in each source to its shards in the same way.  Rounding moves a quota by no more
than half a seat plus its share of half a seat for each claimant, so all seats
below that range are granted outright and only the quotients inside it are
ranked: a few for each claimant, however many blocks there are.

In a shard the documents follow each other in seeded order, as on a circle of
words; the shard's blocks are laid on from a seeded place, at most twice round.
A document takes the words of it that the blocks cover.

Texts are counted once, into a table of headers; rows that are equal there are
one header with a number of copies, which are dealt one by one.  The mix itself
joins what was decided back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.llm.runtime import Tables, numbered, picked, place, repeated

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seats(claims: DataFrame, group: list[str], total: str, share: str, order: list[str], name: str) -> DataFrame:
    """Add `name`: of `total` seats (one number for each group), each claimant's by the highest quotients share/(2i+1); ties by `order`."""
    all_ = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    fair = F.when(F.sum(share).over(all_) > 0, F.col(share) * F.col(total) / F.sum(share).over(all_)).otherwise(0.0)
    slack = F.count(F.lit(1)).over(all_) / (2.0 * F.greatest(F.col(total), F.lit(1)))
    c = claims.withColumn("fair_", fair).withColumn("slack_", slack)
    c = c.withColumn("sure_", F.greatest(F.floor(F.col("fair_") * (1 - F.col("slack_")) - 1.5), F.lit(0)).cast("long"))
    c = c.withColumn("most_", F.ceil(F.col("fair_") * (1 + F.col("slack_")) + 1.5).cast("long"))
    c = c.withColumn("open_", (F.col(total) - F.sum("sure_").over(all_)).cast("long"))
    asked = c.withColumn("i_", F.explode(F.sequence("sure_", "most_")))
    ranked = Window.partitionBy(*(group or [F.lit(0)])).orderBy((F.col(share) / (2 * F.col("i_") + 1)).desc(), *order, "i_")
    won = asked.withColumn("rank_", F.row_number().over(ranked))
    kept = [x for x in claims.columns]
    return won.groupBy(*kept).agg((F.first("sure_") + F.sum(((F.col("rank_") <= F.col("open_")) & (F.col(share) > 0)).cast("long"))).alias(name))


def targets(by: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (by code point, null last): k, rows_, source_size, target.  `by` has source, source_size and rows_."""
    one = Window.partitionBy(F.lit(0))
    by = by.withColumn("k", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w_", w).withColumn("all_", F.sum("source_size").over(one))
    filling = one.orderBy(F.col("source_size") / F.col("w_"), "k")
    before = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w_").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level_", (share * F.col("all_") - cap * before) / rest)
    by = by.withColumn("capped_", cap * F.col("source_size") <= F.col("w_") * F.col("level_"))
    level = F.min(F.when(~F.col("capped_"), F.struct(F.col("source_size") / F.col("w_"), "k", "level_"))).over(one)["level_"]
    return by.select("source", "k", "rows_", "source_size", F.when(F.col("capped_"), cap * F.col("source_size")).otherwise(F.col("w_") * level).alias("target"))


def _headers(docs: DataFrame) -> DataFrame:
    """Rows equal in id, source and text as one: doc_id, source, size, key, copies, and `before`: how many with this id, source and size come before its own."""
    rows = picked(docs, doc_id="long", source="string", text="string")
    rows = rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key("doc_id", "source", "text").alias("key"))
    found = Tables(docs.sparkSession).write(rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("copies").over(same), F.lit(0)))


def _key(*names: str) -> Column:
    return F.xxhash64(*names, *(F.col(n).isNull() for n in names))


def _laid(docs: DataFrame, seed: int, block: int, shard_rows: int, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Each copy of a header on its shard's circle: size, source_size, target, begin_, start_, rest_, rounds_, shard_size, once_ and wrapped_ (words covered on either side)."""
    headers = _headers(docs)
    by = headers.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows_"))
    by = targets(by, share, cap, weights)
    one = Window.partitionBy(F.lit(0))
    by = by.withColumn("block_", F.greatest(F.least(F.lit(block).cast("long"), F.coalesce(F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(one) / block), F.lit(1))), F.lit(1)).cast("long"))
    by = by.withColumn("seats_all_", F.round(F.sum("target").over(one) / F.col("block_")).cast("long"))
    by = _seats(by, [], "seats_all_", "target", ["k"], "seats").drop("seats_all_")
    by = by.select(F.col("source").alias("source_"), "k", "source_size", "target", "seats", "block_", F.ceil(F.col("rows_") / shard_rows).cast("long").alias("shards_"))
    each = repeated(headers, "copies", "i_").withColumn("i_", F.col("before") + F.col("i_"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "i_").cast("binary"))
    in_shard = lambda h: F.pmod(F.conv(F.substring(h, 1, 7), 16, 10).cast("long"), F.col("shards_"))
    dealt = each.withColumn("h_", place).join(by, F.col("source").eqNullSafe(F.col("source_"))).withColumn("shard_", in_shard(F.col("h_")))
    shards = dealt.groupBy("k", "shard_", "seats", "block_").agg(F.sum("size").alias("shard_size"))
    shards = _seats(shards, ["k"], "seats", "shard_size", ["shard_"], "quota")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("start"), "k", "shard_").cast("binary")), 1, 12), 16, 10).cast("long")
    words = F.least(F.col("quota") * F.col("block_"), (cap * F.col("shard_size")).cast("long"))
    shards = shards.select(F.col("k").alias("k_"), F.col("shard_").alias("s_"), "shard_size", words.alias("words_"), F.when(F.col("shard_size") > 0, F.pmod(start, F.col("shard_size"))).otherwise(0).alias("start_"))
    laid = dealt.join(shards, (F.col("k") == F.col("k_")) & (F.col("shard_") == F.col("s_")))
    ring = Window.partitionBy("k", "shard_").orderBy("h_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.withColumn("end_", F.sum("size").over(ring)).withColumn("begin_", F.col("end_") - F.col("size"))
    z = F.when(F.col("shard_size") > 0, F.col("shard_size")).otherwise(1)
    laid = laid.withColumn("rounds_", F.expr("words_ div greatest(shard_size, 1)")).withColumn("rest_", F.pmod(F.col("words_"), z))

    def covered(at: Column) -> Column:
        return F.greatest(F.least("end_", at + F.col("rest_")) - F.greatest("begin_", at), F.lit(0))

    laid = laid.withColumn("once_", covered(F.col("start_"))).withColumn("wrapped_", covered(F.col("start_") - F.col("shard_size")))
    return laid.withColumn("taken", (F.col("rounds_") * F.col("size") + F.col("once_") + F.col("wrapped_")).cast("long"))


def mix(docs: DataFrame, seed: int = 17, block: int = 64, shard_rows: int = 1 << 13, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row of docs (doc_id, text, source, any others): doc_id, size, source_size, target, taken.

    Null and blank texts have size 0 and take 0.  A null source is a source of its own, after the others.  Repeated
    rows are rows like others.  A document is taken at most `cap` (2) times.  An empty table gives an empty table.
    Equal inputs give equal results: order and places depend on seed, doc_id, size and the number among rows equal in these.
    """
    return _laid(docs, seed, block, shard_rows, share, cap, weights).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 17, block: int = 64, shard_rows: int = 1 << 13, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with docs' columns: each document as often as it is taken whole, and the words taken once more as a text of their own (n_chars, if there, follows the text).

    The copies of rows equal in doc_id, source and text have the other columns of one of them.
    """
    laid = _laid(docs, seed, block, shard_rows, share, cap, weights).where("taken > 0")
    # the covered words: one run, or on the document in which the blocks begin and end, one at either side
    decided = laid.select("key", "copies", "size", F.col("rounds_").alias("rounds"), F.greatest(F.col("start_") - F.col("begin_"), F.lit(0)).alias("on_"), "once_", "wrapped_")
    part = (F.col("once_") + F.col("wrapped_") > 0) & (F.col("once_") + F.col("wrapped_") < F.col("size"))
    decided = decided.withColumn("on_", F.when(part, F.col("on_")).otherwise(0)).groupBy("key", "copies", "size", "rounds", "on_", "once_", "wrapped_").agg(F.count(F.lit(1)).alias("times"))
    decided = Tables(docs.sparkSession).write(decided.withColumnRenamed("key", "key_"))
    id_, source, text = (F.col(place(docs, n)).cast(t) for n, t in (("doc_id", "long"), ("source", "string"), ("text", "string")))
    plain = numbered(docs)
    rows = plain.select("*", id_.alias("i_"), source.alias("s_"), text.alias("t_")).select(*plain.columns, "t_", _key("i_", "s_", "t_").alias("key"))
    same = F.col("key") == F.col("key_")
    single, several = decided.where("copies = 1"), decided.where("copies > 1")
    once = rows.join(several.select("key_").distinct(), same, "left_semi").dropDuplicates(["key"])
    got = rows.join(single, same).unionByName(once.join(several, same))
    got = repeated(got, "times", "n_")
    words = F.regexp_extract_all(F.col("t_"), F.lit(f"({WORD})"), F.lit(1))
    first = F.slice(words, (F.col("on_") + 1).cast("int"), F.col("once_").cast("int"))
    second = F.slice(words, F.lit(1), F.col("wrapped_").cast("int"))
    piece = F.when(part, F.array_join(F.concat(second, first), " ")).otherwise(F.col("t_"))
    whole = F.array_repeat(F.col("t_"), F.col("rounds").cast("int"))
    texts = F.concat(whole, F.when(F.col("once_") + F.col("wrapped_") > 0, F.array(piece)).otherwise(F.array().cast("array<string>")))
    out = got.select(*plain.columns, F.explode(texts).alias("text_"))
    changed = {place(docs, "text"): F.col("text_")}
    if "n_chars" in docs.columns:
        changed[place(docs, "n_chars")] = F.length("text_").cast("long")
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in plain.columns)).toDF(*docs.columns)


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents),
placed AS (SELECT *, md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''), size, row_number() OVER (PARTITION BY doc_id, source, size) - 1)) AS h FROM sized),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s2),
s4 AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT *, 2.0::DOUBLE * source_size <= w * level AS capped FROM s4),
s6 AS (SELECT *, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE w * (SELECT arg_min(level, (source_size / w, k)) FROM s5 WHERE NOT capped) END AS target FROM s5),
s7 AS (SELECT *, round(sum(target) OVER () / block)::BIGINT AS seats, sum(target) OVER () AS targets, count(*) OVER () AS claims FROM
  (SELECT *, greatest(least(64, coalesce(floor(min(target) FILTER (target > 0) OVER () / 64), 1)), 1)::BIGINT AS block FROM s6)),
s8 AS (SELECT *, CASE WHEN targets > 0 THEN target * seats / targets ELSE 0 END AS fair, claims / (2.0::DOUBLE * greatest(seats, 1)) AS slack FROM s7),
s9 AS (SELECT *, greatest(floor(fair * (1 - slack) - 1.5), 0)::BIGINT AS sure, ceil(fair * (1 + slack) + 1.5)::BIGINT AS most FROM s8),
s10 AS (SELECT *, seats - sum(sure) OVER () AS open, i FROM (SELECT *, unnest(range(sure, most + 1)) AS i FROM s9)),
sopen AS (SELECT max(seats) - sum(sure) AS open FROM s9),
s11 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k, i) AS r FROM s10),
q AS (SELECT k, source, n, source_size, target, block, max(sure) + sum(CASE WHEN r <= (SELECT open FROM sopen) AND target > 0 THEN 1 ELSE 0 END) AS seats FROM s11 GROUP BY ALL),
d AS (SELECT z.*, q.k, q.source_size, q.target, q.block, q.seats::BIGINT AS seats, ('0x' || substr(h, 1, 7))::BIGINT % ceil(q.n / 8192)::BIGINT AS shard
  FROM placed z JOIN q ON z.source IS NOT DISTINCT FROM q.source),
h1 AS (SELECT k, shard, seats, block, sum(size)::BIGINT AS shard_size FROM d GROUP BY ALL),
h2 AS (SELECT *, sum(shard_size) OVER (PARTITION BY k) AS sizes, count(*) OVER (PARTITION BY k) AS claims FROM h1),
h3 AS (SELECT *, CASE WHEN sizes > 0 THEN shard_size * seats / sizes ELSE 0 END AS fair, claims / (2.0::DOUBLE * greatest(seats, 1)) AS slack FROM h2),
h4 AS (SELECT *, greatest(floor(fair * (1 - slack) - 1.5), 0)::BIGINT AS sure, ceil(fair * (1 + slack) + 1.5)::BIGINT AS most FROM h3),
h5 AS (SELECT *, seats - sum(sure) OVER (PARTITION BY k) AS open FROM h4),
h6 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shard_size / (2 * i + 1) DESC, shard, i) AS r FROM (SELECT *, unnest(range(sure, most + 1)) AS i FROM h5)),
h7 AS (SELECT k, shard, shard_size, least((max(sure) + sum(CASE WHEN r <= open AND shard_size > 0 THEN 1 ELSE 0 END)) * block, 2 * shard_size)::BIGINT AS words FROM h6 GROUP BY k, shard, shard_size, block),
h8 AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '17', 'start', k, shard)), 1, 12))::BIGINT % greatest(shard_size, 1) AS start,
  words // greatest(shard_size, 1) AS rounds, words % greatest(shard_size, 1) AS rest FROM h7),
e AS (SELECT d.*, h8.shard_size, h8.start, h8.rounds, h8.rest,
  sum(size) OVER (PARTITION BY d.k, d.shard ORDER BY h ROWS UNBOUNDED PRECEDING) AS stop FROM d JOIN h8 ON d.k = h8.k AND d.shard = h8.shard)
SELECT doc_id, size, source_size, target, (rounds * size
  + greatest(least(stop, start + rest) - greatest(stop - size, start), 0)
  + greatest(least(stop, start - shard_size + rest) - greatest(stop - size, start - shard_size), 0))::BIGINT AS taken FROM e
"""
