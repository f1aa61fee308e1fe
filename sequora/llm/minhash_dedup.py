"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles (64-bit hashes), minima of 252
   hash functions, 42 band keys of 6 minima, and a signature of the minima's
   low 4 bits, packed.  Documents with equal sets form one class at once
   (combined before the shuffle); only its smallest id goes on.
2. Classes that meet in a band are candidates.  Within a bucket, in blocks of
   bounded size, bit counts of the packed signatures give a collision-corrected
   similarity for each pair; of the pairs that reach the threshold less a
   margin only a spanning forest leaves the block.  Its components, over all
   buckets, are groups: pages that merely share a band are in none, and no text
   has moved so far.
3. A group's texts are compared on their full shingle sets, each once within its
   block; pairs well below the threshold by their signatures, and pairs known to
   be connected, are passed over.  Each block also holds the group's first rows,
   so most groups are one component by now.  Where a group of several blocks has
   fallen into several components, rows of all but its largest one meet the
   group's other blocks.
4. Confirmed links, at most one for each row and block, give the components.

A pair at the threshold of 0.8 misses all bands with probability 3e-6 and falls
under the estimate's margin (over four standard deviations) with about 2e-5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import kernel as K
from sequora.llm.runtime import Tables, attach, connected_components, grouped, lean, numbered, picked, place, rooted, ship

BANDS, ROWS, BITS = 42, 6, 4
#: Rows and shingles of a group in a block, as many as are expected; rows of a bucket in a block; rows of a group that are in each of its blocks.
BLOCK_ROWS, BLOCK_SHINGLES, BUCKET_ROWS, PIVOTS = 3000, 4_000_000, 16_384, 16
_PERMS = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 32, _PERMS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, _PERMS, dtype=np.uint32)
_ROW = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) | K.U64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text with fewer words is one shingle, one without words none."""
    h, _, _, first = K.words(data, offsets, lower=True)
    g = K.grams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        else:
            out.append(K.grams(h[a:b], b - a, k) if b > a else h[:0])
    return out


def fingerprint(s: np.ndarray) -> np.uint64:
    """Of a set: the sum of its members, scrambled."""
    return K.mix(s.copy()).sum(dtype=K.U64)


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    x = (s >> K.U64(32)).astype(np.uint32)[:, None]
    low = np.full(_PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        v = x[i : i + 512] * _MUL
        v += _ADD
        np.minimum(low, v.min(0), out=low)
    return low


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima (rows by hash functions), 16 to a 64-bit word."""
    v = (m & np.uint32(15)).astype(np.uint8)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % 16)))
    return np.ascontiguousarray(v[:, ::2] | v[:, 1::2] << 4).view(np.uint64)


@lean
def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        ids, names = batch.column("doc_id"), batch.column("key")
        for i, j in K.slices(offsets):
            sets = shingle_sets(data, offsets[i : j + 1], k)
            n = np.array([len(s) for s in sets], np.int64)
            # a set's two fingerprints: sums of two different scramblings of its members
            f1 = np.array([fingerprint(s) for s in sets], K.U64)
            f2 = np.array([fingerprint(s ^ K.U64(0xA5A5A5A5A5A5A5A5)) for s in sets], K.U64)
            m = np.stack([minima(s) for s in sets])
            keys = m.reshape(-1, BANDS, ROWS).astype(K.U64) * _ROW
            keys = K.mix(keys.sum(2, dtype=K.U64) + _BAND).view(np.int64)
            bits = packed(m).view(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [names.slice(i, j - i), ids.slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())), pa.array([x.tobytes() for x in bits], pa.binary())],
                ["key", "doc_id", "n", "f1", "f2", "bands", "bits"],
            )


class Links:
    """Union-find over row numbers; the root is the smallest number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def estimates(one: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to each of the others, corrected for chance agreement of low bits."""
    x = one ^ all_
    x |= x >> K.U64(2)
    x |= x >> K.U64(1)
    x &= K.U64(0x1111111111111111)
    same = (_PERMS - np.bitwise_count(x).sum(1, dtype=np.int64)) / _PERMS
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def spanning(bits: np.ndarray, n: np.ndarray, percent: int, margin: float) -> list[tuple[int, int]]:
    """A spanning forest of the rows that may be alike by their signatures and sizes: each row meets those not yet reached, once."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(n))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            m = n[left]
            ok = 100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])
            near = np.flatnonzero(ok)
            near = near[estimates(bits[i], bits[left[near]]) >= percent / 100 - margin]
            met = left[near].tolist()
            out += [(i, x) for x in met]
            todo += met
            left = np.delete(left, near)
    return out


@lean
def _candidates(batches: Iterator[pa.RecordBatch], percent: int, margin: float) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, ["band", "p", "q"]):
        rows = rows.combine_chunks()
        ids = rows["id"].to_numpy()
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
        order = np.lexsort((rows["key"].to_numpy(), ids))
        found = spanning(bits[order], rows["n"].to_numpy()[order], percent, margin)
        ends = ids[order][np.array(found, np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def linked(bits: np.ndarray, n: np.ndarray, sets: list[np.ndarray], left: np.ndarray, known: np.ndarray, percent: int, margin: float) -> Links:
    """Connect rows whose sets are alike; `left`: False for all (any two rows meet), or True for those that meet the others.
    Rows of one `known` component are connected from the start."""
    found = Links(len(n))
    names, first = np.unique(known, return_index=True)
    for i, j in enumerate(first[np.searchsorted(names, known)].tolist()):
        found.join(i, j)
    across = bool(left.any())
    for i in range(len(n) - 1):
        others = np.arange(i + 1, len(n))
        m = n[others]
        ok = 100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])
        if across:
            ok &= left[others] != left[i]
        others = others[ok]
        near = estimates(bits[i], bits[others])
        ok = near >= percent / 100 - margin
        others, near = others[ok], near[ok]
        for j in others[np.argsort(-near, kind="stable")].tolist():
            if found.root(i) != found.root(j):
                a, b = sets[i], sets[j]
                if len(a) > len(b):
                    a, b = b, a
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[place] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    found.join(i, j)
    return found


@lean
def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int, margin: float) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, ["group", "p", "q"]):
        order = np.lexsort((rows["key"].to_numpy(), rows["id"].to_numpy()))
        rows = rows.combine_chunks().take(pa.array(order))
        ids, known, left = (rows[c].to_numpy(zero_copy_only=False) for c in ("id", "known", "rest"))
        data, offsets = K.string_buffers(rows["text"])
        sets: list[np.ndarray] = []
        for i, j in K.slices(offsets):
            sets += shingle_sets(data, offsets[i : j + 1], k)
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
        found = linked(bits, np.array([len(s) for s in sets]), sets, left, known, percent, margin)
        root = ids[[found.root(i) for i in range(len(ids))]]
        new = root != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(root[new])], ["a", "b"])


def _pairs_of_blocks(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Each row (with `block`) of `n` blocks, once for each pair of blocks p <= q that its own is in."""
    other = F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    return rows.select("*", other).select("*", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).drop("other", "block", n)


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, doc_id.isNull(), text.isNull())


def near_duplicates(docs: DataFrame, spark: SparkSession, shingle: int = 5, percent: int = 80, margin: float = 0.11) -> DataFrame:
    """Per row of docs (doc_id, text, any others): doc_id, n_shingles, component_id, kept.

    Rows whose shingle sets have a Jaccard similarity of at least `percent` / 100 are linked, and so are rows that share a
    doc_id and have shingles; component_id is the smallest doc_id reachable, kept says that it is the row's own.  Words are
    lower-cased in A-Z only.  Null, empty and blank texts have no shingles and are linked with nothing; a row without
    doc_id is alone (component_id and kept are null).  An empty table gives an empty table.
    """
    ship(spark)
    tables = Tables(spark)
    base = picked(docs, doc_id="long", text="string")
    base = base.select(_row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    signed = base.mapInArrow(partial(_sign, k=shingle), "key long, doc_id long, n long, f1 long, f2 long, bands array<long>, bits binary")
    signed = tables.write(signed.withColumn("class", F.xxhash64("n", "f1", "f2")))
    real = signed.where("n > 0 and doc_id is not null")
    # equal sets are one class; a class is known by its smallest doc_id (classes that share it share a row's id, so they are connected)
    classes = real.groupBy("class").agg(F.min(F.struct("doc_id", "key", "n", "bands", "bits")).alias("r"), F.count("*").alias("copies"))
    classes = tables.write(classes.select("class", F.col("r.doc_id").alias("id"), "r.key", "r.n", "r.bands", "r.bits", "copies"))

    # buckets; of those that hold the same classes, one
    keys = classes.select("id", "key", "n", "bits", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.count("*").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor(F.xxhash64("key")).alias("x")).where("size > 1")
    buckets = tables.write(buckets.groupBy("size", "lo", "hi", "x").agg(F.min("band").alias("band_")).select("band_", "size", F.ceil(F.col("size") / BUCKET_ROWS).cast("int").alias("blocks")))
    facts = buckets.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    met = attach(keys, "band", buckets, "band_", "size", facts.most, facts.total)
    met = _pairs_of_blocks(met.select("band", "id", "key", "n", "bits", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")), "band", "blocks")
    near = met.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q").mapInArrow(partial(_candidates, percent=percent, margin=margin), "a long, b long")
    groups = connected_components(near, spark)

    # groups, in blocks of texts
    member = groups.join(classes.select("id", "key", "n", "bits").withColumnRenamed("id", "id_"), F.col("id") == F.col("id_")).select(F.col("component").alias("group"), "id", "key", "n", "bits")
    counts = tables.write(member.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")))
    size = F.greatest(F.col("rows") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)
    facts = counts.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("most"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), F.coalesce(F.max(F.ceil(size)), F.lit(0)).alias("blocks")).first()
    counts = counts.select(F.col("group").alias("group_"), "rows", F.col("rows").alias("in_group"), F.ceil(size).cast("int").alias("blocks"))
    member = attach(member, "group", counts, "group_", "rows", facts.most, facts.total).drop("group_", "n")
    member = tables.write(member.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    texts = base.where("doc_id is not null").groupBy(F.col("key").alias("key_")).agg(F.first("text").alias("text"))  # repeated rows: one, before the shuffle
    texts = texts.join(member, F.col("key") == F.col("key_")).drop("key_")
    several = facts.blocks > 1
    if several:
        texts = tables.write(texts)
    check = lambda rows: rows.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q").mapInArrow(partial(_confirm, k=shingle, percent=percent, margin=margin), "a long, b long")
    columns = ["group", "id", "key", "text", "bits"]
    pivot = F.pmod(F.xxhash64(F.lit(9), "key"), F.col("in_group")) < PIVOTS
    places = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    links = tables.write(check(texts.select(*columns, F.explode(places).alias("p"), F.lit(0).alias("q"), F.lit(False).alias("rest"), F.col("id").alias("known"))))
    if several:
        links = tables.write(links.unionByName(_across(texts, links, spark, check, tables, columns)))

    # a doc_id whose rows are of several classes connects them
    own = signed.where("n > 0 and doc_id is not null").select("doc_id", "class").join(classes.select(F.col("class").alias("class_"), "id"), F.col("class") == F.col("class_"))
    ids = real.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("doc_"))
    shared = tables.write(ids)
    if shared.take(1):
        own = own.join(shared, F.col("doc_id") == F.col("doc_")).select("doc_id", "id")
        least = own.groupBy("doc_id").agg(F.min("id").alias("least")).withColumnRenamed("doc_id", "doc_")
        links = links.unionByName(own.join(least, F.col("doc_id") == F.col("doc_")).select(F.col("id").alias("a"), F.col("least").alias("b")))
        several = True
    # groups of one block have their components already
    found = connected_components(links, spark) if several else rooted(links)
    by_class = classes.join(found.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_"), "left").select(F.col("class").alias("class_"), F.coalesce("component", "id").alias("c"), "copies")
    facts = classes.agg(F.coalesce(F.max("copies"), F.lit(0)).alias("most"), F.coalesce(F.sum("copies"), F.lit(0)).alias("total")).first()
    out = attach(real.select("doc_id", "n", "class"), "class", by_class, "class_", "copies", facts.most, facts.total)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), (F.col("c") == F.col("doc_id")).alias("kept"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), (F.col("doc_id") == F.col("doc_id")).alias("kept"))
    return out.unionByName(alone)


def _across(texts: DataFrame, links: DataFrame, spark: SparkSession, check: Callable[[DataFrame], DataFrame], tables: Tables, columns: list[str]) -> DataFrame:
    """Links between components of one group that were not met in its blocks: rows of all but its largest component meet its other rows."""
    found = connected_components(links, spark).withColumnRenamed("id", "id_")
    rows = texts.where("blocks > 1").join(found, F.col("id") == F.col("id_"), "left").select(*columns, "blocks", "block", F.coalesce("component", "id").alias("known"))
    heads = rows.select("group", "known").groupBy("group", "known").agg(F.count("*").alias("n"))
    heads = heads.groupBy("group").agg(F.max(F.struct("n", "known")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    heads = heads.select(F.col("group").alias("group_"), F.col("top.known").alias("largest"), "all", F.ceil((F.col("all") - F.col("top.n")) / BLOCK_ROWS).cast("int").alias("parts"))
    heads = tables.write(heads)
    facts = heads.agg(F.coalesce(F.max("all"), F.lit(0)).alias("most"), F.coalesce(F.sum("all"), F.lit(0)).alias("total")).first()
    rows = attach(rows, "group", heads, "group_", "all", facts.most, facts.total)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rows.where("known != largest").select(*columns, "known", F.pmod(F.xxhash64(F.lit(5), "key"), F.col("parts")).cast("int").alias("p"), every("blocks").alias("q"), F.lit(True).alias("rest"))
    others = rows.select(*columns, "known", every("parts").alias("p"), F.col("block").alias("q"), F.lit(False).alias("rest"))
    return check(rest.unionByName(others))


def one_of_each_row(docs: DataFrame, spark: SparkSession, **options: object) -> DataFrame:
    """docs with one document of each component: the one of smallest doc_id, those without one last.

    Rows are told apart by id and text together, so rows that share a doc_id, or have none, are compared as any others.
    Of rows equal in both one stays; rows without doc_id and without shingles all stay.
    """
    plain = numbered(docs)
    same, text = F.col(place(docs, "doc_id")).cast("long"), F.col(place(docs, "text")).cast("string")
    keyed = plain.withColumn("key", _row_key(same, text))
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), text.alias("text")), spark, **options)
    found = found.groupBy(F.col("doc_id").alias("id_")).agg(F.max("n_shingles").alias("n_"), F.min("component_id").alias("c_"))
    ids = keyed.groupBy(F.col("key").alias("k_")).agg(F.min(same).alias("d_"), F.count("*").alias("n")).join(found, F.col("k_") == F.col("id_"))
    first = ids.groupBy("c_").agg(F.min(F.struct(F.col("d_").isNull().alias("no_id"), "d_", "k_", "n_", "n")).alias("r"))
    first = Tables(spark).write(first.select("r.k_", "r.n", F.col("r.n").alias("copies"), (F.col("r.no_id") & (F.col("r.n_") == 0)).alias("all_")))
    facts = first.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    left = attach(keyed, "key", first, "k_", "n", facts.most, facts.total)
    once = left.where("copies > 1 and not all_").dropDuplicates(["key"])
    return left.where("copies = 1 or all_").unionByName(once).select(*plain.columns).toDF(*docs.columns)
