"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 8-word grams in each window of 35 words, the
one with the smallest hash (leftmost on ties).  The choice depends on the
window's words alone, so equal windows have equal anchors at equal places, and
the windows of one anchor occurrence are consecutive starts.  Extending an
occurrence both ways over all its windows gives its span.

1. Anchors are counted (combined before the shuffle); those met once go.
2. Where all occurrences of an anchor have one span, every window repeats.
3. Elsewhere equal spans are counted; those met twice repeat as a whole.
4. One occurrence of each span is opened into its windows, and windows are
   counted per anchor: a single span's window repeats if another span has it.

No pair of documents is made, so the work is linear in the anchors, whatever
the size of a group.  Rows are addressed by a hash of (doc_id, text): repeated
rows have the same result, and a null or reused doc_id does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import kernel as K
from sequora.llm.runtime import Tables, attach, lean, picked, ship

WINDOW, GRAM = 35, 8


def anchors(h: np.ndarray, first: np.ndarray, window: int, gram: int, step: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: row, first window (word index in the slice), number of windows, anchor hash, span hash.

    `step` windows are looked at together; a run that goes on beyond them counts as two, which changes no result.
    """
    n = len(h) - window + 1
    for c in range(0, n, step):
        part = h[c : c + step + window - 1]
        m = len(part) - window + 1
        row = np.searchsorted(first, np.arange(c, c + len(part)), "right") - 1
        whole = row[:m] == row[window - 1 :]
        g = K.grams(part, gram)
        at = K.leftmost_minima(g, window - gram + 1)
        new = whole.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1] | (row[1:m] != row[: m - 1])
        begin = np.flatnonzero(new)
        if len(begin):
            count = np.add.reduceat(whole.astype(np.int64), begin)
            # windows of one anchor overlap, so the first and the last cover the span
            w = K.grams(part, window, 2)
            span = K.mix((w[begin] ^ count.astype(K.U64)) * K.U64(0x9FB21C651E98DF25) + w[begin + count - 1])
            yield row[begin], begin + c, count, g[at[begin]], span


@lean
def _seeds(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        keys = batch.column("key").to_numpy()
        for i, j in K.slices(offsets):
            h, _, _, first = K.words(data, offsets[i : j + 1])
            for row, at, n, anchor, span in anchors(h, first, window, gram):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(keys[i + row]), pa.array((at - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "span", "key", "at", "n"])


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and flat values of a list column; a null list is empty."""
    lens = col.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return np.concatenate([[0], np.cumsum(lens)]), col.flatten()


@lean
def _open(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each listed span as its windows."""
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        keys = batch.column("key").to_numpy()
        cuts, flat = _lists(batch.column("spans"))
        anchor, at, n, single = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("anchor", "at", "n", "single"))
        for i, j in K.slices(offsets):
            h, _, _, first = K.words(data, offsets[i : j + 1])
            w = K.grams(h, window, 1)
            lo, hi = cuts[i], cuts[j]
            if lo == hi:
                continue
            row = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1]))
            n_, at_ = n[lo:hi].astype(np.int64), at[lo:hi].astype(np.int64)
            step = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_)
            start = np.repeat(at_, n_) + step
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(anchor[lo:hi], n_)), pa.array(w[start + np.repeat(first[row], n_)].view(np.int64)), pa.array(np.repeat(keys[i + row], n_)), pa.array(start.astype(np.int32)), pa.array(np.repeat(single[lo:hi], n_))],
                ["anchor", "w", "key", "at", "single"],
            )


@lean
def _remove(batches: Iterator[pa.RecordBatch], window: int, text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        cuts, flat = _lists(batch.column("runs"))
        at, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("at", "n"))
        total, gone, sha, kept_text = [], [], [], []
        for i, j in K.slices(offsets):
            h, starts, ends, first = K.words(data, offsets[i : j + 1])
            lo, hi = cuts[i], cuts[j]
            row = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1]))
            begin = first[row] + at[lo:hi]
            edge = np.bincount(begin, minlength=len(h) + 1) - np.bincount(begin + n[lo:hi] + window - 1, minlength=len(h) + 1)
            keep = np.cumsum(edge)[:-1] == 0
            out, a, b = K.joined_words(data, starts, ends, first, keep)
            removed = np.concatenate([[0], np.cumsum(~keep)])[first]
            total.append(np.diff(first))
            gone.append(np.diff(removed))
            view = memoryview(out)
            sha += [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if text:
                kept_text += [bytes(view[x:y]).decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        if sha:
            cols = [batch.column("doc_id"), pa.array(np.concatenate(total)), pa.array(np.concatenate(gone)), pa.array(sha)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if text:
                cols, names = [*cols, pa.array(kept_text)], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)


def repeated_windows(docs: DataFrame, spark: SparkSession, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (key, runs): the runs (at, n) of window starts whose word sequence also starts elsewhere; docs has key and text."""
    if not 0 < gram <= window:
        raise ValueError("an anchor is at most as long as a window")
    ship(spark)
    tables = Tables(spark)
    seeds = tables.write(docs.select("key", "text").mapInArrow(partial(_seeds, window=window, gram=gram), "anchor long, span long, key long, at int, n int"))
    met = seeds.groupBy("anchor").agg(F.count("*").alias("t"), F.min("span").alias("lo"), F.max("span").alias("hi")).where("t > 1")
    met = tables.write(met.select(F.col("anchor").alias("anchor_"), "t", (F.col("lo") == F.col("hi")).alias("one")))
    facts = met.agg(F.coalesce(F.max("t"), F.lit(0)).alias("most"), F.coalesce(F.sum("t"), F.lit(0)).alias("total")).first()
    again = tables.write(attach(seeds, "anchor", met, "anchor_", "t", facts.most, facts.total).drop("anchor_"))
    tables.drop(seeds, met)
    mixed = again.where("not one")
    spans = mixed.groupBy("anchor", "span").agg(F.count("*").alias("t"), F.min(F.struct("key", "at", "n")).alias("o"))
    spans = tables.write(spans.select("anchor", "span", "t", (F.col("t") == 1).alias("single"), "o.*"))
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "n", "single")).alias("spans"))
    # a repeated row's spans are never single, so reading them from each of its rows only repeats evidence
    opened = docs.select("key", "text").join(lists.withColumnRenamed("key", "key_"), F.col("key") == F.col("key_")).select("key", "text", "spans")
    opened = tables.write(opened.mapInArrow(partial(_open, window=window), "anchor long, w long, key long, at int, single boolean").withColumn("both", F.xxhash64("anchor", "w")))
    twice = opened.groupBy("both").agg(F.count("*").alias("t")).where("t > 1").withColumnRenamed("both", "both_")
    facts = twice.agg(F.coalesce(F.max("t"), F.lit(0)).alias("most"), F.coalesce(F.sum("t"), F.lit(0)).alias("total")).first()
    part = attach(opened.where("single"), "both", twice, "both_", "t", facts.most, facts.total).select("key", "at", F.lit(1).alias("n"))
    # a span and its anchor as one number: what they hold is one stretch of words
    both = F.xxhash64("anchor", "span")
    often = spans.where("not single").select(both.alias("both_"), "t")
    facts = often.agg(F.coalesce(F.max("t"), F.lit(0)).alias("most"), F.coalesce(F.sum("t"), F.lit(0)).alias("total")).first()
    whole = attach(mixed.withColumn("both", both), "both", often, "both_", "t", facts.most, facts.total).select("key", "at", "n")
    runs = again.where("one").select("key", "at", "n").unionByName(whole).unionByName(part)
    return runs.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("runs"))


def remove_repeats(docs: DataFrame, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text, any others): doc_id, n_words, n_removed, kept_sha256 and, if `text`, kept_text.

    A word goes if a window of `window` words over it also starts anywhere else, the same text included.
    Null and empty texts have no words (sha256 of the empty string); texts shorter than a window lose nothing;
    repeated rows lose everything from `window` words on.  An empty table gives an empty table.
    """
    ship(spark)
    base = picked(docs, doc_id="long", text="string")
    base = base.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    runs = repeated_windows(base, spark, window, gram).withColumnRenamed("key", "key_")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    return base.join(runs, F.col("key") == F.col("key_"), "left").select("doc_id", "text", "runs").mapInArrow(partial(_remove, window=window, text=text), schema)
