"""Quality scores by a generalised additive model with pairwise interactions.

Features are counted from the bytes of whole texts.  The model is a table of
additive terms over binned features, learned by cyclic boosting: in each round
every feature in turn gets one shallow tree (up to three leaves) on the current
gradient, added to its table at a small rate; then the pairs of features whose
quadrant splits gain most get tables of their own in the same way.  Scoring
looks bins up and adds.

The model is fitted on the driver from at most `sample` labelled documents,
those with the smallest hash of doc_id, so what is collected is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import kernel as K
from sequora.llm.runtime import lean, numbered, picked, place, ship

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "marks", "exclaims", "bars", "stops", "other_signs", "lines", "same_as_before",
    "longest_run", "distinct_words", "distinct_pairs", "long_words", "short_words", "capitalised", "all_capitals", "beyond_ascii", "spaces",
)

_CLASS = np.zeros(256, np.uint8)  # of a byte
for _i, _chars in enumerate((range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), b"#$%&*@^~_=+\\<>{}[]", b"!?", b"|", b".,;:", b"\"'()-/`", b"\n\r"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by FEATURES of the texts between offsets; a text without words has zeros."""
    n = len(offsets) - 1
    counts = np.zeros((n, 11))  # bytes of each class, and capitals
    sums = np.zeros((n, 5))  # of words: bytes, long ones, short ones, capitalised ones, all in capitals
    hashes, rows = [np.zeros(0, K.U64)], [np.zeros(0, np.int64)]
    for lo, hi, h, s, e in K.word_parts(data, offsets):
        raw = data[lo:hi]
        kind = _CLASS[raw]
        some = np.arange(int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi)))
        begin, end = np.clip(offsets[some], lo, hi) - lo, np.clip(offsets[some + 1], lo, hi) - lo
        run = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        for c in range(1, 10):
            total = run(kind == c)
            counts[some, c] += total[end] - total[begin]
        # capitals of the Latin-1 letters are 0xC3 and then 0x80-0x9E
        second = np.concatenate([[False], raw[:-1] == 0xC3])
        caps = run((kind == 1) | second & (raw >= 0x80) & (raw <= 0x9E))
        smalls = run((raw >= ord("a")) & (raw <= ord("z")) | second & (raw >= 0x9F))
        counts[some, 10] += caps[end] - caps[begin]
        row = np.searchsorted(offsets, s, "right") - 1
        lens, s, e = e - s, s - lo, e - lo
        capitals = caps[e] - caps[s]
        each = (lens, lens > 12, lens <= 3, caps[np.minimum(s + 2, e)] > caps[s], (capitals >= 2) & (smalls[e] == smalls[s]))
        for i, x in enumerate(each):
            sums[some, i] += np.bincount(row - some[0], x, len(some))
        hashes.append(h)
        rows.append(row)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    words, size = np.bincount(row, minlength=n), np.diff(offsets)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    at = np.arange(len(h))
    longest = np.zeros(n)
    np.maximum.at(longest, row, at - np.maximum.accumulate(np.where(same == 0, at, 0)) + 1)
    own = row.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)

    def distinct(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, i = np.unique(x, return_index=True)
        return np.bincount(of[i], minlength=n)

    pairs = K.grams(h, 2)
    ok = row[1:] == row[:-1]
    out = [
        np.log1p(words), sums[:, 0] / per_word, counts[:, 10] / per_byte, counts[:, 2] / per_byte, counts[:, 3] / per_word, counts[:, 4] / per_word, counts[:, 5] / per_word,
        counts[:, 6] / per_word, counts[:, 7] / per_word, counts[:, 8] / per_word, np.bincount(row, same, n) / per_word, longest / per_word,
        distinct(K.mix(h ^ own), row) / per_word, distinct(pairs[ok] ^ own[:-1][ok], row[:-1][ok]) / np.maximum(words - 1, 1),
        sums[:, 1] / per_word, sums[:, 2] / per_word, sums[:, 3] / per_word, sums[:, 4] / per_word, counts[:, 9] / per_byte, (size - sums[:, 0]) / per_byte,
    ]
    return np.where(words[:, None] > 0, np.stack(out, 1), 0.0)


def _sum(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    return grad**2 / (hess + ridge)


@dataclass
class Model:
    """Additive terms: `edges` of each feature, a table for each, and (i, j, coarse edges of i, of j, table) for pairs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edge, x[:, j], "right")]
        for i, j, a, b, values in self.pairs:
            out += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of the best tree of up to three leaves."""
    n = len(grad)
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        at = np.arange(a + 1, b)
        gl, hl, gr, hr = g[at] - g[a], h[at] - h[a], g[b] - g[at], h[b] - h[at]
        gain = np.where((hl >= least) & (hr >= least), _sum(gl, hl, ridge) + _sum(gr, hr, ridge) - _sum(g[b] - g[a], h[b] - h[a], ridge), 0.0)
        i = int(np.argmax(gain))
        return float(gain[i]), int(at[i])

    gain, at = cut(0, n)
    if gain <= 0:
        return np.zeros(n)
    (gl, l), (gr, r) = cut(0, at), cut(at, n)
    cuts = sorted({0, at, n, *([l] if gl >= gr and gl > 0 else [r] if gr > 0 else [])})
    out = np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values by cell of the best split into four quadrants."""
    m, n = grad.shape
    g, h = np.zeros((m + 1, n + 1)), np.zeros((m + 1, n + 1))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    if m < 2 or n < 2:
        return 0.0, np.zeros((m, n))
    gs = [g[1:-1, 1:-1], g[1:-1, -1:] - g[1:-1, 1:-1], g[-1:, 1:-1] - g[1:-1, 1:-1], g[-1, -1] - g[1:-1, -1:] - g[-1:, 1:-1] + g[1:-1, 1:-1]]
    hs = [h[1:-1, 1:-1], h[1:-1, -1:] - h[1:-1, 1:-1], h[-1:, 1:-1] - h[1:-1, 1:-1], h[-1, -1] - h[1:-1, -1:] - h[-1:, 1:-1] + h[1:-1, 1:-1]]
    gain = sum(_sum(a, b, ridge) for a, b in zip(gs, hs, strict=True)) - _sum(g[-1, -1], h[-1, -1], ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [-a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs, strict=True)]
    out = np.empty((m, n))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, coarse: int = 8, n_pairs: int = 8, pair_rounds: int = 40, ridge: float = 1.0, least: float = 0.5) -> Model:
    """Fit on rows of features and labels 0 or 1; without rows, a model that scores 0.5."""
    if not len(y):
        return Model()
    p = np.clip(y.mean(), 0.01, 0.99)
    model = Model(float(np.log(p / (1 - p))))
    margin = np.full(len(y), model.base)
    place = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edge = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(values) > bins else values[1:]
        model.edges.append(edge)
        model.tables.append(np.zeros(len(edge) + 1))
        place.append(np.searchsorted(edge, x[:, j], "right"))

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return q - y, q * (1 - q)

    for _ in range(rounds):
        for j, at in enumerate(place):
            grad, hess = slope()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at, grad, n), np.bincount(at, hess, n), ridge, least)
            model.tables[j] += step
            margin += step[at]
    rough = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, coarse + 1)[1:-1])) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(rough)]

    def table(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m, n = len(rough[i]) + 1, len(rough[j]) + 1
        return np.bincount(cell[i] * n + cell[j], v, m * n).reshape(m, n)

    grad, hess = slope()
    gains = sorted(((-_quadrants(table(i, j, grad), table(i, j, hess), ridge)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:n_pairs]
    found = {(i, j): np.zeros((len(rough[i]) + 1, len(rough[j]) + 1)) for g, i, j in gains if g < 0}
    for _ in range(pair_rounds):
        for (i, j), values in found.items():
            grad, hess = slope()
            step = rate * _quadrants(table(i, j, grad), table(i, j, hess), ridge)[1]
            values += step
            margin += step[cell[i], cell[j]]
    model.pairs = [(i, j, rough[i], rough[j], v) for (i, j), v in found.items()]
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0 (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@lean
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        for i, j in K.slices(offsets):
            x = features(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, sample: int = 20_000, **options: object) -> Model:
    """A model of labels (doc_id, quality) from at most `sample` documents outside the held-out fold; other columns are not looked at."""
    ship(spark)
    marked = picked(labels, doc_id="long", quality="int").withColumnsRenamed({"doc_id": "id_", "quality": "label"}).where("label in (0, 1) and id_ is not null")
    marked = marked.where(~held_out(F.col("id_"))).groupBy("id_").agg(F.max("label").alias("label"))
    some = marked.orderBy(F.xxhash64("id_"), "id_").limit(sample)
    rows = picked(docs, doc_id="long", text="string").join(F.broadcast(some), F.col("doc_id") == F.col("id_"))
    got = rows.select("doc_id", "label", "text").mapInArrow(_measure, "doc_id long, label int, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("r.label", "r.x").toArrow()  # of rows that share an id, one
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the model doesn't depend on the order in which rows arrive
    return fit(x[order], y[order], **options)


@lean
def _score(batches: Iterator[pa.RecordBatch], model: Model, cut: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        scores = [model.score(features(data, offsets[i : j + 1])) for i, j in K.slices(offsets)]
        if scores:
            s = np.concatenate(scores)
            at = batch.schema.get_field_index("score")
            yield batch.set_column(at, "score", pa.array(s)).set_column(at + 1, "predicted", pa.array((s >= cut).astype(np.int32)))


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """Per row of docs (doc_id, text, any others): doc_id, held_out, score (0 to 1), predicted (1 if score >= cut).

    Null, empty and blank texts have the score of a text without words; repeated rows have equal scores.
    """
    rows = picked(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _score(batches, model, cut):
            yield b.select(["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """docs without the rows that score less than `cut`."""
    plain, at = numbered(docs), place(docs, "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column(at))
            keep = [model.score(features(data, offsets[i : j + 1])) >= cut for i, j in K.slices(offsets)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
