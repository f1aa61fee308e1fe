"""Near-duplicate vectors by spherical k-means cells.

Equal vectors are one class from the start (combined before the shuffle).
Centroids are fitted on the driver from a sample of at most `sample` classes,
those with the smallest hash; every class is assigned.  A class is at home in
the cell of its nearest centroid, and visits each cell whose boundary with its
own is nearer than half of `reach`.  Linked vectors on either side of a boundary
are together at most sqrt(2 - 2 * threshold) from it, so the nearer of the two
is within half of that and visits the other's cell: this reach, the default,
misses no pair.  A pair whose ends visit each other's cells counts in the cell
of smaller number.

Cells lie in blocks of a bounded number of home rows, neighbours together (a
larger cell has several blocks of its own).  A row goes once to each block that
has a cell it visits, and meets only the home rows of cells it visits.  Blocks
give each row's number of links and one link to its block's component, never a
list of pairs.  Vectors travel as bytes, in single precision if so stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sequora.llm.runtime import connected_components, grouped, lean, materialise, numbered, place, ship
from sequora.llm.vectors import common_length, flat_bytes, packed, unpacked

#: Home rows of a block and rows that meet them in one task, at most (of 64 single-precision components; fewer of longer vectors).
HOME_ROWS, ALL_ROWS = 65_536, 131_072
BLOCK_BYTES = 16 << 20
#: Bytes of a batch that leaves a worker, and rows and columns of a matrix of cosines.
OUT_BYTES, ROWS, COLUMNS = 4 << 20, 1024, 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell is started again at the worst-served row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best = np.empty(len(x), np.int64)
        near = np.empty(len(x))
        for i in range(0, len(x), 2048):
            s = x[i : i + 2048] @ c.T
            best[i : i + 2048] = s.argmax(1)
            near[i : i + 2048] = s.max(1)
        new = np.zeros_like(c)
        np.add.at(new, best, x)
        size = np.linalg.norm(new, axis=1)
        lost = np.flatnonzero(size < 1e-9)
        new[lost] = x[np.argsort(near, kind="stable")[: len(lost)]]
        c = new / np.maximum(np.linalg.norm(new, axis=1), 1e-12)[:, None]
    return c


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, reach: float, kind: type) -> Iterator[pa.RecordBatch]:
    """home: the nearest centroid; cells: a bit for it and for each cell that the row visits."""
    apart = np.stack([np.linalg.norm(centroids - c, axis=1) for c in centroids])
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            x = unpacked(batch.column("e"), centroids.shape[1], kind).astype(np.float64)
            s = (x / np.linalg.norm(x, axis=1)[:, None]) @ centroids.T
            home = s.argmax(1)
            cells = s[np.arange(len(s)), home][:, None] - s <= reach / 2 * apart[home]
            cells[np.arange(len(s)), home] = True
            bits = np.packbits(cells, axis=1)
            yield batch.append_column("home", pa.array(home.astype(np.int32))).append_column("cells", pa.array([r.tobytes() for r in bits], pa.binary()))


def _bits(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    return flat_bytes(column).reshape(-1, -(-k // 8))


def _counts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    home, rows = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for batch in batches:
        home += np.bincount(batch.column("home").to_numpy(), minlength=k)
        for i in range(0, batch.num_rows, ROWS):
            rows += np.unpackbits(_bits(batch.column("cells").slice(i, ROWS), k), axis=1, count=k).sum(0, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(home), pa.array(rows)], ["cell", "home", "rows"])


def blocks_of_cells(centroids: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and its number of blocks: cells near each other share a block of at most `most` home rows, a
    larger cell has several; a cell without home rows has none."""
    first, number = np.zeros(len(home), np.int64), -(-home // most)
    left = home > 0
    at = 0
    for c in np.flatnonzero(number > 1):
        first[c], left[c] = at, False
        at += number[c]
    while left.any():
        c = int(np.flatnonzero(left)[0])
        seed, held = centroids[c].copy(), 0
        while c >= 0 and held + home[c] <= most:
            first[c], left[c], held = at, False, held + home[c]
            seed += centroids[c]
            rest = np.flatnonzero(left)
            c = int(rest[(centroids[rest] @ seed).argmax()]) if len(rest) else -1
        at += 1
    return first, number


def _deal(batches: Iterator[pa.RecordBatch], first: np.ndarray, number: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row goes as a home row to all parts of its block, and to one part of each block that has a cell it visits (its own too)."""
    k = len(first)
    has = np.zeros((k, len(parts)), bool)  # the blocks of each cell
    for c in range(k):
        has[c, first[c] : first[c] + number[c]] = True
    has = has.astype(np.float32)
    start = np.concatenate([[0], np.cumsum(parts)])
    for batch in batches:
        if not batch.num_rows:
            continue
        each = batch.nbytes // batch.num_rows + 64
        step = int(np.clip(OUT_BYTES // (each * len(parts)), 1, ROWS))
        for i in range(0, batch.num_rows, step):
            some = batch.slice(i, step)
            home, h = some.column("home").to_numpy(), some.column("h2").to_numpy().view(np.uint64)
            cells = np.unpackbits(_bits(some.column("cells"), k), axis=1, count=k).astype(np.float32)
            row, block = np.nonzero(cells @ has > 0)
            part = (h[row] % parts[block].astype(np.uint64)).astype(np.int64)
            own = first[home] + (h // np.uint64(1 << 32) % np.maximum(number[home], 1).astype(np.uint64)).astype(np.int64)
            own_row = np.repeat(np.arange(len(home)), parts[own])
            own_part = np.concatenate([np.arange(n) for n in parts[own]])
            place = np.concatenate([start[own[own_row]] + own_part, start[block] + part])
            at, visitor = np.concatenate([own_row, row]), np.repeat([0, 1], [len(own_row), len(row)])
            out = some.drop_columns(["h1", "h2"]).take(pa.array(at))
            for j in range(0, len(at), max(1, OUT_BYTES // each)):
                cut = slice(j, j + max(1, OUT_BYTES // each))
                piece = out.slice(cut.start, cut.stop - cut.start)
                yield pa.RecordBatch.from_arrays([pa.array(place[cut].astype(np.int32)), pa.array(visitor[cut].astype(np.int32)), *piece.columns], ["place", "visitor", *piece.schema.names])


class _Forest:
    """Components of ids (sorted): each points at a smaller one of its component."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.up = ids, np.arange(len(ids))

    def roots(self, at: np.ndarray) -> np.ndarray:
        now = self.up[at]
        while (self.up[now] != now).any():
            now = self.up[now]
        self.up[at] = now
        return now

    def join(self, at: np.ndarray) -> None:
        met = self.roots(at)
        self.up[met] = met.min()


def block_links(home: dict[str, np.ndarray], others: dict[str, np.ndarray], threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, _Forest]:
    """Links (counted in copies) of home rows to others and of others to home rows, where the cosine is at least the threshold, ids
    differ, the other visits the home row's cell, and the pair isn't counted in a cell of smaller number; and components of both.

    Both have e, id, copies, home, cells; home rows are sorted by home.
    """
    a, b = home["e"], others["e"]
    unit = lambda x: (x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32)
    unit_a = unit(a)
    ids, at = np.unique(np.concatenate([home["id"], others["id"]]), return_inverse=True)
    in_a, in_b, forest = at[: len(a)], at[len(a) :], _Forest(ids)
    links_a, links_b = np.zeros(len(a)), np.zeros(len(b))
    cells, begins = np.unique(home["home"], return_index=True)
    spans = [(c, i, min(i + COLUMNS, end)) for c, begin, end in zip(cells.tolist(), begins, [*begins[1:], len(a)], strict=True) for i in range(begin, end, COLUMNS)]
    for first in range(0, len(b), ROWS):
        unit_b = unit(b[first : first + ROWS])
        visits = np.unpackbits(others["cells"][first : first + ROWS], axis=1, count=k)
        for cell, lo, hi in spans:
            rows = np.flatnonzero(visits[:, cell])
            s = unit_b[rows] @ unit_a[lo:hi].T
            some = np.flatnonzero(s.max(1, initial=-1) >= threshold - 1e-5)
            rows, s = rows[some] + first, s[some]
            near = (s >= threshold - 1e-5) & (in_b[rows][:, None] != in_a[None, lo:hi])
            if (lower := np.flatnonzero(others["home"][rows] < cell)).size:  # where the home row visits that cell, the pair counts there
                of = others["home"][rows[lower]]
                near[lower] &= (home["cells"][lo:hi, of >> 3] >> (7 - (of & 7)).astype(np.uint8) & 1).T == 0
            r, c = np.nonzero(near & (s <= threshold + 1e-5))  # decided in double precision
            for i in range(0, len(r), 1 << 16):
                x, y = b[rows[r[i : i + (1 << 16)]]].astype(np.float64), a[lo + c[i : i + (1 << 16)]].astype(np.float64)
                near[r[i : i + (1 << 16)], c[i : i + (1 << 16)]] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= threshold
            keep = np.flatnonzero(near.any(1))
            rows, near = rows[keep], near[keep]
            links_b[rows] += near @ home["copies"][lo:hi]
            mine = np.where(others["home"][rows] == cell, 0, others["copies"][rows])
            links_a[lo:hi] += mine @ near
            for i, row in enumerate(rows.tolist()):
                forest.join(np.append(in_a[lo:hi][near[i]], in_b[row]))
    return np.rint(links_a).astype(np.int64), np.rint(links_b).astype(np.int64), forest


@lean
def _compare(batches: Iterator[pa.RecordBatch], length: int, threshold: float, k: int, kind: type) -> Iterator[pa.RecordBatch]:
    home: dict[str, np.ndarray] = {}
    for rows in grouped(batches, ["place", "visitor"]):
        got = {"e": unpacked(rows["e"], length, kind), "id": rows["rep"].to_numpy(), "copies": rows["copies"].to_numpy().astype(np.float64), "home": rows["home"].to_numpy(), "cells": _bits(rows["cells"], k)}
        place, visitor = rows["place"][0].as_py(), rows["visitor"][0].as_py()
        if not visitor:
            order, now = np.argsort(got["home"], kind="stable"), place
            home = {name: v[order] for name, v in got.items()}
            continue
        if not home or now != place:
            continue
        links_a, links_b, forest = block_links(home, got, threshold, k)
        roots = forest.ids[forest.roots(np.arange(len(forest.ids)))]
        moved = np.flatnonzero(forest.ids != roots)
        out = np.concatenate([home["id"], got["id"], forest.ids[moved]])
        root = np.concatenate([home["id"], got["id"], roots[moved]])
        links = np.concatenate([links_a, links_b, np.zeros(len(moved), np.int64)])
        keep = np.flatnonzero((links > 0) | (out != root))
        yield pa.RecordBatch.from_arrays([pa.array(out[keep]), pa.array(root[keep]), pa.array(links[keep])], ["a", "b", "links"])


def near_duplicates(df: DataFrame, spark: SparkSession, threshold: float = 0.95, per_cell: int = 2000, most_cells: int = 1024, sample: int = 20_000, reach: float | None = None) -> DataFrame:
    """Per row of df (vec_id, embedding, any others): vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those of another length than the
    commonest, link with nothing.  n_links counts other vec_ids with cosine >= threshold in double precision; component_id is
    the smallest vec_id reachable.  A row without vec_id has no links and a null component.  Rows that share a vec_id have equal
    results: those of the vector with most links.
    """
    ship(spark)
    plain = numbered(df)
    rows = plain.select(F.col(place(df, "vec_id")).cast("long").alias("vec_id"), F.col(place(df, "embedding")).alias("e"))
    length = common_length(rows, "e")
    kind = np.float32 if isinstance(rows.schema["e"].dataType, ArrayType) and isinstance(rows.schema["e"].dataType.elementType, FloatType) else np.float64
    keyed = packed(rows.where("vec_id is not null"), length, "vec_id long, e binary", kind is np.float32)
    keyed = keyed.select("vec_id", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(7), "e").alias("h2"))
    keyed = materialise(keyed, spark)
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("e").alias("e"))
    classes = materialise(classes, spark)
    n = classes.count()
    low = classes.where(F.col("h1") < int(-(1 << 63) + (1 << 64) * 2 * sample / n)) if n > 2 * sample else classes  # the sample is among these
    some = low.orderBy("h1", "h2").limit(sample).select("e").toArrow()
    reach = np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6 if reach is None else reach  # more than rounding can move a row
    if n:
        x = unpacked(some["e"], length, kind).astype(np.float64)
        centroids = spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], int(np.clip(n // per_cell, 1, most_cells)))
    else:
        centroids = np.zeros((1, length))
    k = len(centroids)
    fields = "h1 long, h2 long, rep long, copies long, e binary"
    cells = materialise(classes.mapInArrow(partial(_assign, centroids=centroids, reach=reach, kind=kind), f"{fields}, home int, cells binary"), spark)
    sizes = cells.select("home", "cells").mapInArrow(partial(_counts, k=k), "cell long, home long, rows long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("rows").alias("rows")).toArrow()
    home, met = np.zeros(k, np.int64), np.zeros(k, np.int64)
    home[sizes["cell"].to_numpy()], met[sizes["cell"].to_numpy()] = sizes["home"].to_numpy(), sizes["rows"].to_numpy()
    most = max(1, min(HOME_ROWS, BLOCK_BYTES // (length * np.dtype(kind).itemsize), max(2 * per_cell, n // 8)))
    first, number = blocks_of_cells(centroids, home, most)
    most_met = np.zeros(int((first + number).max(initial=0)) or 1, np.int64)  # at most so many rows come to a block
    for c in np.flatnonzero(number):
        most_met[first[c] : first[c] + number[c]] += met[c]
    parts = np.maximum(-(-np.minimum(most_met, n) // max(1, ALL_ROWS * most // HOME_ROWS)), 1)
    dealt = cells.mapInArrow(partial(_deal, first=first, number=number, parts=parts), "place int, visitor int, rep long, copies long, e binary, home int, cells binary")
    dealt = dealt.repartition("place").sortWithinPartitions("place", "visitor")
    found = materialise(dealt.mapInArrow(partial(_compare, length=length, threshold=threshold, k=k, kind=kind), "a long, b long, links long"), spark)
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("a", "b"), spark)
    by_class = classes.join(links, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("id"), "left")
    by_class = by_class.select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    linked = keyed.select("vec_id", "h1", "h2").join(by_class, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")))
    linked = linked.groupBy(F.col("vec_id").alias("v_")).agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("vec_id").join(linked, F.col("vec_id") == F.col("v_"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
