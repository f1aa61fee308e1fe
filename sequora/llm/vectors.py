"""What the vector operators share: usable vectors, and moving them through Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(df: DataFrame, column: str) -> int:
    """The commonest length of vectors that are not empty (the smallest of equally common ones); 1 without any."""
    row = df.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 1


def _pack(batches: Iterator[pa.RecordBatch], length: int, narrow: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e = batch.column("e")
        keep = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(e), length), False)
        batch = batch.filter(keep)
        flat = batch.column("e").flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        if flat.null_count:
            ok &= ~np.asarray(flat.is_null()).reshape(-1, length).any(1)
        x = x[ok] + 0.0  # -0.0 and 0.0 are one
        rest = batch.filter(pa.array(ok)).drop_columns(["e"])
        if narrow:
            x = x.astype(np.float32)
        yield rest.append_column("e", pa.array([r.tobytes() for r in x], pa.binary()))


def packed(df: DataFrame, length: int, schema: str, narrow: bool = False) -> DataFrame:
    """df, whose vector column is e, with the usable vectors of this length as bytes of doubles; other rows go.

    `schema`: the other columns and then e binary.  `narrow`: as bytes of single precision, for vectors that are stored so."""
    return df.mapInArrow(partial(_pack, length=length, narrow=narrow), schema)


def unpacked(column: pa.ChunkedArray | pa.Array, length: int, kind: type = np.float64) -> np.ndarray:
    return flat_bytes(column).view(kind).reshape(-1, length)


def flat_bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column without nulls, in one copy."""
    parts = []
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(a):
            ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
            parts.append(np.frombuffer(a.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)
