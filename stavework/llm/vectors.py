"""Vectors as rows of raw bytes: unit length in double precision, or null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm._env import project


def raw(column: pa.Array) -> list[np.ndarray | None]:
    """Rows of a list column as double arrays; null where the row or a component is."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    ends = np.concatenate(([0], np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().fill_null(0))).astype(int))))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for ok, a, b in zip(valid, ends, ends[1:])]


def usable(v: np.ndarray | None) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # keeps squares in range
    return v / np.sqrt((v * v).sum())


def unit_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, raw): v holds the unit vector's bytes, raw the original's; both null for
    vectors that are null, empty, zero or hold null or non-finite components."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [v if usable(v) else None for v in raw(batch.column("e"))]
            yield pa.record_batch([batch.column("id"), pa.array([None if v is None else unit(v).tobytes() for v in rows], pa.binary()), pa.array([None if v is None else v.tobytes() for v in rows], pa.binary())], schema=schema)

    rows = project(vectors, id=vec_id, e=embedding).select(F.col("id").cast("long").alias("id"), F.col("e").cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "id long, v binary, raw binary")


def matrix(rows) -> np.ndarray:
    rows = list(rows)
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)
