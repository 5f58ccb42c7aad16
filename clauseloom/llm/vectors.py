"""Reading, digesting and packing of vectors for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import ship

#: Vectors in a packed block.
BLOCK = 4096


def usable(x: pa.Scalar) -> np.ndarray | None:
    """The components in their own precision; None if the vector is null, empty, zero or holds null or non-finite ones."""
    if not x.is_valid or not len(x.values) or x.values.null_count:
        return None
    v = x.values.to_numpy(zero_copy_only=False)
    v = v if v.dtype in (np.float32, np.float64) else v.astype(np.float64)
    return v + v.dtype.type(0) if np.isfinite(v).all() and v.any() else None  # + 0: no negative zeros


ROW = "vec_id long, cls long, dim int, data binary, norm double"


def read(vectors: DataFrame) -> DataFrame:
    """(vec_id, cls, dim, data, norm): cls names the vector by content and is null for unusable ones, as are the rest."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [usable(x) for x in batch.column(1)]
            cls = [None if v is None else xxhash.xxh3_64_intdigest(v.astype("<f8").tobytes()) - (1 << 63) for v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, pa.int64()), pa.array([None if v is None else len(v) for v in rows], pa.int32()),
                 pa.array([None if v is None else v.tobytes() for v in rows], pa.binary()),
                 pa.array([None if v is None else float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in rows], pa.float64())],
                ["vec_id", "cls", "dim", "data", "norm"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, ROW)


def matrix(data: list[bytes], dim: int) -> np.ndarray:
    """Stored vectors of one dimension as rows of doubles; each is float or double by its own size."""
    if not data:
        return np.empty((0, dim))
    if len({len(x) for x in data}) == 1:
        kind = "<f8" if len(data[0]) == 8 * dim else "<f4"
        return np.frombuffer(b"".join(data), kind).reshape(len(data), dim).astype(np.float64)
    return np.stack([np.frombuffer(x, "<f8" if len(x) == 8 * dim else "<f4").astype(np.float64) for x in data])


def sample(rows: DataFrame, n: int) -> list:
    """At most ``n`` rows (cls, dim, data), those of the smallest hashes of cls."""
    return rows.select("cls", "dim", "data").orderBy(F.xxhash64("cls"), "cls").limit(n).collect()


def salted(cell: Column, key: Column, sizes: dict[int, int], most: int = BLOCK) -> Column:
    """Number of the block of a row: cells of more than ``most`` rows are spread over several blocks by a hash."""
    parts = [F.lit(x) for c, n in sizes.items() for x in (c, -(-n // most))]
    spread = F.coalesce(F.create_map(*parts)[cell], F.lit(1)) if parts else F.lit(1)
    return cell.cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64(key), spread)


def pack(frame: pd.DataFrame) -> bytes:
    return frame["data"].str.len().to_numpy(np.int64).tobytes() + b"".join(frame["data"])


def unpack(payload: bytes, n: int, dim: int) -> np.ndarray:
    sizes = np.frombuffer(payload, "<i8", n)
    stops = 8 * n + np.cumsum(sizes)
    return matrix([payload[b - s : b] for s, b in zip(sizes.tolist(), stops.tolist(), strict=True)], dim)
