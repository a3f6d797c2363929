"""Vector tables: usable rows, blocks of bounded size, and columns as arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def is_finite(vector: str) -> Column:
    """True for an array without null, NaN or infinite components; false for a null array."""
    bound = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < bound), F.lit(False))), F.lit(False))


def block_count(df: DataFrame, rows: int, most: int = 65_536, least: int = 1_024) -> int:
    """Blocks for ``rows`` rows: one per shuffle partition, but none is planned above ``most`` or below ``least`` rows."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most), min(partitions, -(-rows // least)))


def block_of(columns: Sequence[str], blocks: int, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(blocks)).cast("int")


def all_blocks(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """(rows, width) array of a list column; shorter vectors end in zeros. Default width: the longest vector."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    longest = int(sizes.max()) if len(sizes) else 0
    width = longest if width is None else width
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    inside = np.arange(longest)[None, :] < sizes[:, None]
    wide = np.zeros((len(sizes), longest), values.dtype)
    wide[inside] = values
    out[:, :min(width, longest)] = wide[:, :width]
    return out
