"""Embedding vectors as integers: what whitening and clustering share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(rows: DataFrame, below: float, shift: int = 0) -> DataFrame:
    """vec_id and x, an array of longs floor(64 * c) + shift, of rows (vec_id, embedding). Rows go whose vector is null or has an entry that is null or not finite, or for which 64 * c reaches below, beyond which the sums that follow aren't whole numbers of 64 bits."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * 64)
    fits = F.forall(scaled, lambda c: c.isNotNull() & (F.abs(c) < below))  # a NaN is larger than any number
    return rows.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & fits).select("vec_id", F.transform(scaled, lambda c: F.floor(c) + F.lit(shift).cast("long")).alias("x"))


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the lists: it, the places of the rows that have it, and their entries as a matrix."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(at)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, values[at[rows][:, None] + np.arange(n)]
