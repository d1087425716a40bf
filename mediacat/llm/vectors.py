"""Vectors as whole numbers: which rows count, matrices of Arrow columns, exact products, sums of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of a whole component: distances and products of up to 512 components then fit 64 bits.
MOST = 1 << 24
#: Up to this size, products of up to 512 components are exact in double precision.
EXACT = 1 << 21


def whole(x: Column) -> Column:
    """floor(256 * x), x as double; a component beyond MOST is an error, since its distances would not fit 64 bits."""
    y = F.floor(x.cast("double") * 256)
    return F.when(F.abs(x.cast("double")) * 256 < MOST, y.cast("int")).otherwise(F.raise_error(F.lit("a vector's component is too large")).cast("int"))


def whole_vectors(rows: DataFrame, vec_col: str, size: int | None, **columns: Column) -> DataFrame:
    """The given columns and x, the whole components, of rows whose vector is not null and holds neither null nor
    non-finite components; with a size, of vectors of that many components only."""
    v = F.col(vec_col)
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    good = good if size is None else good & (F.size(v) == size)
    return rows.filter(good).select(*[c.alias(n) for n, c in columns.items()], F.transform(v, whole).alias("x"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A row of `size` whole numbers for each list; shorter lists end in zeros."""
    width = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    if (width == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(width), size), np.int64)
    row = np.repeat(np.arange(len(width)), width)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact: in double precision where that is, else in integers."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT and a.shape[1] <= 512:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def group_sums(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of x of each of n groups, exact: components are at most 2^24, batches below 2^28 rows."""
    return np.stack([np.bincount(group, weights=x[:, i], minlength=n) for i in range(x.shape[1])], axis=1).astype(np.int64)


def totals(sums: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, total): sums (array) of many tasks added up by position, exact whatever the number of rows."""
    rows = sums.select(*keys, F.posexplode("sums").alias("i", "v"))
    return rows.groupBy(*keys, "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total"))
