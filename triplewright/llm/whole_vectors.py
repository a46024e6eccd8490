"""Vectors of whole numbers for the exact searches: what takes part, and products without rounding.

A component x counts as floor(256 * x), x as double. A row takes part if it has an
id, and a vector without null or non-finite components; a vector without components
does, its products are 0. Of vectors of different lengths the shorter counts as
followed by zeros. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.llm.batches import portable

SCALE = 256
#: Whole numbers below it are exact in a double, and so are their sums.
EXACT = 1 << 53


def whole_rows(df: DataFrame, id_col: str, vector_col: str, **carry: Column) -> DataFrame:
    """row (unique once written), vec_id, the carried columns, vec: array<long>."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & ~odd)
    vec = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), *[c.alias(n) for n, c in carry.items()], vec.alias("vec"))


def matrix(lists: pa.Array) -> np.ndarray:
    """(rows, greatest length) of a list column, shorter lists followed by zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest signed kind that holds them."""
    least, most = int(a.min(initial=0)), int(a.max(initial=0))
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def reach(a: np.ndarray) -> int:
    return max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int64 a @ b.T of whole-number rows; columns that one side lacks count as zeros."""
    d = min(a.shape[1], b.shape[1])
    most = reach(a) * reach(b) * max(d, 1)
    if most >= 1 << 63:
        raise OverflowError("inner products pass 64 bits")
    if most < EXACT:
        return (a[:, :d].astype(np.float64) @ b[:, :d].astype(np.float64).T).astype(np.int64)
    return a[:, :d].astype(np.int64) @ b[:, :d].astype(np.int64).T


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def best_of(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each group: higher scores first, ties by smaller id; ordered by group and rank."""
    order = np.lexsort((ident, -score, group))
    held = group[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.empty(0, np.int64)
    place = np.arange(len(held)) - np.repeat(first, np.diff(first, append=len(held)))
    return order[place < k]


portable(__name__)
