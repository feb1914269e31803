"""Vectors as packed rows, and the merge of local best lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(df: DataFrame, id_col: str, vector_col: str, zeros: bool = True) -> DataFrame:
    """vec_id long, v array<double> of the rows whose id and vector are whole: no null, no null or non-finite component.

    zeros=False drops zero (and empty) vectors too. Of rows that share an id, the one whose vector comes first stays.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    if not zeros:
        df = df.filter(F.exists("v", lambda x: x != 0))
    return df.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.arange(width)[None] < size[:, None]] = flat
    return out


def merged(found: DataFrame, k: int, order: F.Column) -> DataFrame:
    """The k best rows of each query_id by `order`, ties to the smaller vec_id, ranked from 1."""
    own = Window.partitionBy("query_id").orderBy(order, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
