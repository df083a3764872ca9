"""Shared plumbing of the training-data operators: size-checked joins, batches, and scratch tables from sources.scratch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import fits
from ..sources.scratch import drop, forget, materialize, new_path, shared_dir

__all__ = ["arrow_batch", "attach", "drop", "forget", "id_filter", "materialize", "new_path", "row_hash", "shared_dir", "slices", "texts"]

#: A side is broadcast only when its counted rows are at most this many (ids: about 16 bytes each).
BROADCAST_ROWS = 500_000


def id_filter(df: DataFrame, ids: DataFrame, key: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join of ``df`` with the ids of a materialized table, whose rows are counted first.

    Up to ``limit`` ids are broadcast, so that the wide side isn't shuffled; beyond it the join is
    left to the shuffle (with skew splitting by AQE).
    """
    ids = ids.select(key).distinct()
    small = ids.count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's plain columns (maps have none, so nested columns are left out), the same whenever a task is run again."""
    return F.xxhash64(F.lit(0), *(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))))


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str], rows: int, how: str = "left", salts: int = 16, limit: int = 20_000, sized: bool = False) -> DataFrame:
    """Join a small parameter table (``rows`` rows, counted by the caller) to a large one.

    Small tables are broadcast; sized: only after their bytes were summed too, for values of any length. Larger ones are repeated ``salts`` times and joined on a salt as
    well, so that a key with a third of all rows is spread over that many tasks.
    """
    if rows <= limit and (not sized or fits(params, limit)):
        return df.join(F.broadcast(params), list(keys), how)
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(row_hash(df), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def slices(batches: Iterable[pa.RecordBatch], size: Sequence[str], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text columns hold about ``most`` bytes in each piece.

    A single longer row comes alone, whole.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        width = np.zeros(batch.num_rows, np.int64)
        for name in size:
            width += np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0)).astype(np.int64)
        total = np.cumsum(width)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null counts as empty."""
    column = batch.column(name)
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
