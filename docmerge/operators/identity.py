"""What tells files apart: a file id means something in its session only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identity of a file and of its results.
ID = ("session_id", "file_id")


def id_columns(*frames: DataFrame) -> list[str]:
    """The columns of ``ID`` that all frames have; tables without sessions go by file id alone."""
    return [c for c in ID if all(c in f.columns for f in frames)]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys; the keys of ``left`` stay, ``right`` adds its other columns.

    Keys are compared one by one, as texts: rows are sorted by their first bytes, which a struct does not have.
    """
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    names = [f"__key{i}" for i in range(len(keys))]
    other = right.select(*[F.col(k).cast("string").alias(f"{n}_right") for n, k in zip(names, keys)], *added)
    mine = left.withColumns({n: F.col(k).cast("string") for n, k in zip(names, keys)})
    met = F.lit(True)
    for n in names:
        met = met & F.col(n).eqNullSafe(F.col(f"{n}_right"))
    return mine.join(other, met, how).drop(*names, *[f"{n}_right" for n in names])


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A number of the row's content, to settle what nothing else settles."""
    return F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if _hashable(f.dataType)])
