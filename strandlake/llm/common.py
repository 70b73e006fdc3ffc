"""Pieces the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``
SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null identifier where identifiers are compared; sorts last.
NULL_ID = (1 << 63) - 1


def fold(id_column: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier's decimal text leaves ``remainder``; false for null."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that clash with result columns (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def block_of(id_column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column)), F.lit(n)).cast("int")
