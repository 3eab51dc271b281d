"""String columns shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_source(col: Column) -> Column:
    """The catalog spelling of a source cell: case, outer blanks and the kind of word joint are ignored.

    Null and blank cells give null.
    """
    text = F.regexp_replace(F.lower(F.trim(col)), r"[-_\s]+", "_")
    return F.when(text != "", text)


def finite(col: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), F.lit(False))
