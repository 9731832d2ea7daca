"""A plan barrier for long chains of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The same rows through a generator over an array of one. Predicates and constraints on derived columns stop here and are not written out
    in terms of what they derive from, which would grow with every stage; the generator itself runs inside code generation."""
    return df.select(F.inline(F.array(F.struct("*"))))
