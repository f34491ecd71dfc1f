"""Text columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

LAG_SUFFIX = r"_h(\d+)$"


def truthy(c: Column) -> Column:
    """'true' or '1' in any case, with blanks around it; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def name_family(name: Column, sequence: Column) -> Column:
    """'<family>_h<k>' -> family; a name that is no sequence column stays whole."""
    stem = F.regexp_replace(name, LAG_SUFFIX, "")
    return F.when(F.array_contains(sequence, stem), stem).otherwise(name)


def name_lag(name: Column, sequence: Column) -> Column:
    """'<family>_h<k>' -> k; null when the family is no sequence column."""
    stem = F.regexp_replace(name, LAG_SUFFIX, "")
    lag = F.regexp_extract(name, LAG_SUFFIX, 1)
    return F.when(F.array_contains(sequence, stem) & (lag != ""), lag.cast("int"))
