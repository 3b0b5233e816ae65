"""Column functions that several sources and operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """A text that sorts names as people do, by the value of the numbers in them: a2 before a10."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)))


def relabelled(column: Column, names: dict) -> Column:
    """Values replaced by a small map; those that it lacks stay."""
    if not names:
        return column
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, column), column)
