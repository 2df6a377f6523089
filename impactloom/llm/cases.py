"""Shared treatment of null identifiers, clashing names and tables that are usually small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stands for a null identifier inside an operator; it sorts before all others.
NULL_ID = -(1 << 63)
#: Narrow tables of more rows are never broadcast by a hint.
MOST_BROADCAST = 10_000


def known(column: str) -> Column:
    """An identifier as a long, with null replaced."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def shown(column: str) -> Column:
    """The reverse of ``known``."""
    return F.nullif(F.col(column), F.lit(NULL_ID)).alias(column)


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, other letters unchanged; the general function is used only where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def if_small(df: DataFrame, rows: int, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, which has so many rows, to be broadcast if those are few, else left to the optimiser."""
    return F.broadcast(df) if rows <= most else df


def free(names: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that do not clash with ``names`` (case does not matter)."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
