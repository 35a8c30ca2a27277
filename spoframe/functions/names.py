"""Predicate -> table / column name forms, as Spark column expressions.

Five slightly different cleaning rules turn a predicate into an identifier.
All of them are kept because each one names something a user can see: a
table, a catalogue entry, a property-table column.  ``column_map`` builds the
collision-free predicate -> column mapping the property table uses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes and edge rule the name forms use.
# Java-style ``\w`` is ASCII-only, so non-ASCII letters also become "_".
NON_WORD = r"[^\w]"
NON_COLUMN_CHAR = r"[^a-zA-Z0-9_]"
# A Java-style trim drops every character <= U+0020 from both ends.
EDGE_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _col(p: Column | str) -> Column:
    return F.col(p) if isinstance(p, str) else p


def strip_enclosing_brackets(p: Column | str) -> Column:
    """Drop one enclosing ``<...>`` pair; leave anything else untouched."""
    p = _col(p)
    enclosed = p.startswith("<") & p.endswith(">") & (F.length(p) >= 2)
    return F.when(enclosed, p.substr(F.lit(2), F.length(p) - 2)).otherwise(p)


def table_name(p: Column | str) -> Column:
    """Every non-word character becomes ``_`` (brackets included)."""
    return F.regexp_replace(_col(p), NON_WORD, "_")


def metastore_name(p: Column | str) -> Column:
    """Remove every ``<``/``>``, trim, then non-word characters -> ``_``."""
    no_brackets = F.translate(_col(p), "<>", "")
    trimmed = F.regexp_replace(no_brackets, EDGE_BLANKS, "")
    return F.regexp_replace(trimmed, NON_WORD, "_")


def catalogue_name(p: Column | str) -> Column:
    """Remove every ``<``/``>`` (no trim), then non-word characters -> ``_``."""
    return F.regexp_replace(F.translate(_col(p), "<>", ""), NON_WORD, "_")


def aggregate_key_name(p: Column | str) -> Column:
    """C4: strip only an enclosing bracket pair, then non-word characters -> ``_``."""
    return F.regexp_replace(strip_enclosing_brackets(p), NON_WORD, "_")


def valid_column_name(p: Column | str) -> Column:
    """Strip an enclosing bracket pair, then ``[^a-zA-Z0-9_]`` -> ``_``."""
    return F.regexp_replace(strip_enclosing_brackets(p), NON_COLUMN_CHAR, "_")


def name_variants(df, p: str = "p"):
    """All five forms of ``p`` side by side (one column each)."""
    return df.select(
        F.col(p),
        table_name(p).alias("table_name"),
        metastore_name(p).alias("metastore_name"),
        catalogue_name(p).alias("catalogue_name"),
        aggregate_key_name(p).alias("aggregate_key_name"),
        valid_column_name(p).alias("valid_column_name"),
    )


def _python_column_name(p: str) -> str:
    if len(p) >= 2 and p.startswith("<") and p.endswith(">"):
        p = p[1:-1]
    return re.sub(NON_COLUMN_CHAR, "_", p) or "_"


def column_map(predicates, reserved=("s",)) -> dict[str, str]:
    """Collision-free property-table column for each predicate.

    Spark resolves column names case-insensitively by default, so names that
    differ only by case collide too.  Predicates are taken in sorted order; the
    first keeps the clean name, later ones get ``_2``, ``_3``, ...  Runs on the
    driver over the catalogue (one entry per predicate), never over data.
    """
    taken = {r.lower() for r in reserved}
    out: dict[str, str] = {}
    for p in sorted(set(predicates)):
        base = _python_column_name(p)
        name, k = base, 1
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name.lower())
        out[p] = name
    return out
