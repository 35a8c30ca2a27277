"""Triple patterns and their scans.

A pattern is ``(subject, predicate, object)`` where subject and object are a
:class:`Var` or a constant string; the predicate is always a constant.  A scan
returns one ``string`` column per distinct variable, named after it.
Constants are compared verbatim through the Column API (never pasted into
SQL text), so equality filters reach the Parquet reader as pushed filters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoframe.sources.layouts import only_predicates, quoted


@dataclass(frozen=True)
class Var:
    """A query variable; ``Var("x")`` binds result column ``x``."""

    name: str

    def __post_init__(self):
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("a variable needs a non-empty name")
        if self.name.startswith("__"):
            raise ValueError("variable names starting with '__' are reserved")

    def __repr__(self):
        return f"?{self.name}"


Term = Union[Var, str]


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: str
    o: Term

    def __post_init__(self):
        for t in (self.s, self.o):
            if not isinstance(t, (Var, str)):
                raise TypeError(f"pattern terms are Var or str, got {type(t).__name__}")
        if not isinstance(self.p, str):
            raise TypeError("the predicate must be a constant string")

    @property
    def variables(self) -> list[str]:
        out = []
        for t in (self.s, self.o):
            if isinstance(t, Var) and t.name not in out:
                out.append(t.name)
        return out


def as_pattern(x) -> Pattern:
    if isinstance(x, Pattern):
        return x
    s, p, o = x
    return Pattern(s, p, o)


def _and(conds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conds) if conds else None


def scan_pattern(
    rows: DataFrame, pattern: Pattern, keys: dict[str, str] | None = None, needed: set[str] | None = None
) -> DataFrame:
    """Answer one pattern from the ``(s, o)`` rows of its predicate.

    * ``?x P ?y`` -> ``(x, y)``;  ``?x P ?x`` -> ``(x)`` with ``s = o`` (D3)
    * ``?x P 'c'`` -> ``(x)`` with ``o = 'c'``
    * ``'c' P ?y`` -> ``(y)`` with ``s = 'c'`` (D1: the subject is filtered)
    * ``'c' P 'd'`` -> no columns; one row per match (an existence test)

    ``keys`` maps a constant to a column name under which the matched value is
    also returned, so patterns sharing only that constant can still be joined.
    ``needed`` (default: all) are the variables to return; the others only
    have to exist.
    """
    pattern = as_pattern(pattern)
    keys = keys or {}
    conds = []
    cols: list[Column] = []
    named: set[str] = set()
    for pos, term in (("s", pattern.s), ("o", pattern.o)):
        if isinstance(term, Var):
            continue
        conds.append(F.col(pos) == F.lit(term))
        if term in keys and keys[term] not in named:
            cols.append(F.col(pos).alias(keys[term]))
            named.add(keys[term])
    same = isinstance(pattern.s, Var) and pattern.s == pattern.o
    if same:
        conds.append(F.col("s") == F.col("o"))
    for pos, term in (("s", pattern.s), ("o", pattern.o))[: 1 if same else 2]:
        if isinstance(term, Var) and (needed is None or term.name in needed):
            cols.append(F.col(pos).alias(term.name))
    cond = _and(conds)
    df = rows.where(cond) if cond is not None else rows
    return df.select(*cols)


def scan_star(
    table: DataFrame,
    columns: dict,
    subject: Term,
    items: list[tuple[str, Term]],
    keys: dict[str, str] | None = None,
    needed: set[str] | None = None,
    lists: DataFrame | None = None,
    rows: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    """Answer patterns sharing one subject from the property table.

    ``columns`` maps a predicate to its :class:`PTColumn`; ``items`` are the
    ``(predicate, object)`` pairs.  Order of work: subject and constant-object
    filters (pushed to the scan for single-valued columns), NOT NULL for
    variables, then the multi-valued ones; a variable bound twice becomes an
    equality filter (D8).  ``keys`` and ``needed`` as in :func:`scan_pattern`:
    a multi-valued predicate whose variable is not needed is a NOT NULL test.

    A multi-valued predicate is read from its cell (an ``explode`` of the
    distinct values), or, where the table holds only the number of values, from
    the chunked ``lists`` (see :func:`list_chunks`) joined on the subject, and a
    constant among its values from ``rows(p)``, where it is a pushed filter
    (B9).  A subject that repeats the constant counts once there, or it would
    meet its own list as often.  A star of constants in lists alone does not
    read the table.
    """
    keys = keys or {}
    uses: dict[str, int] = {}
    for _, o in items:
        if isinstance(o, Var):
            uses[o.name] = uses.get(o.name, 0) + 1
    if isinstance(subject, Var):
        uses[subject.name] = uses.get(subject.name, 0) + 1

    def wanted(term: Var) -> bool:
        return needed is None or term.name in needed or uses[term.name] > 1

    conds: list[Column] = []
    bindings: dict[str, list[str]] = {}
    extra: dict[str, Column] = {}
    # plain names inside: those of variables and columns may hold dots or differ by case only
    cells = {p: f"__c{i}" for i, p in enumerate(dict.fromkeys(p for p, _ in items))}
    if isinstance(subject, Var):
        bindings[subject.name] = ["__s"]
    else:
        conds.append(F.col("__s") == F.lit(subject))
        if subject in keys:
            extra[keys[subject]] = F.col("__s")
    explodes: list[tuple[str, str]] = []
    listed: list[DataFrame] = []  # joined on the subject
    members: list[DataFrame] = []  # subjects that hold a constant
    read = set()
    for i, (p, o) in enumerate(items):
        c = columns[p]
        cell = F.col(cells[p])
        apart = c.is_list and lists is not None
        if not isinstance(o, Var):
            if apart and rows is not None:
                members.append(rows(p).where(F.col("o") == F.lit(o)).select(F.col("s").alias("__s")).distinct())
            elif apart:
                held = only_predicates(lists, [p]).where(F.array_contains("values", F.lit(o)))
                members.append(held.select(F.col("s").alias("__s")).distinct())
            else:
                conds.append(F.array_contains(cell, F.lit(o)) if c.is_list else cell == F.lit(o))
                read.add(p)
            if o in keys and keys[o] not in extra:
                extra[keys[o]] = F.lit(o)
            continue
        if c.is_list and wanted(o):
            name = f"__x{i}"
            bindings.setdefault(o.name, []).append(name)
            if apart:
                listed.append(only_predicates(lists, [p]).select(F.col("s").alias("__s"), F.col("values").alias(name)))
                continue
            explodes.append((name, cells[p]))
        else:
            # an empty list is no list: cells hold NULL for an absent predicate
            conds.append(cell.isNotNull())
            if not c.is_list and wanted(o):
                bindings.setdefault(o.name, []).append(cells[p])
        read.add(p)
    parts = [*members, *listed]
    if read or not parts:
        df = table.select(F.col("s").alias("__s"), *[F.col(quoted(columns[p].column)).alias(cells[p]) for p in cells if p in read])
    else:
        df, parts = parts[0], parts[1:]
    on_subject = _and([c for c in conds[:1] if not isinstance(subject, Var)])
    cond = _and(conds)
    if cond is not None:
        df = df.where(cond)
    for part in parts:
        part = part if on_subject is None else part.where(on_subject)
        df = df.join(part, "__s", "left_semi" if part.columns == ["__s"] else "inner")
    for part in listed:
        # joined as chunks, so a shuffle by subject moves no row a value
        name = part.columns[1]
        df = df.withColumn(name, F.explode(name))
    for name, cell in explodes:
        df = df.withColumn(name, F.explode(F.array_distinct(cell)))
    equal = [F.col(cols[0]) == F.col(c) for cols in bindings.values() for c in cols[1:]]
    cond = _and(equal)
    if cond is not None:
        df = df.where(cond)
    out = [col.alias(k) for k, col in extra.items()]
    shown = [F.col(cols[0]).alias(v) for v, cols in bindings.items() if needed is None or v in needed]
    return df.select(*out, *shown)
