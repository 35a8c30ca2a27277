"""Triangles of patterns, joined value by value along the cheapest side (G1).

Three solution sets ``ab(a, b)``, ``bc(b, c)`` and ``ca(c, a)`` that share a
variable pairwise close a cycle.  Joining two of them on ``b`` first makes
``degree in ab * degree in bc`` rows for a value of ``b``, which a value with a
large share of the edges drives to the square of its degree, and the third set
then throws most of them away.  So the values of ``b`` are routed by their
exact costs, from counts by key:

* *through b*: ``ab`` with ``bc``, then ``ca`` on both ends (light values);
* *through a*: ``ab`` with ``ca`` on ``a``, then ``bc`` on ``b`` and ``c``;
* *through c*: ``bc`` with ``ca`` on ``c``, then ``ab`` on ``a`` and ``b``.

A value takes the route with the fewest intermediate rows.  The sum of these
minima is at most that of any plan which joins one pair of sets first, and a
heavy value costs no more than ``ca`` has rows for its partners.  Counts combine
before their shuffles, and a route is one row a value of ``b``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.operators.joins import shared_variables
from spoframe.session import written

ROUTES = ("b", "a", "c")


def _one_shared(x: DataFrame, y: DataFrame) -> str:
    names = shared_variables(x, y)
    if len(names) != 1:
        raise ValueError(f"the sides of a triangle share one variable each, not {names}")
    return names[0]


def _degrees(df: DataFrame, variable: str, name: str) -> DataFrame:
    return df.groupBy(variable).agg(F.count(F.lit(1)).alias(name))


def triangle_routes(ab: DataFrame, bc: DataFrame, ca: DataFrame) -> DataFrame:
    """``(b, through_b, through_a, through_c, route)``: intermediate rows by route, and the cheapest, a value of ``b``.

    A value that one of the sides lacks is in no triangle and has no row.
    """
    a, b, c = _one_shared(ca, ab), _one_shared(ab, bc), _one_shared(bc, ca)
    through_b = _degrees(ab, b, "__n").join(_degrees(bc, b, "__m"), b)
    through_a = ab.join(_degrees(ca, a, "__k"), a).groupBy(b).agg(F.sum("__k").alias("through_a"))
    through_c = bc.join(_degrees(ca, c, "__k"), c).groupBy(b).agg(F.sum("__k").alias("through_c"))
    costs = through_b.join(through_a, b).join(through_c, b)
    # a product of two counts may pass 64 bits
    rows = {"through_b": (F.col("__n").cast("double") * F.col("__m"))}
    costs = costs.select(b, *[x.alias(n) for n, x in rows.items()], *[F.col(n).cast("double").alias(n) for n in ("through_a", "through_c")])
    cheapest = F.array_min(F.array(*[F.struct(F.col(f"through_{r}").alias("n"), F.lit(i).alias("i")) for i, r in enumerate(ROUTES)]))
    return costs.withColumn("route", F.element_at(F.array(*map(F.lit, ROUTES)), cheapest["i"] + 1))


def triangle_join(ab: DataFrame, bc: DataFrame, ca: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """The rows of the natural join of the three sides (as a set of solutions: duplicates may collapse)."""
    a, b, c = _one_shared(ca, ab), _one_shared(ab, bc), _one_shared(bc, ca)
    routes = written(triangle_routes(ab, bc, ca), "triangle-routes") if routes is None else routes

    def of(df: DataFrame, route: str) -> DataFrame:
        return df.join(routes.where(F.col("route") == route).select(b), b, "left_semi")

    light = of(ab, "b").join(of(bc, "b"), b).join(ca, [c, a], "left_semi")
    over_a = of(ab, "a").join(ca, a).join(bc, [b, c], "left_semi")
    over_c = of(bc, "c").join(ca, c).join(ab, [a, b], "left_semi")
    names = [a, b, c]
    return light.select(*names).unionByName(over_a.select(*names)).unionByName(over_c.select(*names))
