"""Basic-graph-pattern matching over a :class:`TripleStore` (G1, G3, D-2..D-5, B13, E7).

``match`` turns a conjunction of patterns into one DataFrame plan:

1. *units*: with ``layout="mixed"``, patterns sharing a subject whose
   predicates are all in the property table become one star scan when there
   are at least ``min_group_size`` of them; every other pattern is a scan of
   its predicate's rows.
2. *connectivity*: units must be connected through shared variables;
   otherwise a ``ValueError`` is raised on the driver before any job runs.
3. *order* (G3): the first unit is one with a constant, else a star unit
   (score 1/n), else the lowest ``size * log_1.2(distinct_subjects)``; each
   next unit must share a variable with the units already taken, so no step
   is a cross product, and among those the smallest estimated fan-out wins
   (statistics), else the lowest score, else input order.
4. optional *reduction* (``reduce=True``): an upward and a downward pass of
   semi-joins over the spanning tree of that order (Yannakakis).
5. joins on all shared variables, the projection, ``DISTINCT``.  Only what is
   selected or joined later is carried: a variable of one unit alone is a NOT
   NULL test or a semi-join, a unit that adds nothing carried is a semi-join,
   and a variable is dropped after its last join.

Three single patterns that share a variable pairwise (a triangle) are one unit,
joined value by value along the cheapest side (``cycles="split"``).

Constant-only patterns are existence tests: an uncorrelated ``EXISTS`` that
Spark evaluates once as a subquery and applies as a filter.
"""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.operators.cycles import triangle_join
from spoframe.operators.joins import semijoin
from spoframe.operators.patterns import Pattern, Var, as_pattern, scan_pattern, scan_star
from spoframe.operators.profile import COST_LOG_BASE
from spoframe.plans.store import TripleStore
from spoframe.session import Scratch
from spoframe.sources.layouts import quoted, write_result


@dataclass
class Unit:
    patterns: list[Pattern]
    star: bool
    keys: dict[str, str] = field(default_factory=dict)  # shared constant -> key column
    sides: list[Unit] = field(default_factory=list)  # the three units of a triangle

    @property
    def constants(self) -> set[str]:
        return {t for pat in self.patterns for t in (pat.s, pat.o) if not isinstance(t, Var)}

    @property
    def variables(self) -> list[str]:
        """Variables plus the key columns of shared constants: what this unit joins on."""
        out: list[str] = sorted(self.keys[c] for c in self.constants if c in self.keys)
        for pat in self.patterns:
            for v in pat.variables:
                if v not in out:
                    out.append(v)
        return out

    @property
    def has_constant(self) -> bool:
        return any(not isinstance(t, Var) for pat in self.patterns for t in (pat.s, pat.o))

    def frame(self, store: TripleStore, needed: set[str] | None = None, shared: dict | None = None) -> DataFrame:
        """The unit's solutions; only ``needed`` variables (default: all) are columns.

        ``shared``: written scans of a batch (see :func:`match_all`), by :func:`scan_key`.
        """
        if self.sides:
            return triangle_join(*[u.frame(store, shared=shared) for u in self.sides])
        if self.star:
            items = [(pat.p, pat.o) for pat in self.patterns]
            subject = self.patterns[0].s
            table = store.properties_of(subject) if isinstance(subject, str) else store.property_table
            return scan_star(
                table, store.pt_columns, subject, items, self.keys, needed, lists=store.lists, rows=store.rows
            )
        pat = self.patterns[0]
        rows = (shared or {}).get(scan_key(pat))
        return scan_pattern(store.rows(pat.p) if rows is None else rows, pat, self.keys, needed)


def scan_key(pat: Pattern) -> tuple:
    """What a pattern reads, whatever its variables are called."""
    s, o = (None if isinstance(t, Var) else t for t in (pat.s, pat.o))
    return (pat.p, s, o, isinstance(pat.s, Var) and pat.s == pat.o)


def _units(store: TripleStore, patterns: list[Pattern], layout: str, min_group_size: int) -> list[Unit]:
    if layout == "vp" or store.property_table is None:
        if layout not in ("vp", "mixed"):
            raise ValueError(f"layout must be 'vp' or 'mixed', got {layout!r}")
        return [Unit([p], False) for p in patterns]
    if layout != "mixed":
        raise ValueError(f"layout must be 'vp' or 'mixed', got {layout!r}")
    groups: dict[object, list[Pattern]] = {}
    for pat in patterns:
        if pat.p in store.pt_columns:
            groups.setdefault(pat.s, []).append(pat)
    units: list[Unit] = []
    starred: set[int] = set()
    for members in groups.values():
        if len(members) >= min_group_size:
            units.append(Unit(members, True))
            starred.update(id(m) for m in members)
    for pat in patterns:
        if id(pat) not in starred:
            units.append(Unit([pat], False))
    # keep input order: by the position of each unit's first pattern
    position = {id(p): i for i, p in enumerate(patterns)}
    return sorted(units, key=lambda u: position[id(u.patterns[0])])


def close_triangles(units: list[Unit]) -> list[Unit]:
    """The units with each triangle of single patterns as one unit, where the first of its patterns was.

    Only patterns of two variables and no constant count: a constant already
    makes its unit a good start.
    """
    out = list(units)
    while True:
        plain = [u for u in out if not u.star and not u.sides and len(u.variables) == 2 and not u.has_constant]
        for sides in itertools.combinations(plain, 3):
            shared = [set(x.variables) & set(y.variables) for x, y in itertools.combinations(sides, 2)]
            if all(len(v) == 1 for v in shared) and len(set().union(*shared)) == 3:
                first, second, third = sides  # ab, and the two others as bc and ca
                whole = Unit([p for u in sides for p in u.patterns], False, sides=[first, second, third])
                out = [whole if u is first else u for u in out if u is not second and u is not third]
                break
        else:
            return out


def _parts(units: list[Unit]) -> list[list[int]]:
    """The units in groups that share variables (or key columns)."""
    parts: list[tuple[set[str], list[int]]] = []
    for i, u in enumerate(units):
        names, members = set(u.variables), [i]
        for part in [q for q in parts if q[0] & names]:
            parts.remove(part)
            names, members = names | part[0], part[1] + members
        parts.append((names, members))
    return [sorted(members) for _, members in parts]


def share_subjects(units: list[Unit]) -> None:
    """Groups without a common variable are linked by a common constant *subject*.

    ``'s' p ?x . 's' q ?y`` shares no variable, yet it is one star on ``'s'``:
    every ``x`` with every ``y``.  One unit of each group gets a key column
    with the matched subject.  Units that variables link get none, and a
    constant object never links.
    """
    subjects = [sorted({t for t in (pat.s for pat in u.patterns) if not isinstance(t, Var)}) for u in units]
    numbers = {c: k for k, c in enumerate(sorted({c for s in subjects for c in s}))}
    for c in numbers:
        holders = [[i for i in part if c in subjects[i]] for part in _parts(units)]
        holders = [h for h in holders if h]
        if len(holders) > 1:
            for h in holders:
                units[h[0]].keys[c] = f"__const{numbers[c]}"


def check_connected(units: list[Unit]) -> None:
    """Every unit must reach every other through shared variables."""
    parts = _parts(units)
    if len(parts) > 1:
        apart = [units[i].patterns for part in parts[1:] for i in part]
        raise ValueError(f"patterns are not connected by shared variables: {apart}")


def _scores(units: list[Unit], stats: dict[str, tuple[int, int, int]] | None) -> list[float]:
    out = []
    for u in units:
        if u.has_constant:
            out.append(0.0)
        elif u.sides:
            out.append(sum(_scores(u.sides, stats)))
        elif u.star:
            out.append(1.0 / len(u.patterns))
        elif stats is None:
            out.append(1.0)
        else:
            size, distinct, _ = stats.get(u.patterns[0].p, (0, 0, 0))
            out.append(size * math.log(distinct) / math.log(COST_LOG_BASE) if size and distinct else 0.0)
    return out


def fanout(unit: Unit, bound: set[str], stats: dict[str, tuple[int, int, int]]) -> float:
    """Estimated rows ``unit`` adds per row already joined, from the statistics.

    A pattern reached through its subject multiplies by ``size / distinct
    subjects``, through its object by ``size / distinct objects``, through
    both by ``size / (distinct subjects * distinct objects)``.  Patterns of a
    star are taken in the order they get bound (the subject binds them all).
    """
    known = set(bound)
    todo = list(unit.patterns)
    est = 1.0
    while todo:
        def is_bound(t):
            return not isinstance(t, Var) or t.name in known

        pat = next((q for q in todo if is_bound(q.s) or is_bound(q.o)), todo[0])
        todo.remove(pat)
        size, ds, do = stats.get(pat.p, (0, 0, 0))
        if not size:
            return 0.0
        s_in, o_in = is_bound(pat.s), is_bound(pat.o)
        if s_in and o_in:
            est *= size / (ds * do)
        elif s_in:
            est *= size / ds
        elif o_in:
            est *= size / do
        else:
            est *= size
        known.update(pat.variables)
    return est


def order_units(
    units: list[Unit], scores: list[float], stats: dict[str, tuple[int, int, int]] | None = None
) -> list[int]:
    """Lowest score first (ties: fewest estimated rows); then, among units
    sharing a variable with those taken, the smallest estimated fan-out (with
    statistics) and the lowest score."""
    remaining = list(range(len(units)))
    first = min(remaining, key=lambda i: (scores[i], fanout(units[i], set(), stats) if stats else 0.0, i))
    order, bound = [first], set(units[first].variables)
    remaining.remove(first)
    while remaining:
        linked = [i for i in remaining if bound.intersection(units[i].variables)]
        if stats:
            nxt = min(linked, key=lambda i: (fanout(units[i], bound, stats), scores[i], i))
        else:
            nxt = min(linked, key=lambda i: (scores[i], i))
        order.append(nxt)
        bound.update(units[nxt].variables)
        remaining.remove(nxt)
    return order


def _query_stats(store: TripleStore, units: list[Unit]) -> dict[str, tuple[int, int, int]] | None:
    return store.stats_for({pat.p for u in units for pat in u.patterns})


def _tree(units: list[Unit]) -> list[int | None]:
    """Parent of each unit (in join order): the first earlier unit sharing a variable."""
    parent: list[int | None] = [None]
    for i in range(1, len(units)):
        mine = set(units[i].variables)
        parent.append(next(j for j in range(i) if mine.intersection(units[j].variables)))
    return parent


def reduce_frames(
    units: list[Unit],
    frames: list[DataFrame],
    materialize: bool = True,
    reducible: list[bool] | None = None,
    scratch: Scratch | None = None,
) -> list[DataFrame]:
    """D-3, D-4: upward (children into parents) then downward semi-join passes.

    Each reduced node feeds its parent, its children and the final join, and
    the downward pass nests every ancestor, so a lazy plan re-reads inputs a
    number of times that grows with the square of the query size.  With
    ``materialize`` every node that reduces others is written once, as Parquet
    with its statistics, when it is final: parents before children, nodes of one
    depth side by side.  The final join then reads short scans whose sizes
    Spark knows.  ``reducible[i]`` False skips the semi-joins at parent ``i`` in
    both passes (the gate of ``reduce="auto"``); by default every parent takes
    part.  The tables go with ``scratch``.
    """
    frames = list(frames)
    gate = reducible or [True] * len(units)
    parent = _tree(units)
    children: list[list[int]] = [[] for _ in units]
    depth = [0] * len(units)
    for i, p in enumerate(parent):
        if p is not None:
            children[p].append(i)
            depth[i] = depth[p] + 1
    scratch = scratch or Scratch(frames[0].sparkSession)
    reduces = [gate[i] and bool(children[i]) for i in range(len(units))]

    # upward pass, post-order (children have larger indices than parents): lazy
    for i in reversed(range(len(units))):
        if reduces[i]:
            for c in children[i]:
                frames[i] = semijoin(frames[i], frames[c])
    # downward pass by depth: a node is final before its children use it; a
    # leaf is read once, by the final join, and stays lazy
    with ThreadPoolExecutor(max_workers=4) as pool:
        for level in range(max(depth) + 1):
            nodes = [i for i in range(len(units)) if depth[i] == level and reduces[i]]
            if materialize:
                kept = list(pool.map(scratch.keep, [frames[i] for i in nodes]))
                for i, df in zip(nodes, kept, strict=True):
                    frames[i] = df
            for i in nodes:
                for c in children[i]:
                    frames[c] = semijoin(frames[c], frames[i])
    return frames


def match(
    store: TripleStore,
    patterns,
    select: list[str] | None = None,
    *,
    layout: str = "vp",
    min_group_size: int = 2,
    reduce: bool | str = False,
    use_stats: bool = True,
    materialize: bool = True,
    cycles: str = "split",
    scratch: Scratch | None = None,
    shared: dict | None = None,
) -> DataFrame:
    """G1: the DISTINCT solutions of a connected conjunction of patterns.

    ``select`` lists the variables to return (default: all, in order of first
    appearance; names may differ only by case or hold dots).  ``layout`` is
    ``"vp"`` or ``"mixed"``.  ``reduce=True`` adds
    the semi-join passes at every node; ``reduce="auto"`` only at single
    patterns whose predicate is multi-valued (``size > distinct_subjects`` in
    the statistics; without statistics there is no reduction).
    With a reduction, ``materialize`` (default) writes each reduced input that
    is read again under the shared folder (``spark.checkpoint.dir``);
    ``materialize=False`` keeps the whole reduction lazy (one plan, fine for a
    few patterns).  With a ``scratch`` the tables go when it is closed.
    ``cycles="split"`` joins triangles value by value along the cheapest side,
    ``"plain"`` pattern by pattern.  ``shared``: scans of a batch.
    """
    if reduce not in (True, False, "auto"):
        raise ValueError(f"reduce must be True, False or 'auto', got {reduce!r}")
    if cycles not in ("split", "plain"):
        raise ValueError(f"cycles must be 'split' or 'plain', got {cycles!r}")
    pats = [as_pattern(x) for x in patterns]
    if not pats:
        raise ValueError("match needs at least one pattern")
    variables: list[str] = []
    for pat in pats:
        for v in pat.variables:
            if v not in variables:
                variables.append(v)
    wanted = variables if select is None else list(select)
    unknown = [v for v in wanted if v not in variables]
    if unknown:
        raise ValueError(f"selected variables not in any pattern: {unknown}")
    if len(set(wanted)) != len(wanted):
        raise ValueError(f"a variable is selected twice: {wanted}")

    # inside, variables have names that dots and cases cannot confuse
    inner = {v: f"v{i}" for i, v in enumerate(variables)}
    pats = [Pattern(*(Var(inner[t.name]) if isinstance(t, Var) else t for t in (p.s, p.p, p.o))) for p in pats]
    chosen = [inner[v] for v in wanted]

    ground = [p for p in pats if not p.variables]
    units = _units(store, [p for p in pats if p.variables], layout, min_group_size)
    share_subjects(units)
    check_connected(units)
    if cycles == "split":
        units = close_triangles(units)

    if units:
        stats = _query_stats(store, units) if use_stats else None
        order = order_units(units, _scores(units, stats), stats)
        units = [units[i] for i in order]
        # what each unit returns: variables that are selected or that another unit has
        carried = []
        for i, u in enumerate(units):
            others = {v for j, w in enumerate(units) if j != i for v in w.variables}
            carried.append([v for v in u.variables if v in others or v in chosen])
        frames = [u.frame(store, set(c), shared) for u, c in zip(units, carried, strict=True)]
        if reduce == "auto":
            gate = [bool(stats) and not u.star and not u.sides and _multivalued(stats, u.patterns[0].p) for u in units]
            if any(gate) and len(frames) > 1:
                frames = reduce_frames(units, frames, materialize, gate, scratch)
        elif reduce and len(frames) > 1:
            frames = reduce_frames(units, frames, materialize, scratch=scratch)
        result = _join(units, frames, carried, chosen)
    else:
        result = store.spark.range(1).select()
    for pat in ground:
        result = result.where(scan_pattern(store.rows(pat.p), pat).exists())
    result = result.select(*[F.col(c).alias(v) for c, v in zip(chosen, wanted, strict=True)])
    return result if len(units) == 1 and _no_duplicates(store, units[0], chosen) else result.distinct()


def _no_duplicates(store: TripleStore, unit: Unit, chosen: list[str]) -> bool:
    """Whether a star's rows are distinct as they are: a subject has one row, and a chunked list each value once."""
    if not unit.star or store.lists is None or not set(unit.variables) <= set(chosen):
        return False
    # a constant among a list's values is looked up in the rows, which may repeat it
    return not any(store.pt_columns[p.p].is_list and not isinstance(p.o, Var) for p in unit.patterns)


def _join(units: list[Unit], frames: list[DataFrame], carried: list[list[str]], chosen: list[str]) -> DataFrame:
    """The join of the units in order, with semi-joins where one side adds nothing that is used later."""
    result, bound = frames[0], list(carried[0])
    for i in range(1, len(units)):
        later = set(chosen).union(*(carried[j] for j in range(i + 1, len(units))))
        on = [v for v in carried[i] if v in bound]
        new = [v for v in carried[i] if v not in bound]
        if not later.intersection(new):
            result = result.join(frames[i].select(*on), on=on, how="left_semi")
        elif set(bound) <= set(on):
            result, bound = frames[i].join(result, on=on, how="left_semi"), list(carried[i])
        else:
            result, bound = result.join(frames[i], on=on, how="inner"), bound + new
        bound = [v for v in bound if v in later]
        result = result.select(*bound)
    return result


def _multivalued(stats: dict[str, tuple[int, int, int]], p: str) -> bool:
    size, distinct, _ = stats.get(p, (0, 0, 0))
    return size > distinct


def shared_scans(store: TripleStore, queries: dict, scratch: Scratch) -> dict:
    """The filtered scans that several queries of a batch have in common, each written once.

    Patterns are equal if they read the same, whatever their variables are
    called.  Only patterns with a constant (or ``?x P ?x``) are written: all
    rows of a predicate are a written table already.
    """
    seen: dict[tuple, set[str]] = {}
    for name, (pats, _) in queries.items():
        for pat in map(as_pattern, pats):
            key = scan_key(pat)
            if pat.variables and (key[1] is not None or key[2] is not None or key[3]):
                seen.setdefault(key, set()).add(name)
    keys = [k for k, names in seen.items() if len(names) > 1]

    def scan(key: tuple) -> DataFrame:
        p, s, o, same = key
        rows = store.rows(p)
        for column, constant in (("s", s), ("o", o)):
            if constant is not None:
                rows = rows.where(F.col(column) == F.lit(constant))
        return scratch.keep(rows.where("s = o") if same else rows)

    with ThreadPoolExecutor(max_workers=4) as pool:
        return dict(zip(keys, pool.map(scan, keys), strict=True))


def match_all(store: TripleStore, queries: dict, scratch: Scratch | None = None, **options) -> dict[str, DataFrame]:
    """Plan every named query ``{name: (patterns, select)}`` over one store.

    Filtered scans that several queries share run once: they are written to
    ``scratch`` and read by all of them (in the ``"vp"`` layout; star units read
    the property table).
    """
    shared = shared_scans(store, queries, scratch or Scratch(store.spark))
    return {
        name: match(store, pats, sel, scratch=scratch, shared=shared, **options) for name, (pats, sel) in queries.items()
    }


def tagged_union(results: dict[str, DataFrame]) -> DataFrame:
    """All results in one DataFrame: a ``query`` tag plus the union of variable columns."""
    frames = [df.select(F.lit(name).alias("query"), *map(quoted, df.columns)) for name, df in results.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_all(results: dict[str, DataFrame], base: str, mode: str = "overwrite") -> dict[str, str]:
    """A10 for a batch: one Parquet result per query under ``base/<name>``."""
    paths = {}
    for name, df in results.items():
        paths[name] = f"{base.rstrip('/')}/{name}"
        write_result(df, paths[name], mode=mode)
    return paths
