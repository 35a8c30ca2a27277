"""Random small graphs and random connected patterns: match() against brute force."""

import itertools
import os
import random

import pytest
from conftest import triples_df

from spoframe.operators import Var
from spoframe.plans import TripleStore, load_store, match

PREDICATES = ["p", "q", "r", "t"]
NODES = [f"n{i}" for i in range(5)]


def brute_force(triples, patterns, select):
    """All bindings by backtracking over the (deduplicated) triples."""
    facts = set(triples)
    out = set()

    def term_ok(term, value, env):
        if isinstance(term, Var):
            if term.name in env:
                return env[term.name] == value, env
            return True, {**env, term.name: value}
        return term == value, env

    def go(i, env):
        if i == len(patterns):
            out.add(tuple(env[v] for v in select))
            return
        s, p, o = patterns[i]
        for fs, fp, fo in facts:
            if fp != p:
                continue
            ok, env2 = term_ok(s, fs, env)
            if not ok:
                continue
            ok, env3 = term_ok(o, fo, env2)
            if ok:
                go(i + 1, env3)

    go(0, {})
    return sorted(out)


def random_case(rng):
    n = rng.randint(40, 90)
    triples = [(rng.choice(NODES), rng.choice(PREDICATES), rng.choice(NODES)) for _ in range(n)]
    triples += rng.sample(triples, k=min(3, len(triples)))  # exact duplicates
    names = ["a", "b", "c", "d"]
    patterns = []
    bound = [rng.choice(names)]
    for _ in range(rng.randint(1, 4)):
        def term(fresh_ok=True):
            roll = rng.random()
            if roll < 0.12:
                return rng.choice(NODES)
            if roll < 0.65 or not fresh_ok:
                return Var(rng.choice(bound))
            v = rng.choice(names)
            return Var(v)

        s = term()
        o = term()
        # keep the pattern set connected: reuse a bound variable
        if not any(isinstance(x, Var) and x.name in bound for x in (s, o)):
            s = Var(rng.choice(bound))
        for x in (s, o):
            if isinstance(x, Var) and x.name not in bound:
                bound.append(x.name)
        patterns.append((s, rng.choice(PREDICATES), o))
    variables = []
    for s, _, o in patterns:
        for x in (s, o):
            if isinstance(x, Var) and x.name not in variables:
                variables.append(x.name)
    select = rng.sample(variables, k=rng.randint(1, len(variables)))
    return triples, patterns, select


CASES = [random_case(random.Random(seed)) for seed in range(16)]
# patterns connected only through a shared constant subject
_GRAPH = random_case(random.Random(100))[0]
CASES += [(_GRAPH, [("n1", "p", Var("a")), ("n1", "q", Var("b"))], ["a", "b"])]
# a constant object links nothing: alone, with a subject, or beside a star
APART = [
    [(Var("a"), "p", "n2"), (Var("b"), "q", "n2")],
    [(Var("a"), "p", "n2"), ("n2", "q", Var("b")), (Var("b"), "r", Var("c"))],
    [(Var("a"), "p", "n2"), (Var("a"), "q", Var("b")), ("n2", "r", Var("c"))],
]


@pytest.mark.parametrize("patterns", APART)
def test_constant_objects_do_not_connect(spark, patterns):
    store = TripleStore.from_triples(triples_df(spark, _GRAPH))
    with pytest.raises(ValueError):
        match(store, patterns)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_random_patterns_match_brute_force(spark, tmp_out, case):
    triples, patterns, select = CASES[case]
    expected = brute_force(triples, patterns, select)
    df = triples_df(spark, triples)
    stored = load_store(df, os.path.join(tmp_out, "store"))
    in_memory = TripleStore.from_triples(df, with_property_table=True)
    configs = [(stored, layout, reduce) for layout, reduce in itertools.product(["vp", "mixed"], [False, True])]
    configs += [(in_memory, "mixed", False), (in_memory, "vp", True)]
    for store, layout, reduce in configs:
        got = match(store, patterns, select, layout=layout, reduce=reduce)
        rows = sorted(tuple(r[v] for v in select) for r in got.collect())
        assert rows == expected, (patterns, select, layout, reduce)
