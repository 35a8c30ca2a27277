"""spoframe: subject-predicate-object data on Spark DataFrames.

Load triples (text or relational tables), profile their predicates, lay them
out as a predicate-partitioned dataset and as a one-row-per-subject property
table, and answer conjunctive graph patterns over either layout or both.
"""

from spoframe.operators import Pattern, Var
from spoframe.plans import TripleStore, load_store, match, match_all
from spoframe.session import shared_dir

__all__ = ["Pattern", "TripleStore", "Var", "load_store", "match", "match_all", "shared_dir"]
