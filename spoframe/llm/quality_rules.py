"""Learned decision lists for document quality (DataFrame functions only).

:func:`with_text_stats` adds statistics of each whole text.  :func:`fit_rules`
learns an ordered list of rules from labelled statistics by sequential
covering: a rule is grown condition by condition (best FOIL gain over
threshold conditions), pruned on rows held out from growing, kept while it is
precise enough, and the rows it covers leave before the next rule is grown.
:meth:`RuleList.rejects` is one ordered ``CASE WHEN`` expression.

The driver sees only histograms (features x cut points x 2 classes), whatever
the number of labelled rows.

Defined results: a NULL text counts as empty; empty texts have all statistics
0.  Rows without a label do not take part in fitting; without rows of either
class the list is empty and rejects nothing.  Columns of the input whose names
clash with the statistics are replaced by them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import drop_columns, quoted, shifted, squeezed, words_of, written

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

BASE_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test, as expressions over the stored counts.
COUNTS = [*BASE_STATS, "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits"]


def _per(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What conditions test, by name: counts and ratios of counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _per("word_chars", "n_words"),
        "symbol_ratio": _per("n_symbols", "word_chars"),
        "dup_line_ratio": _per("n_dup_lines", "n_lines"),
        "repeat_ratio": _per("n_repeat_words", "n_words"),
        "distinct_ratio": _per("n_distinct_words", "n_words"),
        "upper_ratio": _per("n_upper", "word_chars"),
        "mark_ratio": _per("n_marks", "word_chars"),
        "digit_ratio": _per("n_digits", "word_chars"),
    }


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of a class (as in a regular expression) a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _paired(items: Column, distance: int) -> Column:
    """Hash of each item with the item ``distance`` further on."""
    return F.zip_with(items, shifted(items, distance), lambda a, b: F.xxhash64(a, b))


def _covered_words(windows: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more.

    Sorting (hash, position) puts equal windows side by side; the positions
    that have an equal neighbour are put in order again, and each adds the
    words up to the next such window, ``width`` at most.  One row's arrays
    only, n log n in its length.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = lambda s: F.filter(
        s, lambda e, j: (F.get(s, j - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(e["h"]))
    )
    starts = lambda s: F.sort_array(F.transform(repeated(s), lambda e: e["i"]))
    total = lambda p: F.aggregate(
        F.zip_with(p, shifted(p, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    # transform over a one-item array evaluates its item once for the whole lambda
    return F.get(F.transform(F.transform(F.array(pairs), starts), total), F.lit(0))


def with_text_stats(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``df`` with the counts in :data:`COUNTS` (all long) of each whole text.

    ``n_repeat_words``: words in ``window``-word windows (a power of two) found
    twice or more in the text, the first occurrence included; windows are
    compared by 64-bit hash within one text.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    keep = drop_columns(df, COUNTS)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    tmp = ["_qs_flat", "_qs_lines", "_qs_words", "_qs_hashes", "_qs_windows"]
    flat, lines, words, hashes, windows = (F.col(c) for c in tmp)
    out = keep.withColumns(
        {
            "_qs_flat": squeezed(text),
            "_qs_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": _count_of(text, SYMBOLS).cast("long"),
            "n_upper": _count_of(text, r"\p{Lu}").cast("long"),
            "n_marks": _count_of(text, "!?.,;:").cast("long"),
            "n_digits": _count_of(text, "0-9").cast("long"),
        }
    )
    out = out.withColumns(
        {
            "_qs_words": words_of(flat),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.when(F.size(words) == 0, 0).otherwise(F.length(flat) - F.size(words) + 1).cast("long"),
            "n_distinct_words": F.size(F.array_distinct(words)).cast("long"),
            "_qs_hashes": F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    width = 1
    while width < window:
        out = out.withColumn("_qs_hashes", _paired(hashes, width))
        width *= 2
    n_windows = F.greatest(F.col("n_words") - (window - 1), F.lit(0)).cast("int")
    out = out.withColumn("_qs_windows", F.slice(hashes, F.lit(1), n_windows))
    out = out.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct(windows)) < F.size(windows), _covered_words(windows, window))
        .otherwise(F.lit(0))
        .cast("long"),
    )
    return out.select([F.col(quoted(c)) for c in keep.columns] + COUNTS)


def base_failed() -> Column:
    """The fixed rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# --------------------------------------------------------------------------
# Rules


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def expr(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def expr(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expr()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass(frozen=True)
class RuleList:
    rules: tuple[Rule, ...] = field(default=())

    def rule_number(self) -> Column:
        """The first rule that holds (from 1), or NULL: an ordered ``CASE WHEN``."""
        out = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            out = F.when(self.rules[i - 1].expr(), F.lit(i)).otherwise(out)
        return out

    def rejects(self) -> Column:
        return self.rule_number().isNotNull()


def _cut_points(labelled: DataFrame, n_cuts: int) -> dict[str, list[float]]:
    """Quantiles of each feature in either class (one row of bounded size to the driver)."""
    shares = [(i + 0.5) / n_cuts for i in range(n_cuts)]
    by_class = labelled.groupBy("_bad").agg(
        *[F.percentile_approx(name, shares, 10_000).alias(name) for name in features()]
    )
    cuts: dict[str, set[float]] = {name: set() for name in features()}
    for row in by_class.collect():  # two rows
        for name in cuts:
            cuts[name].update(row[name] or [])
    return {name: sorted(x) for name, x in cuts.items()}


def _histograms(rows: DataFrame, names: list[str]) -> dict[str, dict[int, tuple[int, int]]]:
    """Per feature and bin: bad and good rows (one job)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"b_{n}").alias("b")) for n in names]))
    counted = (
        rows.select(pairs.alias("x"), "_bad")
        .groupBy("x.f", "x.b")
        .agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n"))
    )
    out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
    for r in counted.collect():  # features x (cut points + 1) rows
        out[r["f"]][r["b"]] = (r["p"], r["n"])
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of going from (p0, n0) covered rows to (p, n)."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best_condition(hist, names) -> tuple[float, tuple[str, bool, int], tuple[int, int]] | None:
    """The condition with the best gain; ties go to the first feature, cut and side."""
    best = None
    for name in names:
        bins = hist[name]
        p0, n0 = (sum(x[i] for x in bins.values()) for i in (0, 1))
        if not p0 or not n0:
            continue
        p = n = 0
        for b in sorted(bins)[:-1]:
            p, n = p + bins[b][0], n + bins[b][1]
            for above, (cp, cn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                gain = _gain(cp, cn, p0, n0)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, (name, above, b), (cp, cn)
    return best


def _holds(condition: tuple[str, bool, int]) -> Column:
    name, above, b = condition
    return F.col(f"b_{name}") > b if above else F.col(f"b_{name}") <= b


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & _holds(c)
    return out


def fit_rules(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    n_cuts: int = 48,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.97,
    min_covered: int = 3,
) -> RuleList:
    """Learn when to reject from ``stats`` (with :data:`COUNTS`) and ``labels`` (0 bad, 1 good).

    Two thirds of the labelled rows (by hash of the id) grow rules, one third
    prunes and judges them.  All labelled rows take part.
    """
    names = list(features())
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_q")).filter("_id IS NOT NULL")
    rows = (
        stats.select(F.col(id_col).alias("_id"), *[x.alias(n) for n, x in features().items()])
        .join(marks.filter("_q IN (0, 1)"), "_id")
        .select("_id", (1 - F.col("_q")).cast("long").alias("_bad"), *names)
    )
    rows = written(rows, "rules-labelled")
    cuts = _cut_points(rows, n_cuts)
    if not all(cuts.values()):
        return RuleList()
    number = lambda n: F.size(
        F.filter(F.array(*[F.lit(float(c)) for c in cuts[n]]), lambda c: c < F.col(n))
    )
    binned = rows.select(
        "_bad", (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("_held"), *[number(n).alias(f"b_{n}") for n in names]
    )
    rows = written(binned, "rules-binned")
    grow, held = rows.filter(~F.col("_held")), rows.filter("_held")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < max_conditions:
            found = _best_condition(_histograms(grow.filter(_all(conditions)), names), names)
            if found is None:
                break
            conditions.append(found[1])
            if not found[2][1]:  # no good row is covered any more
                break
        if not conditions:
            break
        prefixes = [conditions[: i + 1] for i in range(len(conditions))]
        sums = [F.sum(F.when(_all(c), x)).alias(f"{k}{i}") for i, c in enumerate(prefixes) for k, x in (("p", F.col("_bad")), ("n", 1 - F.col("_bad")))]
        seen = held.agg(*sums).first()
        score = lambda i: ((seen[f"p{i}"] or 0) - (seen[f"n{i}"] or 0)) / max(1, (seen[f"p{i}"] or 0) + (seen[f"n{i}"] or 0))  # noqa: E731,E501
        at = max(range(len(prefixes)), key=lambda i: (score(i), -i))
        p, n = seen[f"p{at}"] or 0, seen[f"n{at}"] or 0
        if p < min_covered or p / max(1, p + n) < min_precision:
            break
        chosen = prefixes[at]
        rules.append(Rule(tuple(Condition(f, above, cuts[f][b]) for f, above, b in chosen), p + n, p / (p + n)))
        grow, held = grow.filter(~_all(chosen)), held.filter(~_all(chosen))
    return RuleList(tuple(rules))


def quality_verdicts(stats: DataFrame, rules: RuleList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (first rule that holds, else NULL) and ``kept``."""
    out = drop_columns(stats, ["base_failed", "rule", "kept"])
    return out.withColumns({"base_failed": base_failed(), "rule": rules.rule_number()}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
