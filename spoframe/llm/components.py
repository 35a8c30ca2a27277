"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """Rows ``(v, label)`` for the ends of ``links`` (a, b): the smallest vertex of the component.

    Every round takes the smallest label among a vertex's neighbours, then the
    label's own label (pointer jumping).  Minima combine before the shuffle,
    so a vertex with many links is no burden; each round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "cc-links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc")
    while True:
        of = labels.select(F.col("v").alias("b"), "label")
        near = both.join(of, "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        new = labels.join(near, "v", "left").select("v", "label", F.least("label", "near").alias("new"))
        jump = new.select(F.col("v").alias("new"), F.col("new").alias("next"))
        done = new.join(jump, "new", "left").select("v", "label", F.least("new", "next").alias("new"))
        done = written(done, "cc")
        changed = done.filter("new <> label").limit(1).count()
        labels = done.select("v", F.col("new").alias("label"))
        if not changed:
            return labels
