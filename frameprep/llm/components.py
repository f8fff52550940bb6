"""Connected components by distributed union-find: hooking and pointer jumping.

Each round every node takes the smallest label among its neighbours, every
tree's root takes the smallest label its members saw, and labels jump to their
root's label, so long chains collapse in a logarithmic number of rounds. Only
aggregates (map-side combined) and joins on one row per label are used; nothing
reaches the driver but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import release, staged, tasks_for


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, comp): comp is the smallest node of the component."""
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = staged(edges.where("a <> b").select(ends.alias("e")).select("e.a", "e.b").distinct(), "edges")
    tasks = tasks_for(both.count())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels", tasks)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", "comp", F.least("comp", "m").alias("low"))
        hook = step.groupBy("comp").agg(F.min("low").alias("h"))
        hooked = staged(step.join(hook, "comp").select("node", F.col("comp").alias("old"), F.least("low", "h").alias("comp")), "hooked", tasks)
        roots = hooked.select(F.col("node").alias("r"), F.col("comp").alias("top"))
        new = staged(hooked.join(roots, F.col("comp") == F.col("r"), "left").select(
            "node", F.coalesce(F.least("comp", "top"), "comp").alias("comp"), "old"), "labels", tasks)
        moved = new.where(F.col("comp") != F.col("old")).limit(1).count()
        release(labels, hooked)
        labels = new
        if not moved:
            release(both)
            return labels.select("node", "comp")
