"""Connected components by rows: the least label spreads over links, with a jump along labels in each round.

Links are read once for both directions, and joins are merges at any size, so that the driver collects no rows for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import cut


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the least id in reach) for all ids in ``links`` (``a, b``)."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(links.select(F.explode(ways).alias("way")).select("way.*").distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.hint("merge"), both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), labels.id == near.a).select("id", "component", F.least("component", "near").alias("next"))
        far = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        step = cut(step.join(far.hint("merge"), "next").select("id", "component", F.least("next", "far").alias("next")))
        labels = step.select("id", F.col("next").alias("component"))
        if not step.where("next <> component").limit(1).count():
            return labels
