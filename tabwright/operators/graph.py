"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.order import persisted


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of the ends of links (a, b). In each round a node hears the smallest label among its neighbours and then takes its label's own label, so rounds grow with the logarithm of a chain's length."""
    both = persisted(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = persisted(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        told = labels.join(heard, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("higher"))
        now = persisted(told.join(up, "label", "left").select("id", "was", F.least("label", "higher").alias("label")))
        if not now.filter("label <> was").limit(1).count():
            return now.select("id", "label")
        labels = now.select("id", "label")
