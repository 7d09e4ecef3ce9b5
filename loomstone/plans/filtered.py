"""Search within one document, with the whole corpus as the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.vectors import nearness
from loomstone.plans.blocks import nearest


def filtered_search(queries: DataFrame, corpus: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """Nearest items of the query's own ``group``; a query that finds none there searches the whole corpus."""
    inside = nearest(queries, corpus, k, skip_same=skip_same, group=True).withColumn("filtered", F.lit(True))
    groups = corpus.filter(F.size("vector") > 0).select("group").distinct()
    unmet = queries.join(groups, "group", "left_anti")
    anywhere = nearest(unmet, corpus, k, skip_same=skip_same).withColumn("filtered", F.lit(False))
    return inside.unionByName(anywhere).withColumn("score", nearness(F.col("distance")))
