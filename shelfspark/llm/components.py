"""Connected components of a link table, on Spark only.

Every round hooks each node to its smallest neighbour, shortens the chains of
hooks by doubling, and contracts the links to what is left between the new
roots. The links shrink from round to round; a node with very many links is
pre-aggregated before the shuffle like any other group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, root: the smallest node that links reach, for
    every node of a link between different nodes. Null ends are ignored."""
    links = stored(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        hook = stored(hook, "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stored(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks")
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = stored(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        ends = links
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        links = stored(ends.where("a_root != b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
