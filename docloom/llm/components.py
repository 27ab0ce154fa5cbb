"""Connected components of a distributed edge list: least labels with pointer jumping, checkpointed each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_table, materialise, parts

#: Links a task.
LINKS = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every end of edges(a, b): the label is the least node of its component.

    Each round gives a node the least label among itself and its neighbours, then the label of its label. Partial
    aggregation comes before each shuffle, so a node with very many links costs a task one row. Few links make few
    tasks."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct()
    both = materialise(both, "links")
    tasks = min(parts(both), -(-both.count() // LINKS) or 1)
    stored = lambda df: materialise(df.coalesce(tasks), "labels")
    labels = stored(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("l")), "near").groupBy("node").agg(F.min("l").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = stored(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label")))
        drop_table(labels)
        labels = jumped.select("node", "label")
        if jumped.where("label != old").isEmpty():
            drop_table(both)
            return labels
    raise RuntimeError("components did not settle")
