"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the label is the smallest node of the component.

    Every round each node takes the least label among its neighbours, then the
    label of its label, so long chains shorten by half. Rounds are tables in the
    shared folder; a node with very many links is aggregated before each shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = written(both, "links", narrow=True)
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels", narrow=True)
    total = None
    while True:
        # labels only fall, so they are final once their sum stays
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now is None or now == total:
            return labels
        total = now
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label")), "labels", narrow=True)
        labels = written(new.join(new.select(F.col("node").alias("label"), F.col("label").alias("root")), "label").select("node", F.col("root").alias("label")), "labels", narrow=True)
