"""Connected components of an edge table by hooking and shortcutting, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): for each node of edges (a, b) the smallest node it is linked with.

    Each round every edge offers the smaller label of its ends to both ends and to their labels, and then each
    node takes its label's label, so the number of rounds grows with the logarithm of the longest path. Offers
    are minima and combine before they are shuffled; no task sees all neighbours of a node at once.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.col("node").alias("root")), "labels")
    while True:
        la = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        lb = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = edges.join(la, "a").join(lb, "b").where("ra <> rb")
        low = F.least("ra", "rb")
        offers = live.select(F.explode(F.array("a", "b", "ra", "rb")).alias("node"), low.alias("offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        offers = written(offers, "offers")
        if offers.isEmpty():
            discard(edges, offers)
            return labels
        hooked = labels.join(offers, "node", "left").select("node", F.least("root", F.coalesce("offer", "root")).alias("root"))
        hooked = written(hooked, "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = written(hooked.join(up, "root").select("node", F.col("above").alias("root")), "labels")
        discard(labels, offers, hooked)
        labels = after
