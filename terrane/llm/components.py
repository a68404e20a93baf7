"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.runtime import written


#: Links of a node beyond which it is a hub, dealt over one task for each so many.
HUB = 1000
#: Parts over which the rows of one label are dealt.
SALTS = 16


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the least node it reaches.

    Each round takes the least label among a node's neighbours and then the label of
    its label, so chains shorten by more than half a round. Rounds end when no label
    changes. Every round is written to the shared folder, which keeps the lineage short.
    Hubs' labels are copied, one copy for HUB links, and so are labels that many nodes
    have but that aren't final: no join key holds a large part of the rows.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    parts = written(both.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("near")).select(F.col("b").alias("node"), F.least("b", "near").alias("label"), F.ceil(F.col("n") / HUB).cast("int").alias("parts")), "nodes")
    labels = parts.select("node", "label")
    hubs = parts.where("parts > 1").select(F.col("node").alias("b"), "parts")
    both = written(both.join(hubs, "b", "left").select("a", "b", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("a"), F.col("parts"))).otherwise(0).cast("int").alias("salt")), "edges")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt")
    while True:
        spread = labels.withColumnRenamed("node", "b").join(hubs, "b", "left").select("b", "label", copies)
        near = both.join(spread, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "once")
        # labels that have a lesser label themselves
        jump = once.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        jump = jump.join(once.select("label").distinct(), "label").select("label", "next", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = once.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        to = F.coalesce("next", "label")
        step = written(salted.join(jump, ["label", "salt"], "left").select("node", to.alias("label"), (to < F.col("old")).alias("moved")), "step")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
