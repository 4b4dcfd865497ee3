"""Connected components of a table of links, by hooking to the least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the least node reachable) for every node of links(a long, b long).

    A hub of any degree is safe: its links meet its label in a join whose partitions can be split, and
    minima are combined before they are shuffled. Each round is a written table.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    labels = scratch.save(least.select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        hooked = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        hooked = scratch.save(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = scratch.save(hooked.join(jump, "component").select("node", F.col("further").alias("component"), (F.col("further") != F.col("was")).alias("changed")), "labels")
        scratch.drop(labels, hooked)
        if new.where("changed").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
        labels._scratch_path = new._scratch_path
