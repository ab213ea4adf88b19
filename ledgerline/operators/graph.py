"""Alignments as a bipartite hypergraph: components, conflicts, consolidation, exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import remove_stored, stored


def components(edges: DataFrame, a: str, b: str, checkpoint=None) -> DataFrame:
    """(node, component): the least node that each node is connected with. Every node takes the least label around it
    and then that label's label, until nothing changes. Each round is a table in the shared folder, deleted after the next;
    a function ``checkpoint`` may cut the lineage of rounds in its own way."""
    spark = edges.sparkSession
    cut = (lambda frame: (checkpoint(frame), None)) if checkpoint else stored
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both, both_at = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels, labels_at = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")))
    while True:
        seen = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("around"))
        lower = labels.join(seen, labels.node == seen.x).select("node", F.col("component").alias("old"), F.least("component", "around").alias("component"))
        up = labels.select(F.col("node").alias("u"), F.col("component").alias("up"))
        new, new_at = cut(lower.join(up, lower.component == up.u).select("node", "old", F.least("component", "up").alias("component")))
        done = new.where("old <> component").isEmpty()
        labels, before = new.select("node", "component"), labels_at
        labels_at = new_at
        for path in (before, both_at if done else None):
            if path:
                remove_stored(spark, path)
        if done:
            return labels


def conflicts(members: DataFrame, row: str, member: str, supported: str) -> DataFrame:
    """Rows with a member that several rows own, unless all of them are supported."""
    owned = members.groupBy(member).agg(F.count_distinct(row).alias("owners"), F.every(supported).alias("all_supported"))
    return members.join(owned, member).groupBy(row).agg(F.max((F.col("owners") > 1) & ~F.col("all_supported")).alias("conflict"))


def one_sided(members: DataFrame, row: str, side: str) -> DataFrame:
    """Rows whose members are all on one side."""
    return members.groupBy(row).agg(F.count_distinct(side).alias("sides")).where("sides < 2")


def consolidated(members: DataFrame, labels: DataFrame, row: str, member: str, side: str, supported: str) -> DataFrame:
    """Components of rows that overlap: merged where one side has one member and every row is supported."""
    placed = members.join(labels, members[row] == labels.node)
    whole = placed.groupBy("component").agg(
        F.count_distinct(row).alias("rows"), F.count_distinct(F.when(F.col(side) == "previous", F.col(member))).alias("n_previous"), F.count_distinct(F.when(F.col(side) == "current", F.col(member))).alias("n_current"), F.every(supported).alias("all_supported")
    )
    merge = (F.col("rows") > 1) & (F.least("n_previous", "n_current") == 1) & F.col("all_supported")
    return whole.withColumn("merged", merge)
