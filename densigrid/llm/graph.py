"""Connected components of a table of links, by label hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.llm.common import blocks_of, discard, hot_keys, salted_join, shuffled, written

TASK_ROWS, TASKS = 1 << 16, 8  # rows of a written partition, and the fewest partitions of a round


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp): every node of ``links`` (a, b) with the least node of its component; any orderable type.

    Null ends and loops are ignored. Each round a node takes the least label around it, and then that label's label; labels only fall,
    so the work ends when none falls, after about the logarithm of a component's diameter. Every round is written, and the one before it
    deleted. Nodes of very many links and components of very many nodes are dealt to several tasks. A round has as many partitions as its links
    need, and never more than the session's shuffles: small graphs don't pay for a task a shuffle partition.
    """
    width = max(TASKS, blocks_of(links.count(), TASK_ROWS))
    edges = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    both = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).coalesce(width), f"{label}-edges")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("comp")).coalesce(width), label)
    links_n, nodes_n = both.count(), labels.count()
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("dst"), "comp"), "dst", "src", links_n).groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        hooked = labels.join(shuffled(near), "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = salted_join(hooked, up, "comp", "node", nodes_n, hot=hot_keys(labels, "comp", nodes_n)).select("node", "was", F.least("comp", "above").alias("comp"))
        step = written(jumped.coalesce(width), label)
        discard(labels)
        if step.where(F.col("was") != F.col("comp")).limit(1).count() == 0:
            discard(both)
            return step.select("node", "comp")
        path, labels = step.written_to, step.select("node", "comp")
        labels.written_to = path
