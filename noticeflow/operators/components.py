"""Connected components of large edge lists by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.storage import discard, materialise, tasks_for


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b); loops and repeated edges don't matter, nulls must not occur.

    Each round sends every node's neighbours to the smallest one it knows. The edge list never grows beyond twice its size, and rounds end when all edges lead to
    a smallest node. Minima are pre-aggregated and written before they are joined: a plain equi-join of written tables can be split where a node has very many
    edges, while one that shares the aggregate's shuffle can't. A round's tables are deleted when the next one's are written.
    """
    pairs = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    # Small lists need few tasks a step, whatever the session's number of shuffle partitions; for large ones this changes nothing.
    tasks = tasks_for(pairs.count())
    while True:
        both = pairs.select("v", "m").union(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        known = materialise(both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least")).coalesce(tasks), "least")
        large = both.join(known, "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m")).distinct()
        large = materialise(large.coalesce(tasks), "edges")
        least = materialise(large.groupBy("v").agg(F.min("m").alias("least")).coalesce(tasks), "least")
        joined = large.join(least, "v")
        small = joined.select("v", F.col("least").alias("m")).union(joined.where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))).distinct()
        before, pairs = pairs, materialise(small.coalesce(tasks), "edges")
        for done in (before, known, large, least):
            discard(done)
        # Done when no child has two parents and no parent is a child.
        children = pairs.groupBy("v").agg(F.count("*").alias("n"))
        if children.where("n > 1").select("v").union(pairs.select(F.col("m").alias("v")).join(children, "v", "left_semi")).isEmpty():
            break
    roots = pairs.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return pairs.select(F.col("v").alias("node"), F.col("m").alias("component")).union(roots)


def groups_by_keys(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """row, component for rows that share any of several keys (nulls are shared with no one): each key's rows are linked to its smallest row."""
    named = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    owned = rows.select(F.col(row).alias("a"), F.explode(F.array_compact(F.array(*named))).alias("key"))
    heads = owned.groupBy("key").agg(F.min("a").alias("b"))
    linked = components(owned.join(heads, "key").select("a", "b"))
    alone = rows.select(F.col(row).alias("node"))
    return alone.join(linked, "node", "left").select(F.col("node").alias(row), F.coalesce("component", "node").alias("component"))
