"""Connected components of a table of links, without collecting anything.

Defined results: a link from a vertex to itself gives that vertex no row; repeated links count once;
links with a null end join nothing and give no row; no links give no rows; other columns of the
links are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import Workspace


def contract(work: Workspace, links: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``(vertex, label)`` for every end of ``links(a, b)``; label is the smallest reachable vertex.

    Each round hooks a vertex to its smallest neighbour, follows the hooks twice and keeps the
    links between different hooks. A vertex that is no local minimum goes, so the number of
    live vertices falls at least by half. Hot vertices cost a partial aggregation only. ``rows``
    is an upper bound of the links, if known.
    """
    edges = work.table(links.select("a", "b").where("a != b").distinct(), f"{name}-edges-0", rows)
    n = edges.count()
    hooks: list[DataFrame] = []
    total = n
    turn = 0
    while n:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to"))
        up = hook.select(F.col("v").alias("mid"), F.col("to").alias("top"))
        hook = work.table(hook.join(up, F.col("to") == F.col("mid")).select("v", F.col("top").alias("to")), f"{name}-hook-{turn}", 2 * n)
        hooks.append(hook)
        left, right = hook.select(F.col("v").alias("a"), F.col("to").alias("x")), hook.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        turn += 1
        edges = work.table(moved, f"{name}-edges-{turn}", n)
        n = edges.count()
    if not hooks:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("label")).limit(0)
    labels = hooks[0].select(F.col("v").alias("vertex"), F.col("to").alias("label"))
    for hook in hooks[1:]:
        labels = labels.join(hook, F.col("label") == F.col("v"), "left").select("vertex", F.coalesce("to", "label").alias("label"))
    return work.table(labels, f"{name}-labels", 2 * total)
