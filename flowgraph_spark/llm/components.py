"""Connected components of a table of links, as joins and group-bys."""

from pyspark.sql import functions as F

from .common import cut_lineage, forget


def connect(links):
    """``id`` and ``component`` for every id that occurs in ``links`` (a, b).

    The component is the smallest id reachable. Each round hooks every id to
    its smallest neighbour, follows the hooks to their ends by doubling, and
    contracts the links; a round leaves at most half of the linked ids. Ids
    with many links are grouped with partial sums and joined as the skewed side
    of an equi join, which Spark splits. Null ends and loops are ignored, no
    links give no rows.
    """
    edges = cut_lineage(
        links.where("a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    found = None
    while not edges.isEmpty():
        # The smaller end of a link hooks the larger one, so hooks form trees.
        hooks = cut_lineage(edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("to")))
        while True:
            onward = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
            moved = hooks.join(onward, "to", "left").select(
                "id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")
            )
            moved = cut_lineage(moved)
            forget(hooks)
            hooks = moved.select("id", "to")
            if moved.where("moved").isEmpty():
                break
        earlier, left = found, edges
        found = hooks if found is None else _follow(found, hooks)
        edges = cut_lineage(
            _rename(_rename(edges, hooks, "lo"), hooks, "hi").where("lo <> hi")
            .select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
        )
        forget(left)
        if earlier is not None:
            forget(earlier, hooks)
    if found is None:
        return edges.select(F.col("lo").alias("id"), F.col("hi").alias("component"))
    # Ends of hooks are components themselves.
    roots = found.select(F.col("to").alias("id")).distinct()
    return found.select("id", F.col("to").alias("component")).union(roots.select("id", F.col("id")))


def _rename(edges, hooks, end):
    to = hooks.select(F.col("id").alias(end), F.col("to").alias("root"))
    return edges.join(to, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")


def _follow(found, hooks):
    """``found`` with its ends hooked further, and the newly hooked ids."""
    onward = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
    moved = found.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    return cut_lineage(moved.union(hooks))
