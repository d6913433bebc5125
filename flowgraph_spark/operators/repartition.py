"""Moving flows between clients: IID shards, class removal, provenance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import (
    hash_order,
    hash_segments,
    membership_digest,
    rank_in_groups,
)


def shard_ends(n, shards):
    """Ranks at which all shards but the last end; the first ``n mod shards`` get one more."""
    small, extra = F.floor(n / F.lit(shards)), n % shards
    return [small * i + F.least(extra, F.lit(i)) for i in range(1, shards)]


def repartition_iid(df: DataFrame, clients, row_id, seed, label="label_idx", client="scenario") -> DataFrame:
    """Deal each train class over the clients in near-equal shards.

    Validation and test rows stay where they are. A class with fewer rows than
    clients is an error.
    """
    k = len(clients)
    train = df.where(F.col("split") == "train")
    order = hash_order(seed, row_id)
    # One client has no inner ends; a bound no row passes keeps the form.
    cuts = (lambda n: shard_ends(n, k)) if k > 1 else (lambda n: [n])
    cut = hash_segments(train, [label], order, cuts, segment="__segment", total="__n")
    names = F.array(*[F.lit(c) for c in clients])
    dealt = cut.withColumn(
        "destination",
        F.when(F.col("__n") < k, F.raise_error(F.lit("a class has fewer rows than clients")))
        .otherwise(F.element_at(names, F.col("__segment") + 1)).cast("string"),
    ).drop("__segment", "__n")
    rest = df.where(F.col("split") != "train").withColumn("destination", F.col(client))
    return dealt.unionByName(rest)


def drop_and_remap_class(df: DataFrame, dropped, label="label_idx") -> DataFrame:
    """Remove one class and close the gap in the index."""
    index = F.col(label)
    return df.where(index != dropped).withColumn(
        label, F.when(index > dropped, index - 1).otherwise(index)
    )


def validate_provenance(source: DataFrame, derived: DataFrame, keys) -> DataFrame:
    """One row: source rows duplicated, lost, or added by a derivation.

    Rows of both sides meet once, in one grouping. A key with a null is never found on
    the other side.
    """
    sides = [
        rows.select(*keys, F.lit(int(rows is source)).alias("__s"), F.lit(int(rows is derived)).alias("__d"))
        for rows in (source, derived)
    ]
    # A group that is sorted goes by the first bytes of its first key, so the narrowest one leads.
    counts = sides[0].unionByName(sides[1]).groupBy(*reversed(keys)).agg(
        F.sum("__s").alias("n_source"), F.sum("__d").alias("n_derived")
    )
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return counts.agg(
        F.count_if(F.col("n_derived") > 1).alias("duplicated"),
        F.count_if((F.col("n_source") > 0) & ((F.col("n_derived") == 0) | ~known)).alias("lost"),
        F.count_if((F.col("n_derived") > 0) & ((F.col("n_source") == 0) | ~known)).alias("added"),
    )


def provenance_digest(derived: DataFrame, source, edge, destination) -> DataFrame:
    identity = F.concat_ws("\u0001", F.col(source), F.col(edge).cast("string"), F.col(destination))
    return membership_digest(derived, [], identity)


def reindex_nodes(df: DataFrame, client, order, source="scenario", ends=("src", "dst")) -> DataFrame:
    """Node ids by first appearance along the sorted edges of each client.

    A node is (source, node); within an edge the origin comes before the
    target. ``order`` is one sortable column unique per client and edge.
    """
    first, second = ends
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col(first).alias("node")),
            F.struct(F.lit(1).alias("side"), F.col(second).alias("node")),
        )
    ).alias("end")
    appearances = df.select(client, source, F.col(order).alias("__o"), sides)
    # The least text is found by sorting, which goes by the first bytes of the first key: the node.
    nodes = appearances.groupBy(F.col("end.node").alias("node"), source, client).agg(
        F.min(F.struct(F.col("__o").alias("o"), F.col("end.side").alias("side"))).alias("seen")
    )
    flat = nodes.select(client, source, "node", F.col("seen.o").alias("__o"), F.col("seen.side").alias("__s"))
    ranked = rank_in_groups(flat, [client], ["__o", "__s"], rank="__rank")
    return ranked.select(client, source, "node", (F.col("__rank") - 1).alias("node_id"))
