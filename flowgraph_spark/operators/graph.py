"""Behaviour graphs as tables: nodes are addresses, edges are flows.

Edges keep parallel flows and self-loops. ``by`` names the columns that
separate graphs (scenario, client or window); every operator keeps it in its
keys, so many graphs are handled in one pass.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.flows import binary_label
from ..functions.ordering import rank_in_groups
from ..session import cut_lineage, forget
from ..schema import SPLITS

ENDS = ("orig_h", "resp_h")


def endpoints(df: DataFrame, by, ends=ENDS, name="node") -> DataFrame:
    """Each edge's two endpoints as rows; a self-loop gives two."""
    return df.select(*by, F.explode(F.array(*ends)).alias(name))


def node_dictionary(df: DataFrame, by, ends=ENDS) -> DataFrame:
    """``(by..., node, node_id)``: distinct endpoints, sorted, numbered from 0.

    Nodes are sorted into ranges, so one scenario with tens of millions of
    addresses is numbered by many tasks. Edges join the
    dictionary twice, so it is written; its real size decides how they join.
    """
    ranked = rank_in_groups(endpoints(df, by, ends).distinct(), by, ["node"], rank="node_id")
    return cut_lineage(ranked.withColumn("node_id", F.col("node_id") - 1))


#: Marks of node frames that know at which end of the edges a node occurs.
SENDS, RECEIVES = "__sends", "__receives"


def met_by_hash(nodes: DataFrame) -> DataFrame:
    """A written node frame whose joins with edges do not sort them.

    Few nodes are left to Spark, which broadcasts them up to its threshold. Of more, a task
    holds those of its partition in a hash table and the edges stream by, so nothing is
    sorted or spilled for them.
    """
    spark = nodes.sparkSession
    stored = int(str(nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not limit.startswith("-"):
        limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    return nodes if stored <= int(limit) else nodes.hint("shuffle_hash")


def end_nodes(nodes: DataFrame, edges: DataFrame, by, end, mark=None) -> DataFrame:
    """Rows of ``nodes`` that ``edges`` have at ``end``, written.

    Their real size decides the join with the edges: where one end has few nodes, as
    sources of flows often do, edges do not move for it, however many nodes there are.
    ``mark`` names the column that tells them; without it the edges are read for that.
    """
    if mark in nodes.columns:
        return met_by_hash(cut_lineage(nodes.where(mark).drop(SENDS, RECEIVES)))
    own = edges.select(*by, F.col(end).alias("node")).distinct()
    return met_by_hash(cut_lineage(nodes.join(own, ["node", *by], "left_semi")))


def build_edges(df: DataFrame, nodes: DataFrame, by, ends=ENDS, label="detailed_label", by_end=True) -> DataFrame:
    """Edges with node ids ``src`` and ``dst``; all parallel edges stay.

    ``by_end`` joins each end with the nodes that occur there (see :func:`end_nodes`);
    it does not pay where a graph's nodes are few and most occur at both ends.
    """

    def side(end, name):
        own = end_nodes(nodes, df, by, end) if by_end else nodes
        return own.select(*by, F.col("node").alias(end), F.col("node_id").alias(name))

    first, second = ends
    # Joins sort by the first bytes of the first key, so the address leads.
    edges = df.join(side(first, "src"), [first, *by]).join(side(second, "dst"), [second, *by])
    if label in df.columns:
        edges = edges.withColumn("binary_label", binary_label(F.col(label)))
    return edges


def changes(keys):
    """Where a row of an Arrow batch of keys differs from the one before it; null equals null."""
    changed = np.zeros(keys.num_rows - 1, bool)
    for column in keys.columns:
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        apart = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        changed |= apart | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
    return changed


def whole_graphs(batches, by):
    """Batches that hold whole graphs, with the first rows of these, from rows that stand together by graph."""
    held = []

    def close():
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return batch, np.flatnonzero(np.r_[True, changes(batch.select(by))])

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(changes(batch.select(by))) + 1
        last = held[-1].select(by).slice(held[-1].num_rows - 1).to_pylist() if held else None
        if held and last != batch.select(by).slice(0, 1).to_pylist():
            cuts = np.r_[0, cuts]
        if len(cuts):
            # The last graph may go on in the next batch.
            if cuts[-1]:
                held.append(batch.slice(0, int(cuts[-1])))
            if held:
                yield close()
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield close()


def build_small_edges(df: DataFrame, by, ends=ENDS) -> DataFrame:
    """Edges with node ids ``src`` and ``dst`` as :func:`build_edges` gives them, for many small graphs.

    A graph's edges meet in one task and are numbered there, so the rows move once, an edge
    as one row, and no dictionary is written. The rows of a graph stand together in the
    result, for steps that stream them (:func:`whole_graphs`). Meant for graphs of bounded
    size, such as windows with a flow limit. An edge without an end or a key of its graph has
    no nodes and goes.
    """
    first, second = ends
    known = F.col(first).isNotNull() & F.col(second).isNotNull()
    for key in by:
        known = known & F.col(key).isNotNull()
    kept = [*by, *[c for c in df.columns if c not in by]]
    # The hash leads: texts of keys often begin alike, and a sort compares their first bytes first.
    edges = df.where(known).select(F.xxhash64(*by).alias("__g"), *kept)
    dealt = edges.repartition("__g").sortWithinPartitions("__g", *by)

    def run(batches):
        for batch, starts in whole_graphs(batches, by):
            graph = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, batch.num_rows]))
            names = pa.concat_arrays([batch[first], batch[second]]).dictionary_encode()
            ranks = np.empty(len(names.dictionary), np.int64)
            ranks[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(ranks))
            places = np.r_[graph, graph] * len(ranks) + ranks[names.indices.to_numpy()]
            nodes, numbers = np.unique(places, return_inverse=True)
            # Nodes are numbered through; those of a graph begin at its first one.
            ids = numbers - np.searchsorted(nodes, np.r_[graph, graph] * len(ranks))
            columns = [batch[c] for c in kept] + [pa.array(side) for side in np.split(ids, 2)]
            yield pa.record_batch(columns, names=[*kept, "src", "dst"])

    schema = StructType([*edges.select(*kept).schema.fields]).add("src", "long").add("dst", "long")
    return dealt.mapInArrow(run, schema)


def bidirect(edges: DataFrame, src="src", dst="dst", forward=None) -> DataFrame:
    """Each edge and its reverse with the same attributes, from one scan.

    ``forward`` names a boolean column that is true on the edge itself.
    """
    others = [c for c in edges.columns if c not in (src, dst)]
    both = F.array(
        F.struct(F.col(src).alias("s"), F.col(dst).alias("d"), F.lit(True).alias("f")),
        F.struct(F.col(dst).alias("s"), F.col(src).alias("d"), F.lit(False).alias("f")),
    )
    flag = [F.col("__e.f").alias(forward)] if forward else []
    return edges.select(*others, F.explode(both).alias("__e")).select(
        *others, F.col("__e.s").alias(src), F.col("__e.d").alias(dst), *flag
    )


def namespace_nodes(df: DataFrame, sensor="sensor_id", ends=ENDS) -> DataFrame:
    """Addresses as ``sensor::address``, so that no edge crosses sensors."""
    return df.withColumns(
        {end: F.concat_ws("::", F.col(sensor), F.col(end)) for end in ends}
    )


def degree(df: DataFrame, by, ends=ENDS) -> DataFrame:
    """Out plus in degree per node; a self-loop counts 2."""
    return endpoints(df, by, ends).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(df: DataFrame, by, features, num_classes, ends=ENDS, label="detailed_label", stated=None) -> DataFrame:
    """Sizes of each graph, with ``label_counts``: a map from label to edges.

    ``stated(by..., stated_nodes)`` may give more nodes than the edges touch;
    the others are isolated. Edges without a label count under the label ``null``.
    """
    nodes = degree(df, by, ends).groupBy(*by).agg(F.count(F.lit(1)).alias("num_nodes"))
    binary = binary_label(F.col(label))
    # Edges are counted by label first; a graph's labels are as many as the taxonomy has.
    per_label = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.coalesce(F.col(label), F.lit("null")), F.col("n"))
    edges = per_label.groupBy(*by).agg(
        F.sum("n").alias("num_edges"),
        (2 * F.sum("n")).alias("num_edges_mp"),
        F.coalesce(F.sum(F.when(binary == 0, F.col("n"))), F.lit(0)).alias("benign_edges"),
        F.coalesce(F.sum(F.when(binary == 1, F.col("n"))), F.lit(0)).alias("malicious_edges"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("label_counts"),
    )
    joined = edges.join(nodes, list(by)).withColumn("num_isolated", F.lit(0).cast("long"))
    if stated is not None:
        joined = joined.join(stated, list(by), "left")
        more = F.greatest(F.col("stated_nodes") - F.col("num_nodes"), F.lit(0))
        joined = joined.withColumn("num_isolated", F.coalesce(more, F.lit(0)).cast("long")).withColumn(
            "num_nodes", F.col("num_nodes") + F.col("num_isolated")
        )
    return joined.select(
        *by, "num_nodes", "num_edges", "num_edges_mp",
        F.lit(len(features)).alias("feature_dim"), F.lit(num_classes).alias("num_classes"),
        "num_isolated", "benign_edges", "malicious_edges", "label_counts",
    )


def topology(df: DataFrame, by, features, ends=ENDS, nodes=None) -> DataFrame:
    """Degree, parallelism and density of each graph.

    ``nodes(by..., num_nodes)`` may state more nodes than the edges touch; the
    rest are isolated.
    """
    first, second = ends
    nonfinite = [
        (F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("long") for c in features
    ]
    bad = nonfinite[0]
    for item in nonfinite[1:]:
        bad = bad + item
    pairs = df.groupBy(*by, first, second).agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad")
    )
    edges = pairs.groupBy(*by).agg(
        F.sum("n").alias("num_edges"),
        F.sum(F.when(F.col(first) == F.col(second), F.col("n")).otherwise(0)).alias("self_loops"),
        F.count(F.lit(1)).alias("unique_pairs"),
        F.sum("bad").alias("nonfinite_values"),
    )
    degrees = degree(df, by, ends).groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes_with_edges"),
        F.sum("degree").alias("__total"),
        F.max("degree").alias("max_degree"),
    )
    joined = edges.join(degrees, list(by))
    joined = joined.join(nodes, list(by)) if nodes is not None else joined.withColumn(
        "num_nodes", F.col("nodes_with_edges")
    )
    n = F.col("num_nodes")
    return joined.select(
        *by, "num_nodes", "num_edges", "nodes_with_edges",
        (n - F.col("nodes_with_edges")).alias("isolated_nodes"),
        "self_loops", "unique_pairs",
        (F.col("num_edges") - F.col("unique_pairs")).alias("parallel_edges"),
        (F.col("__total") / n).alias("mean_degree"),
        "max_degree",
        (F.col("unique_pairs") / (n * F.greatest(n - 1, F.lit(1)))).alias("pair_density"),
        "nonfinite_values",
    )


def exact_duplicate_edges(df: DataFrame, by, columns) -> DataFrame:
    """Edges beyond the first of each identical (ends, label, features) row."""
    distinct = df.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(*by).agg(
        (F.sum("n") - F.count(F.lit(1))).alias("exact_duplicate_edges")
    )


def validate_graph(edges: DataFrame, by, num_classes, edge_key, sizes=None) -> DataFrame:
    """Counts of violations per graph; all zero for a sound graph.

    ``sizes(by..., num_nodes)`` gives the id range.
    """
    checked = edges.join(sizes, list(by), "left") if sizes is not None else edges
    in_range = [(F.col(c) >= 0) & (F.col(c) < F.col("num_nodes")) for c in ("src", "dst")] if sizes is not None else [
        F.col(c) >= 0 for c in ("src", "dst")
    ]
    ids_ok = F.coalesce(in_range[0] & in_range[1], F.lit(False))
    per_key = edges.groupBy(*by, edge_key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s")
    ).groupBy(*by).agg(
        F.count_if(F.col("n") > 1).alias("repeated_edges"),
        F.count_if(F.col("s") > 1).alias("edges_in_two_splits"),
    )
    label = F.col("label_idx")
    rows = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.count_if(~ids_ok).alias("bad_node_ids"),
        F.count_if(F.coalesce((label < 0) | (label >= num_classes), F.lit(True))).alias("bad_labels"),
        F.count_if(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).alias("bad_splits"),
    )
    return rows.join(per_key, list(by))


def weak_components(df: DataFrame, by, ends=ENDS) -> DataFrame:
    """``(by..., node, component)``: the smallest node reachable, ignoring direction.

    Alternating large-star and small-star rounds: every round is a grouped
    minimum (combined before the shuffle) and an equi join, and long chains
    shrink in logarithmically many rounds. Minima are written before they are
    joined, so both sides of the join are shuffled for it and Spark splits a hub.
    Rounds go on until nothing changes; the driver sees one fingerprint row of
    each, and the tables of a round go when the next one stands.
    """
    first, second = ends
    nodes = endpoints(df, by, ends).distinct()
    a, b = F.col(first), F.col(second)
    links = cut_lineage(
        df.where(a != b).select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )

    def fingerprint(frame):
        hashed = F.xxhash64(*by, "u", "v").cast("decimal(20,0)")
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(hashed)).first())

    def star(pairs, keep):
        # pairs are (u, v) rows: v is a neighbour of u. The minimum of u's
        # neighbourhood becomes the neighbour of the kept members.
        lowest = cut_lineage(
            pairs.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        )
        joined = pairs.join(lowest, [*by, "u"])
        return joined.where(keep).select(*by, F.col("v").alias("u"), F.col("m").alias("v")), lowest

    state = None
    while True:
        mirrored = bidirect(links, "u", "v")
        large, minima = star(mirrored, F.col("v") > F.col("u"))
        links_large = cut_lineage(large.where(F.col("u") != F.col("v")).distinct())
        small, lowest = star(links_large, F.lit(True))
        own = lowest.select(*by, "u", F.col("m").alias("v"))
        before, links = links, cut_lineage(
            small.unionByName(own).where(F.col("u") != F.col("v")).distinct()
        )
        forget(before, minima, links_large, lowest)
        current = fingerprint(links)
        if current == state:
            break
        state = current
    roots = links.groupBy(*by, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, [*by, "node"], "left").select(
        *by, "node", F.coalesce("component", "node").alias("component")
    )


def component_stats(components: DataFrame, by) -> DataFrame:
    """Number of components and size of the largest per graph."""
    sizes = components.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("components"), F.max("n").alias("largest_component")
    )
