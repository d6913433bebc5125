"""Neighbourhood aggregation and edge scoring as joins and grouped averages.

Message passing runs over bidirected edges. A hub that touches every edge is
safe on the target side, since averages and sums are combined before the
shuffle. Gathering source vectors is an equi join, which AQE splits when a key
is skewed; ``salt`` > 1 also spreads each key by hand (node rows are repeated
``salt`` times).

Node frames are ``(by..., node, h_0, h_1, ...)``; widths are small, so a dense
layer is a set of column expressions. :func:`score_edges_wide` takes wide ones.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import vectors as vx
from ..session import cut_lineage
from .graph import RECEIVES, SENDS, bidirect, changes, end_nodes, endpoints, whole_graphs

LEAKY_SLOPE = 0.2
#: Scores of one magnitude differ by less than this; its powers stay far from overflow.
SCORE_STEP = 64.0


def hidden(width, prefix="h"):
    return [f"{prefix}_{i}" for i in range(width)]


def constant_nodes(edges: DataFrame, by, src="src", dst="dst") -> DataFrame:
    """All nodes with the constant feature 1."""
    return endpoints(edges, by, (src, dst)).distinct().withColumn("h_0", F.lit(1.0))


def gather(edges: DataFrame, nodes: DataFrame, by, end, columns, prefix, salt=1) -> DataFrame:
    """Attach the vector of the node at ``end`` under the names ``prefix_i``.

    The node leads the keys: a join sorts by the first bytes of its first key, and
    those of ``by`` are the same on many edges.
    """
    side = nodes.select(
        *by, F.col("node").alias(end), *[F.col(c).alias(f"{prefix}_{i}") for i, c in enumerate(columns)]
    )
    if salt == 1:
        return edges.join(side, [end, *by])
    spread = edges.withColumn("__salt", F.pmod(F.xxhash64(*edges.columns), F.lit(salt)))
    repeated = side.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {salt - 1}L)")))
    return spread.join(repeated, [end, *by, "__salt"]).drop("__salt")


def edge_to_node_aggregate(edges: DataFrame, by, features, how="mean", src="src", dst="dst") -> DataFrame:
    """Mean or sum of the attributes of incident edges per node."""
    return marked_aggregate(edges, by, features, how, src, dst).drop(SENDS, RECEIVES)


def marked_aggregate(edges, by, features, how="mean", src="src", dst="dst"):
    """As :func:`edge_to_node_aggregate`, with the ends at which a node occurs."""
    pick = {"mean": F.avg, "sum": F.sum}[how]
    both = bidirect(edges.select(*by, src, dst, *features), src, dst, "__forward")
    return both.groupBy(F.col(dst).alias("node"), *by).agg(*[pick(f).alias(f) for f in features], *_marks()).select(
        *by, "node", *features, SENDS, RECEIVES
    )


def mean_vectors(edges: DataFrame, by, vector, src="src", dst="dst") -> DataFrame:
    """As :func:`edge_to_node_aggregate` for attributes that are one array column of equal lengths.

    Rows of a node are sorted next to each other and added up as matrices, so many
    attributes cost little; a task holds one Arrow batch and the sums of one node. They
    are not combined before the shuffle: meant for windows, whose flow limit bounds them.
    """
    keys = [*by, "node"]
    both = bidirect(edges.select(*by, src, dst, vector), src, dst)
    rows = both.select(*by, F.col(dst).alias("node"), vector)
    marked = rows.withColumn("__g", F.xxhash64(*keys))
    # The hash leads: texts of keys often begin alike, and a sort compares their first bytes first.
    dealt = marked.repartition("__g").sortWithinPartitions("__g", *keys)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(keys)
            starts = np.flatnonzero(np.r_[True, changes(own)])
            values, cells = _matrix(batch[vector]), batch[vector].flatten()
            counts = np.diff(np.r_[starts, batch.num_rows])[:, None].repeat(values.shape[1], axis=1)
            if cells.null_count:
                known = cells.is_valid().to_numpy(zero_copy_only=False).reshape(values.shape)
                values, counts = np.where(known, values, 0.0), np.add.reduceat(known.astype(int), starts, axis=0)
            sums = np.add.reduceat(values, starts, axis=0, dtype=float)
            if held is not None:
                if held[0].to_pylist() == own.slice(0, 1).to_pylist():
                    sums[0] += held[1]
                    counts[0] += held[2]
                else:
                    yield means(held[0], held[1][None], held[2][None])
            # The last node may go on in the next batch.
            if len(starts) > 1:
                yield means(own.take(pa.array(starts[:-1])), sums[:-1], counts[:-1])
            held = own.slice(int(starts[-1]), 1), sums[-1], counts[-1]
        if held is not None:
            yield means(held[0], held[1][None], held[2][None])

    def means(own, sums, counts):
        found = pa.array(np.divide(sums, counts, where=counts > 0, out=np.zeros_like(sums)).ravel(), mask=(counts == 0).ravel())
        lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), found)
        return pa.record_batch([*own.columns, lists], names=[*keys, vector])

    return dealt.mapInArrow(run, StructType([*rows.select(*keys).schema.fields]).add(vector, ArrayType(DoubleType())))


def represent_small_graphs(edges: DataFrame, by, vector, only, size, keep=(), src="src", dst="dst") -> DataFrame:
    """``z``, ``[h_src, h_dst, e]``, of the edges that are ``only``, where a node's vector is the mean of its incident edges.

    As :func:`mean_vectors` and :func:`edge_representation` in one pass that moves nothing,
    over the result of :func:`graph.build_small_edges`: rows of a graph stand together and
    nodes are numbered from 0. ``size`` names the number of edges of the graph.
    """
    kept = [*by, *keep]
    rows = edges.select(*kept, only, src, dst, F.col(vector).cast("array<double>").alias(vector))

    def run(batches):
        for batch, starts in whole_graphs(batches, by):
            sizes = np.diff(np.r_[starts, batch.num_rows])
            graph = np.repeat(np.arange(len(starts)), sizes)
            one, other = batch[src].to_numpy(), batch[dst].to_numpy()
            tops = np.maximum.reduceat(np.maximum(one, other), starts) + 1
            begin = np.r_[0, np.cumsum(tops)[:-1]][graph]
            one, other = one + begin, other + begin
            nodes = np.r_[one, other]
            order = np.argsort(nodes, kind="stable")
            at = np.searchsorted(nodes[order], np.arange(tops.sum()))
            order %= batch.num_rows
            values, cells = _matrix(batch[vector]), batch[vector].flatten()
            counts = np.bincount(nodes)[:, None]
            known = None
            if cells.null_count:
                known = cells.is_valid().to_numpy(zero_copy_only=False).reshape(values.shape)
                values = np.where(known, values, 0.0)
                counts = np.add.reduceat(known.astype(int)[order], at, axis=0)
            means = np.add.reduceat(values[order], at, axis=0) / np.maximum(counts, 1)
            chosen = np.flatnonzero(pc.fill_null(batch[only], False).to_numpy(zero_copy_only=False))
            found = np.hstack([means[one[chosen]], means[other[chosen]], values[chosen]])
            missing = None
            if known is not None:
                missing = np.hstack([counts[one[chosen]] == 0, counts[other[chosen]] == 0, ~known[chosen]]).ravel()
            lists = pa.ListArray.from_arrays(
                np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel(), mask=missing)
            )
            own = batch.select(kept).take(pa.array(chosen))
            yield pa.record_batch([*own.columns, pa.array(sizes[graph[chosen]]), lists], names=[*kept, size, "z"])

    schema = StructType([*rows.select(*kept).schema.fields]).add(size, "long").add("z", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)


def _marks():
    """At which ends of the edges the target of a bidirected edge occurs."""
    return [F.max(~F.col("__forward")).alias(SENDS), F.max("__forward").alias(RECEIVES)]


def _both_directions(edges, nodes, by, columns, salt, src="src", dst="dst"):
    """Bidirected edges with the vector of the sender as ``s_i``; each direction meets its own senders."""
    others = [c for c in edges.columns if c not in (*by, src, dst)]
    back = edges.select(*by, F.col(dst).alias(src), F.col(src).alias(dst), *others)
    at_src = gather(edges, end_nodes(nodes, edges, by, src, SENDS), by, src, columns, "s", salt)
    return at_src.unionByName(gather(back, end_nodes(nodes, back, by, src, RECEIVES), by, src, columns, "s", salt))


def edge_sage_layer(nodes, edges, by, features, weights, width, src="src", dst="dst", salt=1) -> DataFrame:
    """``h' = relu(Wu [h, mean relu(Wm [h_src, e])])``; no in-edge means zero.

    ``weights`` holds ``msg_w, msg_b, upd_w, upd_b``; ``width`` is the input width.
    ``nodes`` None stands for the constant feature 1 on every endpoint: messages
    then depend on edge attributes alone, so the layer is one grouped average
    without any join, and its nodes are marked with the ends at which they occur.
    Otherwise each direction meets the nodes of its senders alone, and marks are kept.
    """
    names = hidden(width)
    own = edges.select(*by, src, dst, *features)
    if nodes is None:
        gathered, senders, marks = bidirect(own, src, dst, "__forward"), [F.lit(1.0)], _marks()
    else:
        gathered, marks = _both_directions(own, nodes, by, names, salt, src, dst), []
        senders = [F.col(c) for c in hidden(width, "s")]
    inputs = senders + [F.col(f) for f in features]
    messages = [vx.relu(m) for m in vx.dense(inputs, weights["msg_w"], weights["msg_b"])]
    out = len(messages)
    means = gathered.groupBy(F.col(dst).alias("node"), *by).agg(
        *[F.avg(m).alias(f"m_{i}") for i, m in enumerate(messages)], *marks
    )
    if nodes is None:
        joined, own = means, [F.lit(1.0)]
    else:
        joined, own = nodes.join(means, ["node", *by], "left"), [F.col(c) for c in names]
    own = own + [F.coalesce(F.col(f"m_{i}"), F.lit(0.0)) for i in range(out)]
    updated = [vx.relu(u) for u in vx.dense(own, weights["upd_w"], weights["upd_b"])]
    kept = [c for c in (SENDS, RECEIVES) if c in joined.columns]
    return joined.select(*by, "node", *[u.alias(f"h_{i}") for i, u in enumerate(updated)], *kept)


def encode_nodes(edges: DataFrame, by, features, layers, src="src", dst="dst", salt=1) -> DataFrame:
    """Stack of edge-SAGE layers over the constant node feature.

    Every layer reads the previous node vectors twice, so they are written once
    per layer; later joins also know their real size and broadcast only when it
    is below Spark's threshold.
    """
    nodes, width = None, 1
    for weights in layers:
        nodes = cut_lineage(edge_sage_layer(nodes, edges, by, features, weights, width, src, dst, salt))
        width = len(weights["upd_b"])
    return nodes


def _parallel_counts(edges, by, src, dst):
    """Directed pairs of the bidirected graph with their multiplicity.

    Parallel edges send the same message when attributes are not used, so they
    are counted before any vector is joined.
    """
    mp = bidirect(edges.select(*by, src, dst), src, dst)
    return mp.groupBy(src, dst, *by).agg(F.count(F.lit(1)).alias("__n"))


def sage_mean_layer(nodes, edges, by, weights, width, src="src", dst="dst", salt=1) -> DataFrame:
    """``h' = Wl mean(h_neighbours) + bl + Wr h``, without edge attributes.

    Each direction meets the nodes of its senders alone. Parallel edges need no count of
    their own: sums are combined per target before they move.
    """
    names = hidden(width)
    gathered = _both_directions(edges.select(*by, src, dst), nodes, by, names, salt, src, dst)
    sums = gathered.groupBy(F.col(dst).alias("node"), *by).agg(
        F.count(F.lit(1)).alias("__t"), *[F.sum(f"s_{i}").alias(f"a_{i}") for i in range(width)]
    )
    joined = nodes.drop(SENDS, RECEIVES).join(sums, ["node", *by], "left")
    means = [F.coalesce(F.col(f"a_{i}") / F.col("__t"), F.lit(0.0)) for i in range(width)]
    rooted = vx.dense(
        means + [F.col(c) for c in names],
        [[*l, *r] for l, r in zip(weights["left_w"], weights["root_w"])], weights["left_b"],
    )
    return joined.select(*by, "node", *[u.alias(f"h_{i}") for i, u in enumerate(rooted)])


def gcn_layer(nodes, edges, by, weights, width, src="src", dst="dst", salt=1) -> DataFrame:
    """Symmetric degree-normalised sum with one self-loop per node.

    Existing self-loops are replaced by that one loop; parallel edges count.
    """
    names = hidden(width)
    pairs = _parallel_counts(edges, by, src, dst).where(F.col(src) != F.col(dst))
    degrees = pairs.groupBy(*by, F.col(dst).alias("node")).agg(F.sum("__n").alias("__d"))
    scaled = nodes.join(degrees, [*by, "node"], "left").withColumn(
        "__d", F.coalesce("__d", F.lit(0)) + 1
    )
    root = F.sqrt("__d")
    sources = scaled.select(*by, "node", *[(F.col(c) / root).alias(c) for c in names])
    gathered = gather(pairs, sources, by, src, names, "s", salt)
    sums = gathered.groupBy(*by, F.col(dst).alias("node")).agg(
        *[F.sum(F.col(f"s_{i}") * F.col("__n")).alias(f"a_{i}") for i in range(width)]
    )
    joined = scaled.join(sums, [*by, "node"], "left")
    mixed = [
        F.coalesce(F.col(f"a_{i}"), F.lit(0.0)) / root + F.col(c) / F.col("__d")
        for i, c in enumerate(names)
    ]
    out = vx.dense(mixed, weights["w"], weights["b"])
    return joined.select(*by, "node", *[u.alias(f"h_{i}") for i, u in enumerate(out)])


def gatv2_layer(
    nodes, edges, by, features, weights, width, heads, concat=True, src="src", dst="dst", salt=1
) -> DataFrame:
    """Attention over in-edges per target and head.

    Score ``a . leaky_relu(Wl h_src + Wr h_dst + We e)``, softmax per target,
    weighted sum of ``Wl h_src``. Self-loops are replaced by one loop per node
    whose attributes are the mean of its incoming edges (zero without any).
    Heads are concatenated, or averaged when ``concat`` is False.

    Edges meet the nodes that occur at their ends before they are turned. The softmax is grouped sums
    rather than a window: powers are summed per target and magnitude of the scores,
    shifted by that magnitude, and the few sums of a target are brought to its largest
    one. So the scored edges are neither written nor moved, and a hub's edges are
    combined before they meet.
    """
    names = hidden(width)
    total = len(weights["left_w"])
    size = total // heads
    own = edges.select(*by, src, dst, *features).where(F.col(src) != F.col(dst))
    incoming = bidirect(own, src, dst).groupBy(F.col(dst).alias("node"), *by).agg(*[F.avg(f).alias(f) for f in features])
    inputs = [F.col(c) for c in names]

    def projected(rows):
        return rows.select(
            *by, "node",
            *[c.alias(f"l_{i}") for i, c in enumerate(vx.dense(inputs, weights["left_w"], weights["left_b"]))],
            *[c.alias(f"r_{i}") for i, c in enumerate(vx.dense(inputs, weights["right_w"], weights["right_b"]))],
        )

    left, right = [f"l_{i}" for i in range(total)], [f"r_{i}" for i in range(total)]
    ends = {end: projected(end_nodes(nodes, own, by, end, mark)) for end, mark in ((src, SENDS), (dst, RECEIVES))}

    # The edges meet each end once, with all that either direction needs of it.
    both = gather(own, ends[dst], by, dst, left + right, "t", salt)
    both = gather(both, ends[src], by, src, left + right, "s", salt)
    met = both.select(
        *by, *features,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.col(target).alias("node"),
                        *[F.col(f"{a}_{i}").alias(f"x_{i}") for i in range(total)],
                        *[F.col(f"{b}_{total + i}").alias(f"y_{i}") for i in range(total)],
                    )
                    for target, a, b in ((dst, "s", "t"), (src, "t", "s"))
                ]
            )
        ).alias("__e"),
    ).select(*by, F.col("__e.node").alias(dst), *features, *[f"__e.{side}_{i}" for side in ("x", "y") for i in range(total)])
    # As an edge, a loop of an unnamed node meets no node.
    named = F.col("node").isNotNull()
    for key in by:
        named = named & F.col(key).isNotNull()
    loops = projected(nodes.where(named)).join(incoming, ["node", *by], "left").select(
        *by, F.col("node").alias(dst), *[F.coalesce(f, F.lit(0.0)).alias(f) for f in features],
        *[F.col(f"{c}_{i}").alias(f"{side}_{i}") for c, side in (("l", "x"), ("r", "y")) for i in range(total)],
    )
    gathered = met.unionByName(loops)
    attributes = vx.dense([F.col(f) for f in features], weights["edge_w"], [0.0] * total)
    scores = []
    for head in range(heads):
        score = F.lit(0.0)
        for i in range(head * size, (head + 1) * size):
            z = F.col(f"x_{i}") + F.col(f"y_{i}") + attributes[i]
            leaky = F.when(z > 0, z).otherwise(z * LEAKY_SLOPE)
            score = score + F.lit(float(weights["att"][i])) * leaky
        scores.append(score)
    scored = gathered.select(
        *by, dst, *[f"x_{i}" for i in range(total)], *[s.alias(f"e_{h}") for h, s in enumerate(scores)]
    )
    levels = [F.floor(F.col(f"e_{h}") / SCORE_STEP).cast("double") * SCORE_STEP for h in range(heads)]
    power = [F.exp(F.col(f"e_{h}") - levels[h]) for h in range(heads)]
    part = scored.groupBy(F.col(dst).alias("node"), *by, *[b.alias(f"b_{h}") for h, b in enumerate(levels)]).agg(
        *[F.sum(power[h]).alias(f"z_{h}") for h in range(heads)],
        *[F.sum(power[i // size] * F.col(f"x_{i}")).alias(f"o_{i}") for i in range(total)],
    )
    # A target has a row per magnitude here, however many edges it has.
    own_rows = Window.partitionBy("node", *by)
    peaked = part.withColumns({f"p_{h}": F.max(f"b_{h}").over(own_rows) for h in range(heads)})
    shift = [F.exp(F.col(f"b_{h}") - F.col(f"p_{h}")) for h in range(heads)]
    sums = peaked.groupBy("node", *by).agg(
        *[F.sum(F.col(f"z_{h}") * shift[h]).alias(f"z_{h}") for h in range(heads)],
        *[F.sum(F.col(f"o_{i}") * shift[i // size]).alias(f"o_{i}") for i in range(total)],
    )
    ratios = [
        F.when(F.col(f"z_{i // size}") == 0, float("nan")).otherwise(F.col(f"o_{i}") / F.col(f"z_{i // size}"))
        for i in range(total)
    ]
    if concat:
        out = [r + F.lit(float(b)) for r, b in zip(ratios, weights["bias"])]
    else:
        out = []
        for i in range(size):
            mean = F.lit(0.0)
            for head in range(heads):
                mean = mean + ratios[head * size + i]
            out.append(mean / F.lit(float(heads)) + F.lit(float(weights["bias"][i])))
    return sums.select(*by, "node", *[u.alias(f"h_{i}") for i, u in enumerate(out)])


def edge_representation(
    edges, nodes, by, features, width, keep=(), src="src", dst="dst", salt=1, by_end=True
) -> DataFrame:
    """``[h_src, h_dst, e]`` as columns ``z_0, z_1, ...`` on the original edges; ``by_end`` as in :func:`build_edges`."""
    names = hidden(width)
    at_src, at_dst = [
        end_nodes(nodes, edges, by, end, mark) if by_end else nodes for end, mark in ((src, SENDS), (dst, RECEIVES))
    ]
    both = gather(gather(edges, at_src, by, src, names, "s", salt), at_dst, by, dst, names, "t", salt)
    parts = [f"s_{i}" for i in range(width)] + [f"t_{i}" for i in range(width)] + list(features)
    return both.select(*by, *keep, src, dst, *[F.col(p).alias(f"z_{i}") for i, p in enumerate(parts)])


def head_probabilities(repr_df: DataFrame, heads, width) -> DataFrame:
    """Kept columns and one probability array per head, named as in ``heads``.

    Two-layer heads with ReLU in between. Hidden units, logits and powers are
    separate projections of scalar columns: nothing is computed twice and all of
    it stays in generated code.
    """
    inputs = [F.col(f"z_{i}") for i in range(width)]
    kept = [c for c in repr_df.columns if not c.startswith("z_")]
    units, logits, groups = [], [], {}
    for k, (name, head) in enumerate(sorted(heads.items())):
        inner = [vx.relu(c) for c in vx.dense(inputs, head["w1"], head["b1"])]
        units += [u.alias(f"__u{k}_{i}") for i, u in enumerate(inner)]
        outer = vx.dense([F.col(f"__u{k}_{i}") for i in range(len(inner))], head["w2"], head["b2"])
        groups[name] = [f"__l{k}_{i}" for i in range(len(outer))]
        logits += [o.alias(c) for o, c in zip(outer, groups[name])]
    return vx.softmax_scalars(repr_df.select(*kept, *units).select(*kept, *logits), kept, groups)


def scored(df: DataFrame, probabilities="probabilities") -> DataFrame:
    """Predicted index, confidence and entropy from probabilities."""
    p = F.col(probabilities)
    return df.withColumns(
        {
            "pred_idx": vx.argmax(p),
            "confidence": F.array_max(p),
            "entropy": vx.entropy_epsilon(p),
        }
    )


def score_edges(repr_df: DataFrame, head, width) -> DataFrame:
    """Probabilities, argmax (first maximum), confidence, entropy per edge."""
    return scored(head_probabilities(repr_df, {"probabilities": head}, width))


#: Bytes of head weights that are sent whole to every task.
HEAD_BYTES = 256 << 20
#: Numbers in a table of heads that is sent whole; rows are dealt to the heads of a larger one.
TABLE_NUMBERS = 2_000_000


def head_arrays(heads):
    """Weights by name as NumPy arrays; more than ``HEAD_BYTES`` of them are an error."""
    arrays = {name: {k: np.asarray(v, dtype=float) for k, v in head.items()} for name, head in heads.items()}
    size = sum(a.nbytes for head in arrays.values() for a in head.values())
    if size > HEAD_BYTES:
        raise ValueError(f"{size} bytes of head weights; give them as a table to score_clients_table.")
    return arrays


def head_table(spark, heads) -> DataFrame:
    """Heads as rows ``head, w1, b1, w2, b2``."""
    rows = [(name, *[np.asarray(head[k], dtype=float).tolist() for k in ("w1", "b1", "w2", "b2")]) for name, head in heads.items()]
    return spark.createDataFrame(rows, _HEAD_SCHEMA)


_HEAD_SCHEMA = "head string, w1 array<array<double>>, b1 array<double>, w2 array<array<double>>, b2 array<double>"


def packed(repr_df: DataFrame, width, vector="z") -> DataFrame:
    """``z_0, z_1, ...`` as one array column."""
    kept = [c for c in repr_df.columns if not c.startswith("z_")]
    return repr_df.select(*kept, F.array(*[F.col(f"z_{i}").cast("double") for i in range(width)]).alias(vector))


def _probabilities(logits):
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def score_all_heads(repr_df: DataFrame, heads, width) -> DataFrame:
    """One row per edge and head; the representation is computed once.

    The first layers of all heads are one matrix, so an Arrow batch takes one product
    for all of them, whatever their number. Heads have the same shape.
    """
    arrays = head_arrays(heads)
    names = sorted(arrays)
    stacked = {k: np.stack([arrays[n][k] for n in names]) for k in ("w1", "b1", "w2", "b2")}
    shared = repr_df.sparkSession.sparkContext.broadcast((names, stacked))
    rows = packed(repr_df, width)
    kept = [c for c in rows.columns if c != "z"]

    def run(batches):
        names, head = shared.value
        count, inner, classes = len(names), head["w1"].shape[1], head["w2"].shape[1]
        first, offset = head["w1"].reshape(count * inner, -1).T, head["b1"].reshape(-1)
        for whole in batches:
            # The products of a slice are as many numbers as a batch of 10,000 rows has for one head.
            step = max(1, 10_000 // count)
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                units = np.maximum(_matrix(batch["z"]) @ first + offset, 0.0).reshape(-1, count, inner)
                found = _probabilities(np.einsum("rhi,hci->rhc", units, head["w2"]) + head["b2"])
                out = pa.Table.from_batches([batch.select(kept)]).take(pa.array(np.repeat(np.arange(batch.num_rows), count)))
                out = out.append_column("head", pa.array(names * batch.num_rows))
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, classes, dtype=np.int32), found.ravel())
                yield from out.append_column("probabilities", lists).combine_chunks().to_batches()

    schema = StructType([*rows.select(*kept).schema.fields]).add("head", "string").add("probabilities", ArrayType(DoubleType()))
    return scored(rows.mapInArrow(run, schema))


def score_own_head(repr_df: DataFrame, heads, width, client="scenario") -> DataFrame:
    """Each row under the head of its own client only; a missing head fails."""
    return score_clients_wide(packed(repr_df, width), heads, client)


def score_clients_table(rows: DataFrame, heads: DataFrame, client, vector="z", salt=8) -> DataFrame:
    """As :func:`score_clients_wide` with the weights as a table of any size.

    ``heads`` is a :func:`head_table`. Up to ``TABLE_NUMBERS`` weights are sent to the
    rows, which do not move for them. Of more, rows and weights of a client meet in ``salt``
    places, where the weights come first; a task holds one head and one Arrow batch.
    """
    kept = [c for c in rows.columns if c != vector]
    inner = F.aggregate("w1", F.lit(0), lambda n, row: n + F.size(row))
    outer = F.aggregate("w2", F.lit(0), lambda n, row: n + F.size(row))
    if (heads.agg(F.sum((inner + outer).cast("long"))).first()[0] or 0) <= TABLE_NUMBERS:
        known = {head["head"]: {k: head[k] for k in ("w1", "b1", "w2", "b2")} for head in heads.collect()}
        return score_clients_wide(rows, known, client, vector, missing=float("nan"))
    spread = rows.withColumns(
        {"__key": F.col(client), "__salt": F.pmod(F.xxhash64(*kept, vector), F.lit(salt)), "__weights": F.lit(0)}
    )
    weights = heads.select(
        F.col("head").alias("__key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))).alias("__salt"),
        F.lit(1).alias("__weights"), F.struct("w1", "b1", "w2", "b2").alias("__head"),
    )
    dealt = spread.unionByName(weights, allowMissingColumns=True).repartition("__key", "__salt")
    dealt = dealt.sortWithinPartitions("__key", "__salt", F.desc("__weights"))

    def run(batches):
        name, head = None, None
        for batch in batches:
            keys, first = batch["__key"].to_pylist(), 0
            marks = batch["__weights"].to_numpy()
            for place in range(batch.num_rows + 1):
                ends = place == batch.num_rows or marks[place] or keys[place] != keys[first] or marks[first]
                if not ends or place == first:
                    continue
                if marks[first]:
                    name, head = keys[first], {k: np.array(v, float) for k, v in batch["__head"][first].as_py().items()}
                else:
                    if head is None or keys[first] != name:
                        raise ValueError(f"no head for client {keys[first]}")
                    part = batch.slice(first, place - first)
                    units = np.maximum(_matrix(part[vector]) @ head["w1"].T + head["b1"], 0.0)
                    found = _probabilities(units @ head["w2"].T + head["b2"])
                    lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), found.ravel())
                    out = pa.Table.from_batches([part.select(kept)]).append_column("probabilities", lists)
                    yield from out.combine_chunks().to_batches()
                first = place

    schema = StructType([*rows.select(*kept).schema.fields]).add("probabilities", ArrayType(DoubleType()))
    return scored(dealt.mapInArrow(run, schema))


def score_edges_wide(repr_df: DataFrame, head, vector="z") -> DataFrame:
    """As :func:`score_edges` for wide array columns: one matrix product per Arrow batch."""
    return score_clients_wide(repr_df.withColumn("__client", F.lit("")), {"": head}, "__client", vector).drop("__client")


def score_clients_wide(repr_df: DataFrame, heads, client, vector="z", missing=None) -> DataFrame:
    """Every row under the head of its client, in one pass over the rows.

    ``heads`` maps a client to its weights. They are sent to the tasks once, up to
    ``HEAD_BYTES``, and each Arrow batch takes one matrix product per client in it. A
    client without a head is an error. ``missing`` is what a row with a missing value
    has for probabilities.
    """
    shared = repr_df.sparkSession.sparkContext.broadcast(head_arrays(heads))

    @arrow_udf("array<double>")
    def probabilities(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, vectors in batches:
            codes = names.dictionary_encode(null_encoding="encode")
            places, parts, sizes = codes.indices.to_numpy(), [], np.zeros(len(names) + 1, np.int32)
            order = np.argsort(places, kind="stable")
            ends = np.cumsum(np.bincount(places, minlength=len(codes.dictionary)))
            for k, name in enumerate(codes.dictionary.to_pylist()):
                if name not in shared.value:
                    raise ValueError(f"no head for client {name}")
                head, own = shared.value[name], order[ends[k - 1] if k else 0 : ends[k]]
                inner = np.maximum(_matrix(vectors.take(pa.array(own))) @ head["w1"].T + head["b1"], 0.0)
                parts.append((own, inner @ head["w2"].T + head["b2"]))
                sizes[own + 1] = parts[-1][1].shape[1]
            offsets = np.cumsum(sizes, dtype=np.int32)
            flat, unknown = np.empty(offsets[-1]), np.zeros(offsets[-1], bool)
            for own, scores in parts:
                cells = offsets[own][:, None] + np.arange(scores.shape[1])
                flat[cells] = _probabilities(scores)
                if missing is None:
                    # A row with a missing value has no scores.
                    unknown[cells] = np.isnan(scores).any(axis=1)[:, None]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=unknown))

    kept = [c for c in repr_df.columns if c != vector]
    return scored(repr_df.select(*kept, probabilities(F.col(client), F.col(vector)).alias("probabilities")))


def edge_classifier_rows(edges, by, features, keep=(), src="src", dst="dst") -> DataFrame:
    """Node-aggregated features of both ends beside the edge's own features.

    The aggregate is written first: both joins then shuffle for themselves, so the
    edges of a hub can be split over tasks.
    """
    means = cut_lineage(marked_aggregate(edges, by, features, "mean", src, dst))

    def side(end, prefix, mark):
        own = end_nodes(means, edges, by, end, mark)
        return own.select(*by, F.col("node").alias(end), *[F.col(f).alias(f"{prefix}_{f}") for f in features])

    rows = edges.join(side(src, "s", SENDS), [src, *by]).join(side(dst, "t", RECEIVES), [dst, *by])
    columns = [f"{p}_{f}" for p in ("s", "t") for f in features] + list(features)
    return rows.select(*by, *keep, F.array(*columns).alias("__x"), *columns)


def fit_edge_classifier(rows: DataFrame, weights: DataFrame, label="label_idx", columns=(), kind="logistic", **params):
    """Weighted supervised edge classification on the train rows.

    ``weights(label, weight)`` is the class-weight table. Returns the fitted
    ``pyspark.ml`` pipeline; apply it with ``.transform``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    train = rows.where(F.col("split") == "train").join(weights.select(label, "weight"), label)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="vector")
    model = {"logistic": LogisticRegression, "forest": RandomForestClassifier}[kind](
        featuresCol="vector", labelCol=label, weightCol="weight", **params
    )
    return Pipeline(stages=[assembler, model]).fit(train)
