"""Graph construction, topology and neighbourhood aggregation over edge views."""

from pyspark.sql import functions as F

from ..operators import graph, neighbors, repartition, sampling
from ..session import cut_lineage
from . import views
from .flow_queries import BASE
from .split_queries import EDGES, IID, iid_edges
from .views import EDGE_CLASSES, EDGE_FEATURES, RAW_EDGES, rounded, rounded_sql

BY = ["scenario"]
KEYS = ("scenario", "orig_h", "resp_h")
RAW = f"WITH {RAW_EDGES}"
WIDTH = 2
HEADS = 2


def matrix(rows, columns, shift=0):
    """Small fixed weights for the layer queries."""
    return [[((i * 7 + j * 3 + shift) % 5 - 2) / 4 for j in range(columns)] for i in range(rows)]


def bias(rows, shift=0):
    return [((i + shift) % 3 - 1) / 10 for i in range(rows)]


NF = len(EDGE_FEATURES)
SAGE = [
    {"msg_w": matrix(WIDTH, 1 + NF), "msg_b": bias(WIDTH), "upd_w": matrix(WIDTH, 1 + WIDTH, 1), "upd_b": bias(WIDTH, 1)},
    {"msg_w": matrix(WIDTH, WIDTH + NF, 2), "msg_b": bias(WIDTH, 2), "upd_w": matrix(WIDTH, 2 * WIDTH, 4), "upd_b": bias(WIDTH, 2)},
]
MEAN_SAGE = {"left_w": matrix(WIDTH, NF), "left_b": bias(WIDTH, 1), "root_w": matrix(WIDTH, NF, 1)}
GCN = {"w": matrix(WIDTH, NF, 2), "b": bias(WIDTH, 2)}
GAT = {
    "left_w": matrix(HEADS * WIDTH, NF), "left_b": bias(HEADS * WIDTH), "right_w": matrix(HEADS * WIDTH, NF, 1),
    "right_b": bias(HEADS * WIDTH, 1), "edge_w": matrix(HEADS * WIDTH, NF, 3),
    "att": [0.5, -0.25, 0.75, 0.25], "bias": bias(HEADS * WIDTH, 2),
}
REPR_WIDTH = 2 * WIDTH + NF
HEAD_NAMES = ("head-a", "head-b", "head-c")
SCORE_HEADS = {
    name: {"w1": matrix(3, REPR_WIDTH, i), "b1": bias(3, i), "w2": matrix(len(EDGE_CLASSES), 3, i), "b2": bias(len(EDGE_CLASSES), i)}
    for i, name in enumerate(HEAD_NAMES)
}


def linear_sql(inputs, weights, offsets):
    return [
        " + ".join([str(float(b))] + [f"{float(w)}::DOUBLE * {x}" for w, x in zip(row, inputs)])
        for row, b in zip(weights, offsets)
    ]


def relu_sql(expression):
    return f"greatest({expression}, 0)"


def edges_of(spark, sf_dir):
    """Edges whose ends are named ``src`` and ``dst``."""
    return views.raw_edges(spark, sf_dir).withColumnsRenamed({"orig_h": "src", "resp_h": "dst"})


LINKS = f"""{RAW}, links AS (SELECT * RENAME (orig_h AS src, resp_h AS dst) FROM raw_edges),
mp AS (SELECT * FROM links UNION ALL SELECT * REPLACE (dst AS src, src AS dst) FROM links),
nodes AS (SELECT DISTINCT scenario, src AS node FROM mp)"""


def _nodes(spark, sf_dir):
    return graph.node_dictionary(views.raw_edges(spark, sf_dir), BY)


NODE_IDS = f"""ends AS (SELECT scenario, orig_h AS node FROM raw_edges UNION SELECT scenario, resp_h FROM raw_edges),
node_ids AS (SELECT scenario, node, row_number() OVER (PARTITION BY scenario ORDER BY node) - 1 AS node_id FROM ends)"""


def _edges(spark, sf_dir):
    rows = views.raw_edges(spark, sf_dir).withColumn(
        "label_idx", views.edge_label_index(F.col("detailed_label"))
    )
    edges = graph.build_edges(rows, graph.node_dictionary(rows, BY), BY)
    return edges.select("scenario", "edge_key", "src", "dst", "label_idx", "binary_label")


_EDGES_SQL = f"""{EDGES}, {NODE_IDS} SELECT e.scenario, edge_key, a.node_id AS src, b.node_id AS dst, label_idx,
  CAST(detailed_label <> 'Benign' AS INTEGER) AS binary_label FROM indexed_edges e
JOIN node_ids a ON a.scenario = e.scenario AND a.node = orig_h
JOIN node_ids b ON b.scenario = e.scenario AND b.node = resp_h"""


def _bidirect(spark, sf_dir):
    both = graph.bidirect(edges_of(spark, sf_dir))
    return both.groupBy("scenario", "src").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("f_price"), 4).alias("price")
    )


def _stats(spark, sf_dir):
    rows = graph.graph_stats(views.raw_edges(spark, sf_dir), BY, EDGE_FEATURES, len(EDGE_CLASSES))
    counts = F.transform(F.map_entries("label_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("label_counts", F.concat_ws(",", counts))


_STATS_SQL = f"""{RAW}, {NODE_IDS} SELECT e.scenario, any_value(k) AS num_nodes, count(*) AS num_edges, 2 * count(*) AS num_edges_mp,
  {NF} AS feature_dim, {len(EDGE_CLASSES)} AS num_classes, 0 AS num_isolated,
  count(*) FILTER (detailed_label = 'Benign') AS benign_edges, count(*) FILTER (detailed_label <> 'Benign') AS malicious_edges,
  (SELECT string_agg(detailed_label || '=' || c, ',' ORDER BY detailed_label) FROM
    (SELECT detailed_label, count(*) AS c FROM raw_edges x WHERE x.scenario = e.scenario GROUP BY detailed_label)) AS label_counts
FROM raw_edges e JOIN (SELECT scenario, count(*) AS k FROM ends GROUP BY scenario) n ON n.scenario = e.scenario GROUP BY e.scenario"""


def _degree(spark, sf_dir):
    return graph.degree(views.raw_edges(spark, sf_dir), BY)


def _topology(spark, sf_dir):
    rows = graph.topology(views.raw_edges(spark, sf_dir), BY, EDGE_FEATURES)
    return rows.withColumn("mean_degree", F.round("mean_degree", 6)).withColumn(
        "pair_density", F.round("pair_density", 8)
    )


_TOPOLOGY_SQL = f"""{RAW}, {NODE_IDS}, d AS (SELECT scenario, node, count(*) AS degree FROM
  (SELECT scenario, orig_h AS node FROM raw_edges UNION ALL SELECT scenario, resp_h FROM raw_edges) GROUP BY ALL),
dd AS (SELECT scenario, count(*) AS n, avg(degree) AS mean_degree, max(degree) AS max_degree FROM d GROUP BY scenario),
e AS (SELECT scenario, count(*) AS num_edges, count(*) FILTER (orig_h = resp_h) AS self_loops,
  count(DISTINCT (orig_h, resp_h)) AS unique_pairs FROM raw_edges GROUP BY scenario)
SELECT scenario, n AS num_nodes, num_edges, n AS nodes_with_edges, 0 AS isolated_nodes, self_loops, unique_pairs,
  num_edges - unique_pairs AS parallel_edges, round(mean_degree, 6) AS mean_degree, max_degree,
  round(unique_pairs / CAST(n * greatest(n - 1, 1) AS DOUBLE), 8) AS pair_density, 0 AS nonfinite_values
FROM e JOIN dd USING (scenario)"""


def order_edges(spark, sf_dir):
    """Customers and their orders: a forest of stars."""
    return views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("client-"), (F.col("o_custkey") % 6).cast("string")).alias("scenario"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("orig_h"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("resp_h"),
    )


def _components(source):
    def run(spark, sf_dir):
        return graph.weak_components(source(spark, sf_dir), BY)

    return run


def _component_stats(spark, sf_dir):
    return graph.component_stats(graph.weak_components(order_edges(spark, sf_dir), BY), BY)


def _flow_edges(spark, sf_dir):
    return views.raw_flows(spark, sf_dir).select("scenario", "orig_h", "resp_h")


def _closure(pairs, head):
    return f"""WITH RECURSIVE {head}, pairs AS ({pairs}),
sym AS (SELECT * FROM pairs UNION SELECT scenario, b, a FROM pairs),
reach AS (SELECT DISTINCT scenario, a AS node, a AS other FROM sym
  UNION SELECT r.scenario, r.node, s.b FROM reach r JOIN sym s ON s.scenario = r.scenario AND s.a = r.other),
components AS (SELECT scenario, node, min(other) AS component FROM reach GROUP BY ALL)"""


_ORDER_CLOSURE = _closure(
    "SELECT DISTINCT 'client-' || (o_custkey % 6) AS scenario, 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders",
    "unused AS (SELECT 1)",
)
_FLOW_CLOSURE = _closure("SELECT DISTINCT scenario, orig_h AS a, resp_h AS b FROM raw_flows", BASE.removeprefix("WITH "))


def _duplicates(spark, sf_dir):
    """Duplicates of the edge view cut to coarse features, so that some exist."""
    rows = views.raw_edges(spark, sf_dir).select(
        "scenario", "orig_h", F.lit("any").alias("resp_h"), "detailed_label", *[F.floor(F.col(f) * 3).alias(f) for f in EDGE_FEATURES]
    )
    return graph.exact_duplicate_edges(rows, BY, ["orig_h", "resp_h", "detailed_label", *EDGE_FEATURES])


def _namespace(spark, sf_dir):
    rows = graph.namespace_nodes(views.raw_flows(spark, sf_dir), "scenario")
    return rows.select("seq", "orig_h", "resp_h")


def _reindex(spark, sf_dir):
    moved = cut_lineage(iid_edges(spark, sf_dir)).withColumn("order", F.concat_ws("|", "scenario", "edge_key"))
    return repartition.reindex_nodes(moved, "destination", "order", "scenario", ("orig_h", "resp_h"))


_REINDEX_SQL = f"""{IID}, seen AS (
  SELECT destination, scenario, orig_h AS node, scenario || '|' || edge_key AS o, 0 AS side FROM iid
  UNION ALL SELECT destination, scenario, resp_h, scenario || '|' || edge_key, 1 FROM iid),
firsts AS (SELECT destination, scenario, node, min((o, side)) AS f FROM seen GROUP BY ALL)
SELECT destination, scenario, node, row_number() OVER (PARTITION BY destination ORDER BY f) - 1 AS node_id FROM firsts"""


def _aggregate(how):
    def run(spark, sf_dir):
        rows = neighbors.edge_to_node_aggregate(edges_of(spark, sf_dir), BY, EDGE_FEATURES, how)
        return rows.select("scenario", "node", *[rounded(F.col(f), 5).alias(f) for f in EDGE_FEATURES])

    function = {"mean": "avg", "sum": "sum"}[how]
    sql = f"{LINKS} SELECT scenario, dst AS node, " + ", ".join(
        f"{rounded_sql(f'{function}({f})', 5)} AS {f}" for f in EDGE_FEATURES
    ) + " FROM mp GROUP BY ALL"
    return run, sql


def embeddings(spark, sf_dir):
    """Two layers over the constant node feature."""
    return neighbors.encode_nodes(edges_of(spark, sf_dir), BY, EDGE_FEATURES, SAGE)


def _sage_sql(depth, previous, width):
    weights = SAGE[depth]
    inputs = [f"p.h_{i}" for i in range(width)] + [f"mp.{f}" for f in EDGE_FEATURES]
    messages = linear_sql(inputs, weights["msg_w"], weights["msg_b"])
    own = [f"p.h_{i}" for i in range(width)] + [f"coalesce(m_{i}, 0)" for i in range(WIDTH)]
    updates = linear_sql(own, weights["upd_w"], weights["upd_b"])
    return f"""agg{depth} AS (SELECT mp.scenario, mp.dst AS node, {", ".join(f"avg({relu_sql(m)}) AS m_{i}" for i, m in enumerate(messages))}
  FROM mp JOIN {previous} p ON p.scenario = mp.scenario AND p.node = mp.src GROUP BY ALL),
layer{depth} AS (SELECT p.scenario, p.node, {", ".join(f"{relu_sql(u)} AS h_{i}" for i, u in enumerate(updates))}
  FROM {previous} p LEFT JOIN agg{depth} a ON a.scenario = p.scenario AND a.node = p.node)"""


EMBEDDED = (
    LINKS + ",\nlayer_in AS (SELECT *, 1.0::DOUBLE AS h_0 FROM nodes),\n"
    + _sage_sql(0, "layer_in", 1) + ",\n" + _sage_sql(1, "layer0", WIDTH)
)
_ROUNDED = ", ".join(f"{rounded_sql(f'h_{i}', 5)} AS h_{i}" for i in range(WIDTH))


def _rounded(nodes, width=WIDTH):
    return nodes.select("scenario", "node", *[rounded(F.col(f"h_{i}"), 5).alias(f"h_{i}") for i in range(width)])


def feature_nodes(spark, sf_dir):
    """Node vectors from incident edge attributes, input of the other layers."""
    rows = neighbors.marked_aggregate(edges_of(spark, sf_dir), BY, EDGE_FEATURES)
    # Layers read the vectors several times.
    vectors = [F.col(f).alias(f"h_{i}") for i, f in enumerate(EDGE_FEATURES)]
    return cut_lineage(rows).select("scenario", "node", *vectors, graph.SENDS, graph.RECEIVES)


FEATURED = LINKS + ",\nvec AS (SELECT scenario, dst AS node, " + ", ".join(
    f"avg({f}) AS h_{i}" for i, f in enumerate(EDGE_FEATURES)
) + " FROM mp GROUP BY ALL)"


def _mean_sage(spark, sf_dir):
    return _rounded(
        neighbors.sage_mean_layer(feature_nodes(spark, sf_dir), edges_of(spark, sf_dir), BY, MEAN_SAGE, NF, salt=4)
    )


_MEAN_SAGE_SQL = f"""{FEATURED}, agg AS (SELECT mp.scenario, dst AS node, {", ".join(f"avg(h_{i}) AS a_{i}" for i in range(NF))}
  FROM mp JOIN vec v ON v.scenario = mp.scenario AND v.node = src GROUP BY ALL)
SELECT v.scenario, v.node, {", ".join(f"{rounded_sql(e, 5)} AS h_{i}" for i, e in enumerate(linear_sql(
    [f"a_{i}" for i in range(NF)] + [f"h_{i}" for i in range(NF)],
    [[*l, *r] for l, r in zip(MEAN_SAGE["left_w"], MEAN_SAGE["root_w"])], MEAN_SAGE["left_b"])))}
FROM vec v JOIN agg USING (scenario, node)"""


def _gcn(spark, sf_dir):
    return _rounded(neighbors.gcn_layer(feature_nodes(spark, sf_dir), edges_of(spark, sf_dir), BY, GCN, NF))


_GCN_SQL = f"""{FEATURED}, deg AS (SELECT scenario, dst AS node, count(*) + 1 AS d FROM mp WHERE src <> dst GROUP BY ALL),
s AS (SELECT v.*, d FROM vec v JOIN deg USING (scenario, node)),
agg AS (SELECT mp.scenario, dst AS node, {", ".join(f"sum(h_{i} / sqrt(d)) AS a_{i}" for i in range(NF))}
  FROM mp JOIN s ON s.scenario = mp.scenario AND s.node = src WHERE src <> dst GROUP BY ALL)
SELECT s.scenario, s.node, {", ".join(f"{rounded_sql(e, 5)} AS h_{i}" for i, e in enumerate(linear_sql(
    [f"(a_{i} / sqrt(d) + h_{i} / d)" for i in range(NF)], GCN["w"], GCN["b"])))}
FROM s JOIN agg USING (scenario, node)"""


def _gat(spark, sf_dir):
    nodes = neighbors.gatv2_layer(
        feature_nodes(spark, sf_dir), edges_of(spark, sf_dir), BY, EDGE_FEATURES, GAT, NF, HEADS
    )
    return _rounded(nodes, HEADS * WIDTH)


_TOTAL = HEADS * WIDTH


def _gat_score(head):
    edge = linear_sql([f"e.{f}" for f in EDGE_FEATURES], GAT["edge_w"], [0.0] * _TOTAL)
    terms = []
    for i in range(head * WIDTH, (head + 1) * WIDTH):
        z = f"(a.l_{i} + b.r_{i} + {edge[i]})"
        terms.append(f"{GAT['att'][i]}::DOUBLE * CASE WHEN {z} > 0 THEN {z} ELSE 0.2::DOUBLE * {z} END")
    return " + ".join(terms)


_GAT_SQL = f"""{FEATURED}, every AS (SELECT scenario, src, dst, {", ".join(EDGE_FEATURES)} FROM mp WHERE src <> dst
  UNION ALL SELECT scenario, dst, dst, {", ".join(f"avg({f})" for f in EDGE_FEATURES)} FROM mp WHERE src <> dst GROUP BY ALL),
prj AS (SELECT scenario, node, {", ".join(f"{e} AS l_{i}" for i, e in enumerate(linear_sql([f"h_{i}" for i in range(NF)], GAT["left_w"], GAT["left_b"])))},
  {", ".join(f"{e} AS r_{i}" for i, e in enumerate(linear_sql([f"h_{i}" for i in range(NF)], GAT["right_w"], GAT["right_b"])))} FROM vec),
sc AS (SELECT e.scenario, e.dst, {", ".join(f"a.l_{i}" for i in range(_TOTAL))}, {", ".join(f"{_gat_score(h)} AS e_{h}" for h in range(HEADS))}
  FROM every e JOIN prj a ON a.scenario = e.scenario AND a.node = e.src JOIN prj b ON b.scenario = e.scenario AND b.node = e.dst)
SELECT scenario, dst AS node, {", ".join(
    rounded_sql(f"sum(exp(e_{i // WIDTH}) * l_{i}) / sum(exp(e_{i // WIDTH})) + {GAT['bias'][i]}::DOUBLE", 5) + f" AS h_{i}" for i in range(_TOTAL))}
FROM sc GROUP BY ALL"""


def representation(spark, sf_dir):
    return neighbors.edge_representation(
        edges_of(spark, sf_dir), embeddings(spark, sf_dir), BY, EDGE_FEATURES, WIDTH,
        keep=["edge_key", "detailed_label"],
    )


def _representation(spark, sf_dir):
    rows = representation(spark, sf_dir)
    return rows.select(
        "scenario", "edge_key", *[rounded(F.col(f"z_{i}"), 5).alias(f"z_{i}") for i in range(REPR_WIDTH)]
    )


_PARTS = (
    [f"a.h_{i}" for i in range(WIDTH)] + [f"b.h_{i}" for i in range(WIDTH)] + [f"links.{f}" for f in EDGE_FEATURES]
)
_ROUNDED_PARTS = ", ".join(f"{rounded_sql(f'z_{i}', 5)} AS z_{i}" for i in range(REPR_WIDTH))
REPRESENTED = f"""{EMBEDDED}, repr AS (SELECT links.scenario, edge_key, detailed_label,
  {", ".join(f"{p} AS z_{i}" for i, p in enumerate(_PARTS))} FROM links
  JOIN layer1 a ON a.scenario = links.scenario AND a.node = src JOIN layer1 b ON b.scenario = links.scenario AND b.node = dst)"""


def _head_sql(name):
    head = SCORE_HEADS[name]
    inner = [relu_sql(e) for e in linear_sql([f"z_{i}" for i in range(REPR_WIDTH)], head["w1"], head["b1"])]
    return "[" + ", ".join(linear_sql([f"({e})" for e in inner], head["w2"], head["b2"])) + "]"


def scored_sql(names):
    heads = " UNION ALL ".join(
        f"SELECT scenario, edge_key, detailed_label, '{n}' AS head, {_head_sql(n)} AS logits FROM repr" for n in names
    )
    return f"""{REPRESENTED}, lg AS ({heads}),
pw AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS pows FROM lg),
pr AS (SELECT *, list_transform(pows, lambda x: x / list_sum(pows)) AS probabilities FROM pw),
scored AS (SELECT scenario, edge_key, detailed_label, head, list_position(probabilities, list_max(probabilities)) - 1 AS pred_idx,
  list_max(probabilities) AS confidence, list_sum(list_transform(probabilities, lambda p: -p * ln(p + 1e-12))) AS entropy FROM pr)"""


def _score(spark, sf_dir):
    rows = neighbors.score_edges(representation(spark, sf_dir), SCORE_HEADS["head-a"], REPR_WIDTH)
    return rows.select(
        "scenario", "edge_key", "pred_idx", rounded(F.col("confidence"), 5).alias("confidence"),
        rounded(F.col("entropy"), 5).alias("entropy"),
    )


def _score_wide(spark, sf_dir):
    wide = representation(spark, sf_dir).select(
        "scenario", "edge_key", F.array(*[f"z_{i}" for i in range(REPR_WIDTH)]).alias("z")
    )
    rows = neighbors.score_edges_wide(wide, SCORE_HEADS["head-b"])
    return rows.select(
        "scenario", "edge_key", "pred_idx", rounded(F.col("confidence"), 5).alias("confidence"),
        rounded(F.col("entropy"), 5).alias("entropy"),
    )


def _score_sql(name):
    return f"""{scored_sql([name])} SELECT scenario, edge_key, pred_idx, {rounded_sql('confidence', 5)} AS confidence,
  {rounded_sql('entropy', 5)} AS entropy FROM scored"""


def all_heads(spark, sf_dir):
    # Python hides from Spark what the result leaves unread, so it goes before the joins.
    return neighbors.score_all_heads(representation(spark, sf_dir).drop("detailed_label", "src", "dst"), SCORE_HEADS, REPR_WIDTH)


def _all_heads(spark, sf_dir):
    return all_heads(spark, sf_dir).select(
        "scenario", "edge_key", "head", "pred_idx", rounded(F.col("confidence"), 5).alias("confidence"),
        rounded(F.col("entropy"), 5).alias("entropy"),
    )


CLIENT_HEADS = 500


def _clients_table(spark, sf_dir):
    """500 clients, each scored by its own head from a table of heads."""
    number = F.conv(F.substring(F.md5("edge_key"), 1, 8), 16, 10).cast("long") % CLIENT_HEADS
    # Rows are dealt to the heads with what the result holds; Python hides from Spark what it leaves unread.
    own = representation(spark, sf_dir).drop("detailed_label", "src", "dst")
    rows = neighbors.packed(own, REPR_WIDTH).withColumn("client", number.cast("string"))
    heads = {str(i): SCORE_HEADS[HEAD_NAMES[i % len(HEAD_NAMES)]] for i in range(CLIENT_HEADS)}
    found = neighbors.score_clients_table(rows, neighbors.head_table(spark, heads), "client")
    return found.select("scenario", "edge_key", "client", "pred_idx", rounded(F.col("confidence"), 5).alias("confidence"))


_CLIENTS_TABLE_SQL = f"""{scored_sql(HEAD_NAMES)}, own AS (SELECT *, CAST('0x' || substr(md5(edge_key), 1, 8) AS BIGINT) % {CLIENT_HEADS} AS k FROM scored)
SELECT scenario, edge_key, CAST(k AS VARCHAR) AS client, pred_idx, {rounded_sql('confidence', 5)} AS confidence FROM own
WHERE head = {list(HEAD_NAMES)!r}[k % {len(HEAD_NAMES)} + 1]"""


def _validate(spark, sf_dir):
    # The cuts are known by now: a row finds its split on its own, so each reader does without a table.
    rows = views.split_edges(spark, sf_dir)
    nodes = graph.node_dictionary(rows, BY)
    edges = graph.build_edges(rows, nodes, BY)
    sizes = nodes.groupBy(*BY).agg(F.count(F.lit(1)).alias("num_nodes"))
    # A third of the classes lies outside the declared range, to be counted.
    return graph.validate_graph(edges, BY, 4, "edge_key", sizes)


_VALIDATE_SQL = f"""{EDGES} SELECT scenario, count(*) AS num_edges, 0 AS bad_node_ids,
  count(*) FILTER (label_idx >= 4) AS bad_labels, 0 AS bad_splits,
  count(*) - count(DISTINCT edge_key) AS repeated_edges, 0 AS edges_in_two_splits FROM split_edges GROUP BY scenario"""


def _classifier(spark, sf_dir):
    """Weighted classifier on edge and endpoint features: rows and valid scores per split and class."""
    edges = views.split_edges(spark, sf_dir).withColumnsRenamed({"orig_h": "src", "resp_h": "dst"})
    rows = neighbors.edge_classifier_rows(edges, BY, EDGE_FEATURES, keep=["split", "label_idx"])
    weights = sampling.class_weights(edges.where(F.col("split") == "train"), "label_idx")
    columns = [f"{p}_{f}" for p in ("s", "t") for f in EDGE_FEATURES] + list(EDGE_FEATURES)
    model = neighbors.fit_edge_classifier(rows, weights, columns=columns, maxIter=10)
    known = F.col("prediction").isin(*range(len(EDGE_CLASSES)))
    return model.transform(rows).groupBy("split", "label_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("scored")
    )


QUERIES = {
    "node_dictionary": (_nodes, f"{RAW}, {NODE_IDS} SELECT * FROM node_ids"),
    "build_edges": (_edges, _EDGES_SQL),
    "bidirect_edges": (
        _bidirect,
        f"{LINKS} SELECT scenario, src, count(*) AS n, {rounded_sql('sum(f_price)', 4)} AS price FROM mp GROUP BY ALL",
    ),
    "graph_stats": (_stats, _STATS_SQL),
    "node_degree": (
        _degree,
        f"{RAW} SELECT scenario, node, count(*) AS degree FROM (SELECT scenario, unnest([orig_h, resp_h]) AS node FROM raw_edges) GROUP BY ALL",
    ),
    "graph_topology": (_topology, _TOPOLOGY_SQL),
    "weak_components": (_components(order_edges), f"{_ORDER_CLOSURE} SELECT * FROM components"),
    "weak_components_flows": (_components(_flow_edges), f"{_FLOW_CLOSURE} SELECT * FROM components"),
    "component_stats": (
        _component_stats,
        f"""{_ORDER_CLOSURE} SELECT scenario, count(*) AS components, max(n) AS largest_component FROM
  (SELECT scenario, component, count(*) AS n FROM components GROUP BY ALL) GROUP BY scenario""",
    ),
    "exact_duplicate_edges": (
        _duplicates,
        f"""{RAW} SELECT scenario, count(*) - count(DISTINCT (orig_h, detailed_label, {', '.join(f'floor({f} * 3)' for f in EDGE_FEATURES)})) AS exact_duplicate_edges
  FROM raw_edges GROUP BY scenario""",
    ),
    "namespace_nodes": (
        _namespace, f"{BASE} SELECT seq, scenario || '::' || orig_h AS orig_h, scenario || '::' || resp_h AS resp_h FROM raw_flows",
    ),
    "reindex_after_repartition": (_reindex, _REINDEX_SQL),
    "edge_to_node_mean": _aggregate("mean"),
    "edge_to_node_sum": _aggregate("sum"),
    "edge_sage_layers": (
        lambda spark, sf_dir: _rounded(embeddings(spark, sf_dir)),
        f"{EMBEDDED} SELECT scenario, node, {_ROUNDED} FROM layer1",
    ),
    "sage_mean_layer": (_mean_sage, _MEAN_SAGE_SQL),
    "gcn_layer": (_gcn, _GCN_SQL),
    "gatv2_layer": (_gat, _GAT_SQL),
    "edge_representation": (
        _representation,
        f"{REPRESENTED} SELECT scenario, edge_key, {_ROUNDED_PARTS} FROM repr",
    ),
    "score_edges": (_score, _score_sql("head-a")),
    "score_edges_wide": (_score_wide, _score_sql("head-b")),
    "score_all_heads": (
        _all_heads,
        f"{scored_sql(HEAD_NAMES)} SELECT scenario, edge_key, head, pred_idx, {rounded_sql('confidence', 5)} AS confidence, {rounded_sql('entropy', 5)} AS entropy FROM scored",
    ),
    "score_clients_table": (_clients_table, _CLIENTS_TABLE_SQL),
    "validate_graph": (_validate, _VALIDATE_SQL),
    "fit_edge_classifier": (
        _classifier, f"{EDGES} SELECT split, label_idx, count(*) AS n, count(*) AS scored FROM split_edges GROUP BY ALL",
    ),
}
