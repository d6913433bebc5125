"""What steps read, write and move, apart from their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgraph_spark.operators import graph, neighbors, repartition
from flowgraph_spark.plans import graph_queries, window_queries
from flowgraph_spark.session import temporary_tables
from flowgraph_spark.streaming import detect

SCHEMA = "g string, src string, dst string, f0 double"
ROWS = [("a", "x", "y", 1.0), ("a", "x", "y", 3.0), ("a", "z", "y", 5.0), ("a", "y", "z", 2.0), ("b", "x", "x", 4.0), (None, "x", "y", 7.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_know_their_ends(spark):
    edges = spark.createDataFrame(ROWS, SCHEMA)
    layer = {"msg_w": [[1.0, 1.0]], "msg_b": [0.0], "upd_w": [[1.0, 1.0]], "upd_b": [0.0]}
    for nodes in (neighbors.encode_nodes(edges, ["g"], ["f0"], [layer, layer]), neighbors.marked_aggregate(edges, ["g"], ["f0"])):
        for end, mark in (("src", graph.SENDS), ("dst", graph.RECEIVES)):
            want = {(r["g"], r[end]) for r in edges.collect()}
            assert {(r["g"], r["node"]) for r in nodes.where(mark).collect()} == want
    # The marks tell the ends: edges that do not exist are not read for it.
    assert graph.end_nodes(nodes, None, ["g"], "src", graph.SENDS).count() == 5


def test_joins_lead_with_the_node(spark):
    edges = spark.createDataFrame(ROWS, SCHEMA)
    nodes = neighbors.edge_to_node_aggregate(edges, ["g"], ["f0"]).withColumnRenamed("f0", "h_0")
    text = plan(neighbors.gather(edges.hint("merge"), nodes, ["g"], "dst", ["h_0"], "s"))
    assert "Sort [dst#" in text and "Sort [g#" not in text


def test_attention_does_not_write_its_edges(spark):
    rng = np.random.default_rng(3)
    rows = [("a", f"n{i % 7}", f"n{(i * 3 + 1) % 5}", float(rng.normal())) for i in range(60)]
    edges = spark.createDataFrame(rows, SCHEMA)
    # Nodes without a name or graph have no loop of their own.
    unnamed = [("a", None, 1.0), (None, "n0", 1.0)]
    nodes = spark.createDataFrame([("a", f"n{i}", float(i - 3)) for i in range(7)] + unnamed, "g string, node string, h_0 double")
    # Scores reach over several hundreds, beyond what one shift of the powers holds.
    gat = {"left_w": [[40.0]], "left_b": [0.0], "right_w": [[25.0]], "right_b": [1.0], "edge_w": [[30.0]], "att": [2.0], "bias": [0.5]}
    with temporary_tables() as owner:
        found = neighbors.gatv2_layer(nodes, edges, ["g"], ["f0"], gat, 1, 1)
        got = {r["node"]: r["h_0"] for r in found.collect()}
        assert len(got) == found.count() == 7
        assert all(spark.read.parquet(folder).count() <= 7 for folder in owner.folders)
    mp = [(s, d, f) for _, s, d, f in rows if s != d] + [(d, s, f) for _, s, d, f in rows if s != d]
    h = {f"n{i}": float(i - 3) for i in range(7)}
    for node in h:
        own = [(s, f) for s, d, f in mp if d == node]
        own.append((node, float(np.mean([f for _, f in own])) if own else 0.0))
        z = np.array([40 * h[s] + 25 * h[node] + 1 + 30 * f for s, f in own])
        e = 2 * np.where(z > 0, z, 0.2 * z)
        p = np.exp(e - e.max())
        assert np.isclose(got[node], (p / p.sum() * np.array([40 * h[s] for s, _ in own])).sum() + 0.5)


def test_mean_layer_does_not_group_pairs(spark):
    edges = spark.createDataFrame(ROWS[:5], SCHEMA)
    nodes = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 6.0), ("b", "x", 3.0)], "g string, node string, h_0 double")
    weights = {"left_w": [[1.0]], "left_b": [0.0], "root_w": [[0.0]]}
    found = neighbors.sage_mean_layer(nodes, edges, ["g"], weights, 1)
    assert {(r["g"], r["node"]): r["h_0"] for r in found.collect()} == {("a", "x"): 2.0, ("a", "y"): 3.5, ("a", "z"): 2.0, ("b", "x"): 3.0}
    assert "keys=[src#" not in plan(found)


def test_provenance_meets_once(spark):
    schema = "s string, k string"
    source = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), (None, "4"), ("a", "1")], schema)
    derived = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "9"), (None, "4"), (None, "4")], schema)
    found = repartition.validate_provenance(source, derived, ["s", "k"])
    # A key with a null is never found on the other side: it is lost and added.
    assert tuple(found.first()) == (2, 2, 2)
    assert "Join" not in plan(found)


def test_first_places_are_sorted_by_node(spark):
    rows = spark.createDataFrame([("c", "s", "x", "y", "o1"), ("c", "s", "y", "z", "o0")], "c string, s string, src string, dst string, o string")
    found = repartition.reindex_nodes(rows, "c", "o", "s")
    assert [r["node"] for r in found.orderBy("node_id").collect()] == ["y", "z", "x"]


class Reached(Exception):
    pass


def test_windows_clean_flows_once(spark, tmp_path, monkeypatch):
    rows = [(i, 7, "view", 1.5, '{"k": 1}') for i in range(3)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")

    def look(flows, *args, **kwargs):
        # The sort by arrival samples its input, so that has to be a written table.
        assert all("/tables/" in name for name in flows.inputFiles())
        assert flows.count() == 3
        raise Reached

    monkeypatch.setattr(window_queries.rolling, "rolling_windows", look)
    with pytest.raises(Reached):
        window_queries._score_windows(spark, str(tmp_path))


def test_windows_become_graphs_in_one_move(spark):
    rows = [
        ("a", "w1", 1, "x", "y"), ("a", "w1", 1, "x", "y"), ("a", "w1", 2, "z", "x"), ("a", "w1", 3, "b", "b"), ("a", "w1", 4, None, "x"),
        ("a", "w2", 5, "z", "x"), ("b", "w1", 6, "q", "p"), (None, "w1", 7, "x", "y"), ("b", None, 8, "x", "y"),
    ]
    flows = spark.createDataFrame(rows, "sensor_id string, window_id string, flow_seq int, orig_h string, resp_h string")
    found = detect.window_graph(flows, [], keep=["flow_seq"])
    text = plan(found)
    assert "Join" not in text and "rangepartitioning" not in text and text.count("Exchange hashpartitioning") == 1
    got = sorted((r["sensor_id"], r["window_id"], r["flow_seq"], r["src"], r["dst"]) for r in found.collect())
    # A missing address is named by its sensor alone; rows without a window are in no graph.
    assert got == [
        ("a", "w1", 1, 2, 3), ("a", "w1", 1, 2, 3), ("a", "w1", 2, 4, 2), ("a", "w1", 3, 1, 1), ("a", "w1", 4, 0, 2),
        ("a", "w2", 5, 1, 0), ("b", "w1", 6, 1, 0),
    ]


def test_mean_vectors_equal_means_of_columns(spark):
    rng = np.random.default_rng(5)
    rows = [
        (f"g{i % 3}" if i % 17 else None, f"n{rng.integers(6)}" if i % 11 else None, f"n{rng.integers(4)}",
         float(rng.normal()) if i % 5 else None, float(i), None)
        for i in range(400)
    ]
    edges = spark.createDataFrame(rows, "g string, src string, dst string, a double, b float, c float")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        packed = edges.select("g", "src", "dst", F.array("a", "b", "c").alias("v"))
        got = {(r["g"], r["node"]): r["v"] for r in neighbors.mean_vectors(packed, ["g"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = neighbors.edge_to_node_aggregate(edges, ["g"], ["a", "b", "c"]).collect()
    assert len(want) == len(got)
    for r in want:
        a, b, c = got[(r["g"], r["node"])]
        assert (a is None and r["a"] is None) or np.isclose(a, r["a"])
        assert np.isclose(b, r["b"]) and c is None and r["c"] is None


def test_head_scoring_carries_only_its_result(spark, monkeypatch):
    def look(rows, *args, **kwargs):
        # What reaches Python moves whole, so nothing may come along that the result leaves out.
        assert not {"detailed_label", "src", "dst"} & set(rows.columns)
        raise Reached

    columns = "scenario string, edge_key string, detailed_label string, src string, dst string, "
    rows = spark.createDataFrame([], columns + ", ".join(f"z_{i} double" for i in range(graph_queries.REPR_WIDTH)))
    monkeypatch.setattr(graph_queries, "representation", lambda spark, sf_dir: rows)
    for name, query in (("score_all_heads", graph_queries._all_heads), ("score_clients_table", graph_queries._clients_table)):
        with monkeypatch.context() as patch:
            patch.setattr(neighbors, name, look)
            with pytest.raises(Reached):
                query(spark, "")


def test_wide_heads_of_other_shapes(spark):
    rows = [(0, "a", [1.0, -2.0]), (1, "b", [3.0]), (2, "a", [0.5, 1.0]), (3, "b", [None])]
    found = neighbors.score_clients_wide(
        spark.createDataFrame(rows, "id int, client string, z array<double>"),
        {"a": {"w1": [[1, 0], [0, 1]], "b1": [0, 0], "w2": [[1, 1], [2, 0], [0, 2]], "b2": [0, 0, 0]},
         "b": {"w1": [[2]], "b1": [1], "w2": [[1], [-1]], "b2": [0, 0.5]}}, "client",
    )
    got = {r["id"]: r["probabilities"] for r in found.collect()}
    for place, logits in ((0, [1, 2, 0]), (1, [7, -6.5]), (2, [1.5, 1, 2])):
        powers = np.exp(logits)
        assert np.allclose(got[place], powers / powers.sum())
    assert got[3] == [None, None]


def test_windows_are_found_from_numbers(spark, tmp_path, monkeypatch):
    rows = [(i, 7, "view", 1.5, '{"k": 1}') for i in range(3)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")

    def look(flows, duration, max_flows, stride, lateness, payload, ts):
        # Addresses and features would be sorted and moved at every step.
        assert set(flows.columns) == {"sensor_id", "seq", "arrival", *payload} and len(payload) == 1
        raise Reached

    monkeypatch.setattr(window_queries.rolling, "rolling_windows", look)
    with pytest.raises(Reached):
        window_queries._score_windows(spark, str(tmp_path))


def test_small_graphs_are_represented_where_they_are(spark):
    rng = np.random.default_rng(7)
    rows = [
        (f"g{rng.integers(9)}" if i % 23 else None, f"n{rng.integers(5)}" if i % 19 else None, f"n{rng.integers(4)}", i,
         bool(rng.integers(2)) if i % 7 else None, float(rng.normal()) if i % 5 else None, float(i), None)
        for i in range(300)
    ]
    flows = spark.createDataFrame(rows, "g string, orig_h string, resp_h string, id int, new boolean, a double, b double, c double")
    flows = flows.select("g", "orig_h", "resp_h", "id", "new", F.array("a", "b", "c").alias("v"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edges = graph.build_small_edges(flows, ["g"])
        found = neighbors.represent_small_graphs(edges, ["g"], "v", "new", "n", ["id"])
        assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
        got = {r["id"]: (r["g"], r["n"], r["z"]) for r in found.collect()}
        numbered = edges.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    dictionary = graph.node_dictionary(flows.where("orig_h IS NOT NULL AND g IS NOT NULL"), ["g"])
    want = {r["id"]: (r["src"], r["dst"]) for r in graph.build_edges(flows, dictionary, ["g"]).collect()}
    assert {r["id"]: (r["src"], r["dst"]) for r in numbered} == want
    nodes = neighbors.mean_vectors(spark.createDataFrame(numbered, edges.schema), ["g"], "v").withColumnRenamed("v", "h_0")
    sizes = spark.createDataFrame(numbered, edges.schema).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wide = neighbors.edge_representation(
        spark.createDataFrame(numbered, edges.schema).where("new").join(sizes, "g"), nodes, ["g"], ["v"], 1, ["id", "n"], by_end=False
    )
    rest = {r["id"]: (r["g"], r["n"], [*r["z_0"], *r["z_1"], *r["z_2"]]) for r in wide.collect()}
    assert set(got) == set(rest) and len(got) > 80
    for key, (g, n, z) in rest.items():
        assert got[key][:2] == (g, n)
        assert [x is None for x in got[key][2]] == [x is None for x in z]
        assert np.allclose([x for x in got[key][2] if x is not None], [x for x in z if x is not None])


def test_edges_meet_many_nodes_unsorted(spark):
    edges = spark.createDataFrame(ROWS, SCHEMA)
    nodes = neighbors.marked_aggregate(edges, ["g"], ["f0"]).withColumnRenamed("f0", "h_0")
    before, want = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), None
    try:
        for limit, join in ((before, "BroadcastHashJoin"), ("1b", "ShuffledHashJoin"), ("-1", "ShuffledHashJoin")):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            found = neighbors.edge_representation(edges, nodes, ["g"], ["f0"], 1)
            text = plan(found)
            assert text.count(join) == 2 and "Sort" not in text
            got = sorted(map(tuple, found.collect()))
            want = want or got
            assert got == want and len(got) == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_stay_where_a_table_of_heads_is_small(spark, monkeypatch):
    rows = [(i, f"c{i % 3}", [float(i), 1.0] if i % 4 else [None, 2.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, client string, z array<double>")
    heads = {f"c{k}": {"w1": [[1, k], [k, 1]], "b1": [0, k], "w2": [[1, 1], [2, 0], [0, k]], "b2": [0, k, 0]} for k in range(3)}
    table = neighbors.head_table(spark, heads)
    small = neighbors.score_clients_table(frame, table, "client")
    assert "Exchange" not in plan(small)
    monkeypatch.setattr(neighbors, "TABLE_NUMBERS", 29)
    large = neighbors.score_clients_table(frame, table, "client")
    assert "Exchange" in plan(large)
    assert repr(sorted(map(tuple, small.collect()))) == repr(sorted(map(tuple, large.collect())))
    with pytest.raises(Exception, match="no head for client"):
        monkeypatch.undo()
        neighbors.score_clients_table(frame, table.where("head <> 'c1'"), "client").collect()
