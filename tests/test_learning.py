"""Splits, graphs, layers, averaging, metrics and balance on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgraph_spark.functions import ordering
from flowgraph_spark.operators import balance, features, graph, metrics, neighbors, params, repartition, runs, sampling, splitting


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}


def test_split_rule(spark):
    rows = [(i, 0) for i in range(10)] + [(10 + i, 1) for i in range(7)] + [(17, 2)]
    df = spark.createDataFrame(rows, "id long, label long")
    split = splitting.split_per_class(df, ["label"], "id")
    assert counts(split, "label", "split") == {
        (0, "train"): 7, (0, "validation"): 1, (0, "test"): 2,
        (1, "train"): 4, (1, "validation"): 1, (1, "test"): 2, (2, "train"): 1,
    }
    again = splitting.split_per_class(df.repartition(7), ["label"], "id")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))


def test_undersample_and_weights(spark):
    labels = ["DDoS"] * 10 + ["C&C"] * 5 + ["Benign"] * 3 + ["scan"] * 2
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "id long, detailed_label string")
    kept = sampling.undersample(df, "id", 1)
    assert counts(kept, "detailed_label") == {("DDoS",): 5, ("C&C",): 5, ("Benign",): 3, ("scan",): 2}
    weights = {r["detailed_label"]: r["weight"] for r in sampling.class_weights(df).collect()}
    assert weights == pytest.approx({"DDoS": 0.5, "C&C": 1.0, "Benign": 5 / 3, "scan": 2.5})


@pytest.mark.parametrize("ranges", ["1", "3", "40"])
def test_ranks_do_not_depend_on_ranges(spark, ranges):
    """One group holds 98 % of the rows, another has no key; ranks equal the plain window."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        group = F.when(F.col("id") % 50 == 0, F.when(F.col("id") % 100 == 0, "cold")).otherwise("hot")
        df = spark.range(5000).select("id", group.alias("g"), F.sha2(F.concat(F.lit("3:"), "id"), 256).alias("h"))
        got = ordering.rank_in_groups(df, ["g"], ["h"], total="n")
        plain = df.withColumn("want", F.expr("row_number() over (partition by g order by h)"))
        joined = got.join(plain.select("id", "want"), "id")
        assert joined.count() == 5000 and joined.where("rank <> want").count() == 0
        assert {(r.g, r.n) for r in got.collect()} == {("hot", 4900), ("cold", 50), (None, 50)}
        assert ordering.rank_in_groups(df, ["g"], ["h"], limit=70).count() == 170
        cuts = lambda n: [F.lit(0), F.floor(n * 0.3), n - 1, n]
        cut = ordering.hash_segments(df, ["g"], ordering.hash_order(3, "id"), cuts, total="n")
        wrong = cut.join(plain.select("id", "want"), "id").where(
            "segment <> 1 + int(want > floor(n * 0.3)) + int(want > n - 1)"
        )
        assert cut.count() == 5000 and wrong.count() == 0
        # Buckets counted by further bits, down to a hash each, give the same cut.
        fine = ordering.hash_segments(df, ["g"], ordering.hash_order(3, "id"), cuts, near_limit=0)
        assert fine.exceptAll(cut.drop("n")).count() == 0
        sums = ordering.running_sums(df, ["g"], ["h"], {"s": F.col("id")})
        assert sums.exceptAll(
            plain.selectExpr("id", "g", "h", "sum(id) over (partition by g order by h) s", "sum(id) over (partition by g) s_total")
        ).count() == 0
        high = ordering.running_max(df, ["g"], ["h"], F.col("id"), "m", exclusive=True)
        windowed = "max(id) over (partition by g order by h rows between unbounded preceding and 1 preceding) m"
        assert high.exceptAll(plain.selectExpr("id", "g", "h", windowed)).count() == 0
        lag = ordering.previous_value(df, ["g"], ["h"], F.col("id"), "p")
        assert lag.exceptAll(plain.selectExpr("id", "g", "h", "lag(id) over (partition by g order by h) p")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_identities_share_a_segment(spark):
    """Equal hashes cannot be told apart: all rows of an identity are on one side."""
    df = spark.range(300).select((F.col("id") % 3).alias("same"), F.lit("g").alias("g"))
    cut = ordering.hash_segments(df, ["g"], ordering.hash_order(1, "same"), lambda n: [F.lit(1), F.lit(150)], near_limit=1)
    per_id = cut.groupBy("same").agg(F.collect_set("segment").alias("s")).collect()
    assert sorted(tuple(r["s"]) for r in per_id) == [(0,), (1,), (2,)]
    assert ordering.hash_segments(df.limit(0), ["g"], ordering.hash_order(1, "same"), lambda n: [n - 1]).count() == 0


def test_rows_without_label_are_a_class_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a") for i in range(30)], "id long, label string")
    split = splitting.split_per_class(df, ["label"], "id")
    assert counts(split, "label", "split") == {
        (None, "train"): 7, (None, "validation"): 1, (None, "test"): 2,
        ("a", "train"): 14, ("a", "validation"): 2, ("a", "test"): 4,
    }
    cut = splitting.train_validation_split(df, "label", "id", 0.2)
    assert counts(cut, "label", "split") == {
        (None, "train"): 8, (None, "validation"): 2, ("a", "train"): 16, ("a", "validation"): 4,
    }
    assert counts(sampling.sample_bottom_k(df, ["label"], "id", 4, 1), "label") == {(None,): 4, ("a",): 4}
    assert counts(sampling.cap_first_come(df, ["label"], "id", 3), "label") == {(None,): 3, ("a",): 3}
    assert counts(sampling.undersample(df, "id", 1, "label"), "label") == {(None,): 10, ("a",): 10}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=999), np.zeros(500)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    row = metrics.describe(df, ["g"], "v").first()
    for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        assert row[name] == pytest.approx(np.quantile(values, q))
    assert row["std"] == pytest.approx(values.std())
    near = metrics.numeric_summary(df, ["g"], "v").first()
    assert near["p95"] == sorted(values)[round((len(values) - 1) * 0.95)]


def test_iid_repartition(spark):
    rows = []
    for source in range(3):
        for label in range(8):
            rows += [(f"c{source}", f"{source}-{label}-{i}", label, "train") for i in range(4)]
    df = spark.createDataFrame(rows, "scenario string, edge string, label_idx int, split string")
    kept = repartition.drop_and_remap_class(df, 6)
    assert sorted(r[0] for r in kept.select("label_idx").distinct().collect()) == list(range(7))
    dealt = repartition.repartition_iid(kept, ["c0", "c1", "c2"], "edge", 5)
    assert dealt.count() == 84 and set(counts(dealt, "destination", "label_idx").values()) == {4}
    problems = repartition.validate_provenance(kept, dealt, ["scenario", "edge"]).first()
    assert tuple(problems) == (0, 0, 0)
    other = repartition.repartition_iid(kept, ["c0", "c1", "c2"], "edge", 6)
    assert repartition.provenance_digest(dealt, "scenario", "edge", "destination").first() != (
        repartition.provenance_digest(other, "scenario", "edge", "destination").first()
    )
    with pytest.raises(Exception, match="fewer rows"):
        repartition.repartition_iid(kept.limit(1), ["c0", "c1"], "edge", 5).collect()


def test_reindex_keeps_sources_apart(spark):
    rows = [("d", "a", 0, 1, 2), ("d", "b", 1, 1, 2)]
    df = spark.createDataFrame(rows, "client string, scenario string, pos long, src long, dst long")
    nodes = repartition.reindex_nodes(df, "client", "pos")
    got = {(r["scenario"], r["node"]): r["node_id"] for r in nodes.collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("b", 1): 2, ("b", 2): 3}


EDGES = [("g", ".1", ".2", 1.0, 10.0, "Benign"), ("g", ".1", ".3", 2.0, 20.0, "DDoS"),
         ("g", ".2", ".3", 3.0, 30.0, "C&C"), ("g", ".3", ".4", 4.0, 40.0, "DDoS")]


def edge_frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, "scenario string, orig_h string, resp_h string, a double, b double, detailed_label string")


def test_graph_build(spark):
    df = edge_frame(spark)
    nodes = graph.node_dictionary(df, ["scenario"])
    assert {r["node"]: r["node_id"] for r in nodes.collect()} == {".1": 0, ".2": 1, ".3": 2, ".4": 3}
    edges = graph.build_edges(df, nodes, ["scenario"])
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    assert graph.bidirect(edges).count() == 8


def test_components_on_chain_and_star(spark):
    chain = [("chain", f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)]
    star = [("star", "hub", f"x{i}") for i in range(300)] + [("star", "p", "q"), ("star", "z", "z")]
    df = spark.createDataFrame(chain + star, "scenario string, orig_h string, resp_h string")
    stats = graph.component_stats(graph.weak_components(df, ["scenario"]), ["scenario"])
    assert {tuple(r) for r in stats.collect()} == {("chain", 1, 201), ("star", 3, 301)}


def test_topology(spark):
    rows = [("g", "0", "1", 1.0, 0.0, "x"), ("g", "1", "2", 1.0, 0.0, "x"), ("g", "2", "0", 1.0, 0.0, "x"), ("g", "0", "2", 1.0, float("nan"), "x")]
    row = graph.topology(edge_frame(spark, rows), ["scenario"], ["a", "b"]).first()
    assert row["unique_pairs"] == 4 and row["parallel_edges"] == 0 and row["nonfinite_values"] == 1
    assert row["mean_degree"] == pytest.approx(8 / 3) and row["pair_density"] == pytest.approx(4 / 6)


def dense(x, w, b):
    return x @ np.asarray(w, float).T + np.asarray(b, float)


def small_graph(seed=0, n=5, e=14):
    rng = np.random.default_rng(seed)
    src, dst = rng.integers(0, n, e), rng.integers(0, n, e)
    src[:n], dst[:n] = np.arange(n), (np.arange(n) + 1) % n
    return src, dst, rng.normal(size=(e, 2)), rng.normal(size=(n, 3))


def frames(spark, src, dst, attrs, x):
    edges = spark.createDataFrame(
        [("g", int(s), int(d), float(a[0]), float(a[1])) for s, d, a in zip(src, dst, attrs)],
        "g string, src long, dst long, f0 double, f1 double",
    )
    nodes = spark.createDataFrame([("g", i, *map(float, row)) for i, row in enumerate(x)], "g string, node long, h_0 double, h_1 double, h_2 double")
    return edges, nodes


def vectors(df, width):
    rows = sorted(df.collect(), key=lambda r: r["node"])
    return np.array([[r[f"h_{i}"] for i in range(width)] for r in rows])


@pytest.mark.parametrize("salt", [1, 3])
def test_layers_match_numpy(spark, salt):
    src, dst, attrs, x = small_graph()
    edges, nodes = frames(spark, src, dst, attrs, x)
    s, d, a = np.r_[src, dst], np.r_[dst, src], np.r_[attrs, attrs]
    n = len(x)
    rng = np.random.default_rng(3)
    w = lambda r, c: rng.normal(size=(r, c)).tolist()
    v = lambda r: rng.normal(size=r).tolist()

    sage = {"msg_w": w(2, 5), "msg_b": v(2), "upd_w": w(2, 5), "upd_b": v(2)}
    msg = np.maximum(dense(np.c_[x[s], a], sage["msg_w"], sage["msg_b"]), 0)
    mean = np.array([msg[d == i].mean(axis=0) for i in range(n)])
    want = np.maximum(dense(np.c_[x, mean], sage["upd_w"], sage["upd_b"]), 0)
    got = neighbors.edge_sage_layer(nodes, edges, ["g"], ["f0", "f1"], sage, 3, salt=salt)
    assert np.allclose(vectors(got, 2), want)

    ones = {"msg_w": w(2, 3), "msg_b": v(2), "upd_w": w(2, 3), "upd_b": v(2)}
    constant = neighbors.constant_nodes(edges, ["g"])
    joined = neighbors.edge_sage_layer(constant, edges, ["g"], ["f0", "f1"], ones, 1, salt=salt)
    free = neighbors.edge_sage_layer(None, edges, ["g"], ["f0", "f1"], ones, 1)
    assert np.allclose(vectors(joined, 2), vectors(free, 2))

    plain = {"left_w": w(2, 3), "left_b": v(2), "root_w": w(2, 3)}
    neigh = np.array([x[s[d == i]].mean(axis=0) for i in range(n)])
    want = dense(neigh, plain["left_w"], plain["left_b"]) + dense(x, plain["root_w"], [0, 0])
    got = neighbors.sage_mean_layer(nodes, edges, ["g"], plain, 3, salt=salt)
    assert np.allclose(vectors(got, 2), want)

    gcn = {"w": w(2, 3), "b": v(2)}
    keep = s != d
    adj = np.eye(n)
    np.add.at(adj, (d[keep], s[keep]), 1)
    deg = adj.sum(axis=1)
    want = dense((adj / np.sqrt(deg)[:, None] / np.sqrt(deg)[None, :]) @ x, gcn["w"], gcn["b"])
    got = neighbors.gcn_layer(nodes, edges, ["g"], gcn, 3, salt=salt)
    assert np.allclose(vectors(got, 2), want)

    for concat in (True, False):
        heads, size = 2, 2
        gat = {"left_w": w(4, 3), "left_b": v(4), "right_w": w(4, 3), "right_b": v(4), "edge_w": w(4, 2),
               "att": v(4), "bias": v(4 if concat else 2)}
        ss, dd, aa = s[keep], d[keep], a[keep]
        loop = np.array([aa[dd == i].mean(axis=0) for i in range(n)])
        ss, dd, aa = np.r_[ss, np.arange(n)], np.r_[dd, np.arange(n)], np.r_[aa, loop]
        left, right = dense(x, gat["left_w"], gat["left_b"]), dense(x, gat["right_w"], gat["right_b"])
        z = left[ss] + right[dd] + dense(aa, gat["edge_w"], [0] * 4)
        z = np.where(z > 0, z, 0.2 * z) * np.array(gat["att"])
        score = z.reshape(-1, heads, size).sum(axis=2)
        want = np.zeros((n, heads, size))
        for i in range(n):
            rows = dd == i
            p = np.exp(score[rows] - score[rows].max(axis=0))
            p /= p.sum(axis=0)
            want[i] = (p[:, :, None] * left[ss[rows]].reshape(-1, heads, size)).sum(axis=0)
        want = want.reshape(n, 4) if concat else want.mean(axis=1)
        want = want + np.array(gat["bias"])
        got = neighbors.gatv2_layer(nodes, edges, ["g"], ["f0", "f1"], gat, 3, heads, concat, salt=salt)
        assert np.allclose(vectors(got, 4 if concat else 2), want)


def test_heads_agree(spark):
    src, dst, attrs, x = small_graph(4)
    edges, nodes = frames(spark, src, dst, attrs, x)
    rng = np.random.default_rng(5)
    heads = {
        c: {"w1": rng.normal(size=(4, 8)).tolist(), "b1": rng.normal(size=4).tolist(),
            "w2": rng.normal(size=(3, 4)).tolist(), "b2": rng.normal(size=3).tolist()}
        for c in ("g", "h")
    }
    keyed = edges.withColumn("key", F.monotonically_increasing_id())
    rep = neighbors.edge_representation(keyed, nodes, ["g"], ["f0", "f1"], 3, keep=["key"])
    one = {r["key"]: r for r in neighbors.score_edges(rep, heads["g"], 8).collect()}
    own = {r["key"]: r for r in neighbors.score_own_head(rep, heads, 8, "g").collect()}
    every = {r["key"]: r for r in neighbors.score_all_heads(rep, heads, 8).where("head = 'g'").collect()}
    wide = rep.select("key", F.array(*[f"z_{i}" for i in range(8)]).alias("z"))
    numpy_way = {r["key"]: r for r in neighbors.score_edges_wide(wide, heads["g"]).collect()}
    for key, row in one.items():
        assert sum(row["probabilities"]) == pytest.approx(1.0)
        for other in (own, every, numpy_way):
            assert other[key]["probabilities"] == pytest.approx(row["probabilities"])
            assert other[key]["pred_idx"] == row["pred_idx"]


def test_500_clients_score_by_their_own_heads(spark):
    rng = np.random.default_rng(8)
    heads = {
        f"c{i}": {"w1": rng.normal(size=(3, 5)).tolist(), "b1": rng.normal(size=3).tolist(),
                  "w2": rng.normal(size=(4, 3)).tolist(), "b2": rng.normal(size=4).tolist()}
        for i in range(500)
    }
    # One client has a third of all rows.
    data = [(i, f"c{0 if i % 3 == 0 else i % 500}", [float(v) for v in rng.normal(size=5)]) for i in range(3000)]
    rows = spark.createDataFrame(data, "id long, client string, z array<double>")
    broadcast = {r["id"]: r for r in neighbors.score_clients_wide(rows, heads, "client").collect()}
    table = {r["id"]: r for r in neighbors.score_clients_table(rows, neighbors.head_table(spark, heads), "client").collect()}
    assert len(table) == len(broadcast) == 3000
    for i, client, z in data:
        head = {k: np.array(v) for k, v in heads[client].items()}
        logits = head["w2"] @ np.maximum(head["w1"] @ z + head["b1"], 0) + head["b2"]
        want = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert np.allclose(table[i]["probabilities"], want) and np.allclose(broadcast[i]["probabilities"], want)
    wide = rows.limit(20).select("id", *[F.col("z")[k].alias(f"z_{k}") for k in range(5)])
    every = neighbors.score_all_heads(wide, heads, 5)
    assert every.count() == 10_000 and every.select("head").distinct().count() == 500
    lost = neighbors.head_table(spark, {k: v for k, v in heads.items() if k != "c7"})
    with pytest.raises(Exception, match="no head for client c7"):
        neighbors.score_clients_table(rows, lost, "client").collect()
    one = {"a": {"w1": np.zeros((1, 40_000_000)), "b1": [0.0], "w2": [[0.0]], "b2": [0.0]}}
    with pytest.raises(ValueError, match="score_clients_table"):
        neighbors.head_arrays(one)


def test_hub_rows_can_be_split(spark):
    """The aggregate of a hub is a table of its own, so both joins shuffle for themselves."""
    edges = spark.range(600).selectExpr(
        "'g' as g", "case when id % 3 > 0 then 0 else id end as src", "id + 1000 as dst", "double(id) as f0", "id"
    )
    rows = neighbors.edge_classifier_rows(edges, ["g"], ["f0"], keep=["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("FileScan parquet") == 2
    found = {r["id"]: (r["s_f0"], r["t_f0"]) for r in rows.collect()}
    # Edges of the hub: two thirds, and the edge of row 0.
    hub = np.mean([i for i in range(600) if i % 3 or i == 0])
    assert len(found) == 600 and found[1] == (pytest.approx(hub), 1.0) and found[3] == (3.0, 3.0)


def test_rows_without_value_are_not_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    with pytest.raises(Exception, match="without a value"):
        metrics.numeric_summary(df, [], "v").collect()
    with pytest.raises(Exception, match="without a value"):
        metrics.describe(df.withColumn("g", F.lit(1)), ["g"], "v").collect()
    assert metrics.numeric_summary(df.where("v is not null"), [], "v").first()["mean"] == 2.0


def test_label_counts_of_graphs(spark):
    rows = [("g", "a", "b", "DDoS"), ("g", "a", "b", "Benign"), ("g", "b", "c", "DDoS"), ("h", "x", "x", None)]
    df = spark.createDataFrame(rows, "g string, orig_h string, resp_h string, detailed_label string")
    found = {r["g"]: r for r in graph.graph_stats(df, ["g"], ["f"], 2).collect()}
    assert found["g"]["label_counts"] == {"Benign": 1, "DDoS": 2} and found["g"]["malicious_edges"] == 2
    assert found["h"]["label_counts"] == {"null": 1} and found["h"]["num_edges"] == 1 and found["h"]["num_edges_mp"] == 2


def test_support_of_many_classes(spark):
    df = spark.range(50).selectExpr("int(id % 5) as true_idx")
    train = spark.createDataFrame([(0,), (0,), (3,)], "true_idx int")
    for limit in (1, 10_000):
        found = metrics.with_train_support(df, train, max_classes=limit).distinct().collect()
        assert {(r["true_idx"], r["train_support"], r["absent"]) for r in found} == {
            (0, 2, False), (1, 0, True), (2, 0, True), (3, 1, False), (4, 0, True)
        }


def test_shared_parameters_reach_every_client(spark):
    shared = spark.createDataFrame([("enc", 0, None, 1.5), ("enc", 1, None, 2.5)], "param string, pos int, row int, value double")
    private = spark.createDataFrame([(f"c{i}", "head", 0, 0, float(i)) for i in range(300)], "client string, param string, pos int, row int, value double")
    merged = params.merge_personalised(shared, private)
    assert merged.count() == 900 and merged.where("param = 'enc'").groupBy("client").count().where("count = 2").count() == 300
    both = shared.unionByName(private.limit(1).drop("client"))
    with pytest.raises(Exception, match="shared and private"):
        params.merge_personalised(both, private).collect()


def state(spark, rows):
    return spark.createDataFrame(rows, "client string, param string, pos int, row int, value double")


def test_weighted_average(spark):
    p = state(spark, [("a", "w", 0, None, 1.0), ("a", "w", 1, None, 3.0), ("b", "w", 0, None, 5.0), ("b", "w", 1, None, 7.0)])
    n = spark.createDataFrame([("a", 1), ("b", 3)], "client string, num_examples long")
    assert [r["value"] for r in params.weighted_average(p, n).orderBy("pos").collect()] == [4.0, 6.0]
    bad = p.withColumn("value", F.lit(float("nan")))
    with pytest.raises(Exception, match="not finite"):
        params.weighted_average(bad, n).collect()
    with pytest.raises(Exception, match="differs"):
        params.weighted_average(p, n, exact=["w"]).collect()


def test_class_balanced(spark):
    s = spark.createDataFrame([("a", 0, 90), ("a", 1, 0), ("b", 0, 10), ("b", 1, 100)], "client string, class_idx int, support long")
    weights = {r["client"]: r["weight"] for r in params.class_balanced_client_weights(s).collect()}
    assert weights == pytest.approx({"a": 0.45, "b": 0.55})
    p = state(spark, [("a", "w", 0, None, 0.0), ("b", "w", 0, None, 10.0)])
    assert params.class_balanced_average(p, s).first()["value"] == pytest.approx(5.5)
    empty = spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "client string, class_idx int, support long")
    with pytest.raises(Exception, match="no support"):
        params.class_balanced_client_weights(empty).collect()


def test_support_head(spark):
    s = spark.createDataFrame([("a", 0, 10), ("a", 1, 0), ("b", 0, 0), ("b", 1, 10)], "client string, class_idx int, support long")
    n = spark.createDataFrame([("a", 1), ("b", 3)], "client string, num_examples long")
    rows = [("a", "t", 0, None, 2.0), ("b", "t", 0, None, 6.0)]
    for c, values in (("a", (10.0, 20.0, 1.0, 2.0)), ("b", (30.0, 40.0, 3.0, 4.0))):
        rows += [(c, "head.weight", i, i, values[i]) for i in range(2)] + [(c, "head.bias", i, i, values[2 + i]) for i in range(2)]
    got = {(r["param"], r["pos"]): r["value"] for r in params.class_support_head_average(state(spark, rows), n, s).collect()}
    assert got == {("t", 0): 5.0, ("head.weight", 0): 10.0, ("head.weight", 1): 40.0, ("head.bias", 0): 1.0, ("head.bias", 1): 4.0}


def test_confusion_merge(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("b", 0, 0), ("b", 1, 0), ("b", 1, 1), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "client string, true_idx int, pred_idx int")
    merged = metrics.merge_confusions(metrics.confusion(df, 2, ["client"]))
    cells = {(r["true_idx"], r["pred_idx"]): r["n"] for r in merged.collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 3}
    with pytest.raises(Exception, match="outside"):
        metrics.confusion(df.withColumn("pred_idx", F.lit(2)), 2).collect()


def test_macro_f1_rules(spark):
    four = spark.createDataFrame([(0, 0)] * 4, "true_idx int, pred_idx int")
    row = metrics.classification_metrics(four, 2).first()
    assert row["accuracy"] == 1.0 and row["macro_f1"] == 0.5
    df = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "true_idx int, pred_idx int")
    binary = metrics.binary_metrics(df, 0).first()
    assert binary["accuracy"] == pytest.approx(1 / 3) and binary["malicious_f1"] == pytest.approx(0.5)
    truth = spark.createDataFrame([(0, 0), (2, 2), (5, 0)], "true_idx int, pred_idx int")
    support = spark.createDataFrame([(0, 4), (2, 3), (3, 9)], "class_idx int, train_support long")
    seen = metrics.seen_class_macro_f1(metrics.confusion(truth, 8), support).first()[0]
    assert seen == pytest.approx((2 / 3 + 1) / 2)


def test_auroc_pairwise(spark):
    rng = np.random.default_rng(2)
    scores, labels = rng.integers(0, 20, 400) / 10, rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(scores, labels)], "s double, t int")
    row = metrics.ranking_scores(df, [], "s", "t").first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert row["auroc"] == pytest.approx(want)
    one = metrics.ranking_scores(df.where("t = 1"), [], "s", "t").first()
    assert one["auroc"] is None


def test_entropy_groups(spark):
    uniform, sure = [0.125] * 8, [1.0] + [0.0] * 7
    rows = [(0, 0, sure, False), (0, 1, sure, False), (4, 0, uniform, True)]
    df = spark.createDataFrame(rows, "true_idx int, pred_idx int, probabilities array<double>, absent boolean")
    scored = metrics.probabilities_and_entropy(df)
    groups = {r["group"]: r for r in metrics.entropy_groups(scored, five=False).collect()}
    assert groups["absent_from_train"]["mean"] == pytest.approx(math.log(8)) and len(groups) == 3
    found = {r["comparison"]: r for r in metrics.entropy_detection(scored).collect()}
    assert found["absent_from_train vs known_correct"]["auroc"] == 1.0
    bad = metrics.probabilities_and_entropy(df.withColumn("probabilities", F.array(F.lit(0.4), F.lit(0.4))))
    assert bad.where("score_error is null").count() == 0


def test_threshold_tradeoff(spark):
    rows = list(zip((0, 0, 1, 2), (0, 1, 1, 0), (0.99, 0.8, 0.9, 0.95)))
    df = spark.createDataFrame(rows, "true_idx int, pred_idx int, confidence double")
    got = metrics.threshold_tradeoff(df, (0.0, 0.85), 0).orderBy("confidence_threshold").collect()
    assert [r["benign_false_alert_rate"] for r in got] == [0.5, 0.0]
    assert [r["malicious_alert_recall"] for r in got] == [0.5, 0.5]
    assert [r["correct_class_alert_recall"] for r in got] == [0.5, 0.5]


def test_select_candidate(spark):
    rows = [(0.9, 5.0, 50, 30.0), (0.9, 4.0, 50, 15.0), (0.8, 1.0, 50, 5.0)]
    df = spark.createDataFrame(rows, "macro_f1 double, latency_p95 double, max_flows int, duration double")
    best = runs.select_candidate(df.withColumn("stride", F.lit(1)).withColumn("lateness", F.lit(1.0))).first()
    assert best["graph_protocol"] == "rolling-window-v1:duration=15s:max-flows=50:stride=1:lateness=1s"


def test_compare_runs_refuses(spark):
    doc = '{"run_id":"r","status":"running","config_digest":"c","dataset_digest":"d","model_digest":"m","summary":{}}'
    with pytest.raises(Exception, match="not completed"):
        runs.compare_runs(spark.createDataFrame([(doc,)], "value string")).collect()


def test_prediction_audit(spark):
    df = spark.createDataFrame([(1, "p", True)], "seed int, protocol string, true_class_absent_from_train boolean")
    audit = {r["field"]: r["status"] for r in runs.prediction_audit(df, False, ("a",)).collect()}
    assert audit["seed"] == "EXPORTED" and audit["split"] == "NOT_AVAILABLE"
    assert audit["class_present_in_train"] == "DERIVED_FROM_EXPORTED_ABSENCE_FLAG"
    filled = {r["field"]: r["filled"] for r in runs.prediction_audit(df.union(df.selectExpr("null", "'q'", "true")), False, ("a",)).collect()}
    assert filled["seed"] == 1 and filled["protocol"] == 2 and filled["split"] is None
    nothing = runs.prediction_audit(df.select("true_class_absent_from_train"), False, ("a",))
    assert nothing.where("filled is not null").count() == 0


def test_balance_scopes(spark):
    rows = [("c1", "train", "benign"), ("c1", "train", "attack"), ("c1", "validation", "benign"), ("c1", "test", "attack")]
    df = spark.createDataFrame(rows, "scenario string, split string, detailed_label string")
    scoped = balance.scoped_counts(df, ("attack", "benign"))
    support = balance.class_support_by_client(scoped)
    assert support.count() == 16
    cell = support.where("scope = 'global' and split = 'validation' and detailed_label = 'attack'").first()
    assert cell["support"] == 0 and cell["global_support"] == 2 and cell["private_class"]
    summary = {r["scope"]: r for r in balance.balance_summary(scoped, 2).collect()}
    assert summary["global"]["entropy_bits"] == pytest.approx(1.0)
    assert summary["c1"]["js_from_union_bits"] == pytest.approx(0.0)


def test_categories_without_a_limit(spark):
    """2,000 addresses: refused as columns, one place each in a sparse vector."""
    flows = spark.range(3000).select(
        "id", F.concat(F.lit("h"), F.col("id") % 2000).alias("orig_h"), F.when(F.col("id") % 3 == 0, "tcp").alias("proto"),
        F.lit("x").alias("__kept"), F.lit(80).alias("resp_p"), F.lit(1).alias("orig_p"), F.lit("S").alias("history"),
        F.lit("http").alias("service"), *[F.lit(0.0).alias(c) for c in features.SCALED_COLUMNS],
    )
    fit = features.FittedFeatures((), (), (), (), ())
    with pytest.raises(ValueError, match="transform_sparse"):
        features.fit_features(flows.withColumn("conn_state", F.col("orig_h")))
    index = features.category_index(flows.where("id < 1500"), ["proto", "orig_h"])
    assert index.count() == 1501 and index.agg(F.max("position")).first()[0] == 1500
    rows = {r["id"]: r for r in features.transform_sparse(flows, fit, index, ["proto", "orig_h"], keep=["id", "__kept"]).collect()}
    assert len(rows) == 3000
    base, names = len(fit.columns), sorted({f"h{i}" for i in range(1500)})
    for i in (0, 1, 3, 1499, 1500, 1999, 2000, 2999):
        cells = dict(zip(rows[i]["features"]["indices"], rows[i]["features"]["values"]))
        want = {base} if i % 3 == 0 else set()
        want |= {base + 1 + names.index(f"h{i % 2000}")} if i % 2000 < 1500 else set()
        assert {k for k in cells if k >= base} == want and rows[i]["features"]["size"] == base + 1501
        assert list(cells) == sorted(cells) and 0.0 not in cells.values()


def test_few_sources_do_not_move_the_edges(spark):
    """Edges meet their few sources without a shuffle, however many nodes there are; ids and vectors stay."""
    rows = spark.range(60000).selectExpr(
        "'g' scenario", "concat('s', id % 7) orig_h", "concat('long-name-of-a-target-', id) resp_h", "double(id) f"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        nodes = graph.node_dictionary(rows, ["scenario"])
        ids = {r["node"]: r["node_id"] for r in nodes.collect()}
        edges = graph.build_edges(rows, nodes, ["scenario"])
        assert all((r["src"], r["dst"]) == (ids[r["orig_h"]], ids[r["resp_h"]]) for r in edges.collect())
        vectors = nodes.selectExpr("scenario", "node", "double(node_id) h_0")
        links = rows.withColumnsRenamed({"orig_h": "src", "resp_h": "dst"})
        both = neighbors.edge_representation(links, vectors, ["scenario"], ["f"], 1)
        assert all((r["z_0"], r["z_1"]) == (ids[r["src"]], ids[r["dst"]]) for r in both.collect())
        for found in (edges, both):
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            sizes = found._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("Join Inner") == 2 and sizes.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
