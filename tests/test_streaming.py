"""Rolling windows: fixtures, brute force, batch against stream, detection stream."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgraph_spark.operators import cleaning, features
from flowgraph_spark.session import checkpoint_dir, cut_lineage, temporary_tables
from flowgraph_spark.streaming import alerts, detect, rolling, rolling_stream

FLOWS = "sensor_id string, seq long, ts double, uid string"


def arrivals(spark, times, names=None):
    names = names or [f"f{i}" for i in range(len(times))]
    rows = [("s", i + 1, float(t), n) for i, (t, n) in enumerate(zip(times, names))]
    return spark.createDataFrame(rows, FLOWS)


def windows_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r["sensor_id"], r["window_id"]), []).append(
            (r["position"], r["flow_seq"], r["is_new"], r["start_ts"], r["end_ts"])
        )
    return {k: sorted(v) for k, v in found.items()}


def brute_force(rows, duration, limit, stride, lateness):
    """Plain definition: after every arrival, filter and keep the newest flows."""
    out, counters = {}, {}
    for sensor in sorted({r[0] for r in rows}):
        seen, accepted, pending, number = None, [], [], 0
        late = evicted = 0
        buffer = []

        def emit():
            nonlocal number, pending
            number += 1
            fresh, pending = set(pending), []
            out[(sensor, f"{sensor}-window-{number:08d}")] = [
                (i, q, q in fresh, buffer[0][0], seen) for i, (_, q) in enumerate(buffer)
            ]

        for _, seq, ts in sorted((r for r in rows if r[0] == sensor), key=lambda r: r[1]):
            if seen is not None and ts < seen - lateness:
                late += 1
                continue
            seen = ts if seen is None else max(seen, ts)
            accepted.append((ts, seq))
            pending.append(seq)
            live = sorted(f for f in [*buffer, (ts, seq)] if f[0] >= seen - duration)
            evicted += max(0, len(live) - limit)
            buffer = live[-limit:]
            if len(accepted) % stride == 0:
                emit()
        if pending and buffer:
            emit()
        counters[sensor] = (len(accepted), late, evicted)
    return out, counters


def test_order_and_late(spark):
    df = arrivals(spark, [10, 9, 7], ["a", "b", "late"])
    got = windows_of(rolling.rolling_windows(df, 10, 3, 2, 2))
    assert [(p, q, n) for p, q, n, *_ in got[("s", "s-window-00000001")]] == [(0, 2, True), (1, 1, True)]
    counters = rolling.window_counters(df, 10, 3, 2).first()
    assert (counters["accepted"], counters["late_dropped"]) == (2, 1)


def test_flush_and_eviction(spark):
    df = arrivals(spark, [1, 2, 3])
    snaps = {r["window_id"]: r for r in rolling.snapshots(rolling.rolling_windows(df, 60, 2, 2, 0), []).collect()}
    assert snaps["s-window-00000001"]["emission_indices"] == [0, 1]
    tail = snaps["s-window-00000002"]
    assert [f["flow_seq"] for f in tail["flows"]] == [2, 3] and tail["emission_indices"] == [1]
    counters = rolling.window_counters(df, 60, 2, 0).first()
    assert counters["flow_drop_rate"] == 0.0 and counters["capacity_evictions"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    duration, limit = int(rng.integers(2, 12)), int(rng.integers(1, 7))
    stride, lateness = int(rng.integers(1, 4)), int(rng.integers(0, 15))
    rows = []
    for sensor, size in (("hot", 120), ("cold", 9)):
        times = np.round(np.arange(size) / 2 + rng.integers(-6, 6, size))
        rows += [(sensor, i + 1, float(t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "sensor_id string, seq long, ts double")
    want, counters = brute_force(rows, duration, limit, stride, lateness)
    assert windows_of(rolling.rolling_windows(df, duration, limit, stride, lateness)) == want
    got = {r[0]: (r[1], r[2], r[3]) for r in rolling.window_counters(df, duration, limit, lateness).collect()}
    assert got == counters


def grid_by_hand(rows, durations, limits, lateness):
    """(sensor, seq, duration, limit) to (context, mean of a, mean of b) from the plain definition."""
    found = {}
    for sensor in {r[0] for r in rows}:
        seen, accepted = None, []
        for _, seq, ts, host, a, b in sorted((r for r in rows if r[0] == sensor), key=lambda r: r[1]):
            if seen is not None and ts < seen - lateness:
                continue
            seen = ts if seen is None else max(seen, ts)
            accepted.append((ts, seq, host, a, b))
            for d in durations:
                for m in limits:
                    members = sorted(f[:2] + f[2:] for f in accepted if f[0] >= seen - d)[-m:]
                    same = [f for f in members if f[2] == host and host is not None]
                    means = [sum(f[k] for f in same) / len(same) if same else None for k in (3, 4)]
                    found[sensor, seq, float(d), m] = (len(members), *means)
    return found


@pytest.mark.parametrize("ranges", ("1", "7"))
def test_grid_equals_plain_definition(spark, ranges):
    """A sensor over many ranges; sums follow the flows that enter and leave."""
    rng = np.random.default_rng(11)
    rows = []
    for sensor, size in (("hot", 400), ("cold", 15), (None, 3)):
        times = np.round(np.arange(size) / 3 + rng.integers(-9, 9, size), 1)
        hosts = rng.choice(["h1", "h2", "h3", ""], size)
        rows += [(sensor, i, float(t), str(h) or None, float(rng.normal() * 1e6), float(i)) for i, (t, h) in enumerate(zip(times, hosts))]
    df = spark.createDataFrame(rows, "sensor_id string, seq long, ts double, host string, a double, b double")
    durations, limits, lateness = (2, 15, 60), (1, 8, 50), 11
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rolling.grid_contexts(df, durations, limits, lateness, ["a", "b"], "host", keep=["host"]).collect()
        accepted = cut_lineage(rolling.arrival_ranges(df, lateness).where("not late"))
        spread = accepted.select("__range").distinct().count()
        handed = rolling.earlier_flows(accepted, 50, ["host"]).groupBy("sensor_id", "__range").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = grid_by_hand([r if r[0] else ("", *r[1:]) for r in rows], durations, limits, lateness)
    assert len(got) == len(want)
    for r in got:
        context, a, b = want[r["sensor_id"] or "", r["seq"], r["duration"], r["max_flows"]]
        assert r["context"] == context
        assert r["a_mean"] == (a if a is None else pytest.approx(a, rel=1e-9, abs=1e-6)) and r["b_mean"] == (b if b is None else pytest.approx(b))
    assert spread == int(ranges) and all(r["count"] <= 50 for r in handed)


def run_stream(spark, windows, name):
    query = windows.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    """State crosses micro-batches: one file per trigger, shuffled inside."""
    rng = np.random.default_rng(9)
    rows = [("s1" if i % 3 else "s2", i, float(i // 2 + rng.integers(-4, 4)), "{}") for i in range(90)]
    source = tmp_path / "in"
    source.mkdir()
    for part in range(3):
        chunk = rows[part * 30 : part * 30 + 30]
        order = rng.permutation(30)
        lines = [json.dumps(dict(zip(("sensor_id", "seq", "ts", "payload"), chunk[i]))) for i in order]
        (source / f"{part}.json").write_text("\n".join(lines))
        # File order is by modification time.
        os.utime(source / f"{part}.json", (1_000_000 + part, 1_000_000 + part))
    schema = "sensor_id string, seq long, ts double, payload string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = run_stream(spark, rolling_stream.rolling_window_stream(stream, 12, 6, 4, 3), "rolled")
    batch = rolling.rolling_windows(spark.createDataFrame(rows, schema), 12, 6, 4, 3, flush=False)
    assert windows_of(out) == windows_of(batch)
    assert out.agg(F.max("capacity_evictions")).first()[0] > 0


def test_idle_sensor_is_flushed(spark, tmp_path):
    """The tail of a sensor goes out by timer, once."""
    import time

    rows = [("s", i, float(i), "{}") for i in range(1, 6)]
    schema = "sensor_id string, seq long, ts double, payload string"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.json(source)
    stream = spark.readStream.schema(schema).json(source)
    windows = rolling_stream.rolling_window_stream(stream, 60, 10, 4, 0, flush_after_ms=500)
    query = windows.writeStream.format("memory").queryName("flushed").outputMode("append").start()
    try:
        # With timers there is always another batch, so the test polls.
        deadline = time.time() + 40
        while time.time() < deadline and spark.table("flushed").where("window_no = 2").count() == 0:
            time.sleep(1)
    finally:
        query.stop()
    tail = spark.table("flushed").where("window_no = 2").collect()
    assert [r["flow_seq"] for r in tail if r["is_new"]] == [5] and len(tail) == 5
    assert spark.table("flushed").where("window_no > 2").count() == 0


def test_buffer_state_round_trip():
    one = rolling_stream.RollingBuffer(10, 3, 2, 2)
    one.offer(10.0, 1, "{}")
    two = rolling_stream.RollingBuffer(10, 3, 2, 2, one.counters(), one.came())
    assert two.offer(9.0, 2, "{}") and not two.offer(7.0, 3, "{}")
    rows = two.emit("s")
    assert [(r[5], r[8]) for r in rows] == [(2, True), (1, True)] and two.late == 1
    assert [flow[1] for flow in two.came()] == [2] and not two.left and not two.pending()


def test_large_batch_of_one_sensor(spark, tmp_path):
    """100,000 flows of one sensor in one micro-batch, in Arrow batches of any order."""
    rng = np.random.default_rng(3)
    size = 100_000
    times = np.arange(size) / 4 + rng.integers(-40, 40, size)
    rows = spark.createDataFrame(
        [("hot", i, float(t), "{}") for i, t in enumerate(times)], "sensor_id string, seq long, ts double, payload string"
    )
    source = str(tmp_path / "in")
    rows.repartition(4, F.xxhash64("seq")).write.json(source)
    stream = spark.readStream.schema(rows.schema).json(source)
    out = run_stream(spark, rolling_stream.rolling_window_stream(stream, 60, 20, 500, 60), "large")
    batch = rolling.rolling_windows(rows, 60, 20, 500, 60, flush=False)
    got = windows_of(out)
    assert got == windows_of(batch) and len(got) > 150


def test_detection_stream(spark, tmp_path):
    """Collect, window, score, alert and store in one streaming query."""
    names = ("ts", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes",
             "conn_state", "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes")
    rows = [
        (str(i), f"10.0.0.{i % 4}", "5000", f"10.0.1.{i % 3}", str(80 + 1000 * (i % 2)), "tcp", "http", "1.5", str(10 * i), "-",
         "SF", "0", "ShAD", "1", "2", "3", "4")
        for i in range(20)
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    fit = features.fit_features(cleaning.clean_unlabelled(raw))
    width = 3 * len(fit.columns)
    rng = np.random.default_rng(0)
    head = {"w1": rng.normal(size=(4, width)).tolist(), "b1": [0.0] * 4, "w2": rng.normal(size=(3, 4)).tolist(), "b2": [-1e6, 0.1, 0.1]}
    model = detect.DetectionModel(
        fit, {"client-1": head}, ("Benign", "DDoS", "C&C"),
        {"model_digest": "a" * 64, "head_digest": "b" * 64, "schema_digest": "c" * 64},
    )
    policy = detect.DetectionPolicy(0.0, {"DDoS": "high", "C&C": "medium"}, (0.5, 0.9), (0.5,), b"key", {"s": "client-1"})
    flows = raw.withColumn("sensor_id", F.lit("s")).withColumn("seq", F.col("ts").cast("long")).withColumn("event_ts", F.col("ts").cast("double"))
    packed = rolling_stream.with_payload(flows, list(names), ts="event_ts")
    source = str(tmp_path / "in")
    packed.repartition(2).write.json(source)
    stream = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).json(source)
    windows = rolling_stream.rolling_window_stream(stream, 100, 50, 5, 100)
    schema = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)).schema
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    query = detect.start_detection_stream(
        windows, schema, cleaning.clean_unlabelled, model, policy, str(tmp_path / "out"), str(tmp_path / "cp"),
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    # Whatever the micro-batches wrote on the way is gone.
    assert set(os.listdir(tables)) <= before
    stored = spark.read.json(str(tmp_path / "out"))
    batch_rows = rolling.rolling_windows(flows.withColumn("flow_time", F.col("event_ts")), 100, 50, 5, 100, list(names), flush=False, ts="flow_time")
    scored = detect.score_windows(cleaning.clean_unlabelled(batch_rows), model, policy.routes)
    expected = detect.detections(scored, model, policy)
    # Every flow is new in exactly one window and none is Benign under this head.
    assert stored.count() == expected.count() == 20
    assert set(stored.columns) - {"batch_id"} == set(alerts.DETECTION_EVENT.fieldNames())
    assert not set(stored.columns) & {"orig_h", "resp_h"}
    # A replayed batch replaces its files by equal ones.
    for _ in range(2):
        detect.write_detections(expected, str(tmp_path / "again"), 7)
        lines = [sorted(p.read_text() for p in (tmp_path / "again" / "batch_id=7").glob("part-*"))]
        assert spark.read.json(str(tmp_path / "again")).count() == 20
    detect.write_detections(expected.repartition(3), str(tmp_path / "again"), 7)
    lines.append(sorted(p.read_text() for p in (tmp_path / "again" / "batch_id=7").glob("part-*")))
    assert lines[0] == lines[1]


def test_failed_batch_leaves_no_tables(spark):
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    with pytest.raises(ZeroDivisionError), temporary_tables() as owner:
        cut_lineage(spark.range(3))
        kept = owner.keep(spark.range(5))
        with temporary_tables() as inner:
            handed = inner.keep(spark.range(2))
        assert handed.count() == 2
        before = set(os.listdir(tables))
        1 / 0
    assert kept.count() == 5 and len(before - set(os.listdir(tables))) == 2


def test_latency_percentiles_on_a_stream(spark, tmp_path):
    """Sketched percentiles of complete windows lie within the stated rank error of the exact ones."""
    rng = np.random.default_rng(4)
    size, accuracy = 6000, 50
    rows = spark.createDataFrame(
        [(f"c{i % 2}", 1_700_000_000 + i, float(v)) for i, v in enumerate(rng.gamma(2.0, 30.0, size))],
        "client_id string, second long, latency double",
    )
    source = str(tmp_path / "in")
    rows.repartitionByRange(6, "second").write.json(source)
    # File order is by modification time.
    for place, path in enumerate(sorted((tmp_path / "in").glob("part-*"))):
        os.utime(path, (1_000_000 + place, 1_000_000 + place))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).json(source)
    timed = stream.withColumn("timestamp", F.timestamp_seconds("second"))
    rolled = alerts.latency_rollup(timed, F.col("latency") > 90, "latency", "20 minutes", "1 minute", accuracy)
    found = run_stream(spark, rolled, "latencies").collect()
    assert len(found) >= 8
    held = rows.collect()
    for row in found:
        start = row["window_start"].timestamp()
        own = sorted(r["latency"] for r in held if r["client_id"] == row["client_id"] and start <= r["second"] < start + 1200)
        assert row["flows"] == len(own) and row["alerts"] == sum(v > 90 for v in own)
        for name, p in (("latency_p50", 0.5), ("latency_p95", 0.95)):
            assert abs(own.index(row[name]) + 1 - p * len(own)) <= len(own) / accuracy + 1


def test_privacy_gate(spark):
    nested = spark.createDataFrame([(1,)], "a int").select(F.struct(F.lit("x").alias("raw_ip")).alias("doc"))
    with pytest.raises(ValueError, match="raw_ip"):
        alerts.privacy_gate(nested)
    mapped = spark.range(1).select(F.create_map(F.lit("tensor"), F.lit(1)).alias("m"))
    with pytest.raises(Exception, match="forbidden key"):
        alerts.privacy_gate(mapped).collect()
    safe = spark.range(1).select(F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    assert alerts.privacy_gate(safe).count() == 1


def test_routing_never_defaults(spark):
    df = spark.createDataFrame([("known",), ("other",)], "sensor_id string")
    with pytest.raises(Exception, match="unknown sensor"):
        alerts.route_sensor(df, {"known": "c"}).collect()
    held = alerts.route_sensor(df, {"known": "c"}, mode="quarantine").where("client_id is null")
    assert held.first()["route_error"] == "unknown sensor: other"


def test_policy_refuses_benign_severity(spark):
    with pytest.raises(ValueError):
        alerts.check_policy(0.5, {"Benign": "low"})
    with pytest.raises(ValueError):
        alerts.check_policy(1.5, {"DDoS": "low"})


def test_namespacing(spark):
    from flowgraph_spark.operators import graph

    df = spark.createDataFrame([("sensor-1", "10.0.0.1", "10.0.0.2")], "sensor_id string, orig_h string, resp_h string")
    row = graph.namespace_nodes(df).first()
    assert (row["orig_h"], row["resp_h"]) == ("sensor-1::10.0.0.1", "sensor-1::10.0.0.2")
