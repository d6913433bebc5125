"""Log parsing, cleaning and features on hand-made rows."""

import hashlib
import hmac
import json
import os
import math
import time

import pytest
from pyspark.sql import functions as F

from flowgraph_spark.functions import flows as fx
from flowgraph_spark.operators import cleaning, features
from flowgraph_spark.sources import conn_log, logs, tables, zeek_json

NAMES = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state "
    "local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes"
).split()
LABELS = "tunnel_parents   label   detailed-label"
ROWS = [
    ("tcp", "http", "SF", "100", "ShADadFf", "- Benign -"),
    ("udp", "dns", "SF", "-", "Dd", "-   Malicious   DDoS"),
    ("tcp", "-", "S1", "5", "S", "(empty) Benign (empty)"),
    ("tcp", "telnet", "SF", "7", "-", "- Benign -"),
    ("tcp", "-", "S1", "9", "ShA", "- Malicious C&C"),
    ("tcp", "-", "S0", "11", "S", "- Malicious DDoS"),
    ("udp", "dns", "SF", "13", "Dd", "- Benign -"),
]


def log_text():
    lines = ["#separator x", "#fields\t" + "\t".join([*NAMES, LABELS]), "#types\tstring", ""]
    for i, (proto, service, state, size, history, label) in enumerate(ROWS):
        values = [str(1.5 + i), f"C{i}", "10.0.0.1", "50000", f"10.0.0.{i}", "80", proto, service, "0.5", size, "1", state,
                  "-", "-", "0", history, "1", "2", "3", "4", label]
        lines.append("\t".join(values))
    return "\n".join(lines) + "\n"


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "conn.log"
    path.write_text(log_text())
    return str(path)


def test_read_and_clean(spark, log):
    rows = cleaning.clean(conn_log.read_conn_log(spark, log)).collect()
    assert len(rows) == 7
    assert sum(r["detailed_label"] == "Benign" for r in rows) == 4
    assert sum(r["orig_bytes_missing"] for r in rows) == 1
    assert sum(r["service"] == "unknown" for r in rows) == 3


def test_bad_and_short_lines(spark, tmp_path):
    path = tmp_path / "bad.log"
    good = log_text().rstrip("\n").split("\n")
    path.write_text("\n".join([*good, good[-1] + "\textra", "\t".join(["1"] * 3)]) + "\n")
    lines = spark.read.text(str(path))
    assert tuple(conn_log.count_bad_lines(lines).first()) == (8, 1)
    parsed = conn_log.parse_conn_log(lines)
    assert parsed.count() == 8
    assert parsed.where(F.col("orig_p").isNull()).count() == 1


def test_header_missing(spark, tmp_path):
    (tmp_path / "x.log").write_text("a\tb\n")
    with pytest.raises(ValueError):
        conn_log.read_conn_log(spark, str(tmp_path / "x.log"))


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    lines = log_text().rstrip("\n").split("\n")
    head = next(line for line in lines if line.startswith("#fields"))
    data = [line for line in lines if line and not line.startswith("#")]
    (tmp_path / "a.log").write_text("\n".join([head, *data[:3]]) + "\n")
    order = list(reversed(range(len(data[0].split("\t")) - 1)))
    turned = ["\t".join([line.split("\t")[i] for i in order] + [line.split("\t")[-1]]) for line in data[3:]]
    names = head.split("\t")[1:]
    (tmp_path / "b.log").write_text("\n".join(["\t".join(["#fields", *[names[i] for i in order], names[-1]]), *turned]) + "\n")
    (tmp_path / "all.log").write_text("\n".join([head, *data]) + "\n")
    both = conn_log.read_conn_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
    one = conn_log.read_conn_log(spark, str(tmp_path / "all.log"))
    columns = sorted(one.columns)
    assert sorted(map(tuple, both.select(columns).collect())) == sorted(map(tuple, one.select(columns).collect()))
    (tmp_path / "c.log").write_text(data[0] + "\n")
    with pytest.raises(Exception, match="no #fields header"):
        conn_log.read_conn_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "c.log")]).collect()


def test_rows_are_read_by_the_header_before_them(spark, tmp_path):
    """A concatenated log changes its fields; headers and rows lie in different blocks."""
    first, second = ["#fields", "ts", "uid", "label", "detailed-label"], ["#fields", "detailed-label", "label", "uid", "ts"]
    lines = ["0.5\tC-1\tBenign\tahead", "\t".join(first)]
    lines += [f"{i}\tC{i}\tBenign\td{i}" for i in range(900)] + ["\t".join(second)]
    lines += [f"d{i}\tMalicious\tC{i}\t{i}" for i in range(900, 1800)] + ["\t".join(first), "\t".join(first), "1800\tC1800\tBenign\td1800"]
    path = tmp_path / "rotated.log"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = conn_log.read_conn_log(spark, str(path))
        assert read.rdd.getNumPartitions() > 3
        rows = {r["uid"]: r for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1802 and rows["C-1"]["detailed_label"] == "ahead"
    for i in range(1801):
        label = "Malicious" if 900 <= i < 1800 else "Benign"
        assert (rows[f"C{i}"]["ts"], rows[f"C{i}"]["label"], rows[f"C{i}"]["detailed_label"]) == (str(i), label, f"d{i}")


def test_headers_that_change_all_the_time(spark, tmp_path):
    """Thousands of headers in a log cost no more per row than one: 20,000 rows, a header before every second."""
    orders = [["ts", "uid", "label", "detailed-label"], ["detailed-label", "label", "uid", "ts"]]
    lines = []
    for i in range(20000):
        if i % 2 == 0:
            lines.append("\t".join(["#fields", *orders[i // 2 % 2]]))
        values = [str(i), f"C{i}", "Benign", f"d{i}"]
        lines.append("\t".join(values if i // 2 % 2 == 0 else reversed(values)))
    (tmp_path / "turning.log").write_text("\n".join(lines) + "\n")
    started = time.perf_counter()
    rows = conn_log.read_conn_log(spark, str(tmp_path / "turning.log"))
    assert rows.where("uid = concat('C', ts) and detailed_label = concat('d', ts) and label = 'Benign'").count() == 20000
    assert time.perf_counter() - started < 60


def test_scan_scenarios_and_positions(spark, log):
    rows = conn_log.scan_scenarios(spark, {"a": log, "b": log})
    assert {r["scenario"]: r["count"] for r in rows.groupBy("scenario").count().collect()} == {"a": 7, "b": 7}
    data = spark.read.text(log).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    placed = conn_log.with_file_position(data).collect()
    assert sorted(r["position"] for r in placed) == list(range(7))
    assert all(f"\tC{r['position']}\t" in r["value"] for r in placed)


def test_positions_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = spark.read.text(str(path))
        assert lines.rdd.getNumPartitions() > 3
        placed = conn_log.with_file_position(lines)
        assert placed.where(F.col("position") != F.col("value").cast("long")).count() == 0
        # The offsets go to the lines; no line is exchanged.
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        joined = conn_log.with_file_position(lines, broadcast_blocks=0)
        assert joined.where(F.col("position") != F.col("value").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stable_row_id(spark):
    row = conn_log.with_stable_row_id(spark.createDataFrame([("s", 3)], "scenario string, p long"), "scenario", "p").first()
    assert row["row_id"] == hashlib.sha256(b"phase1-clean-v1:s:3").hexdigest()


def test_fit_on_train_only(spark, log):
    clean = cleaning.clean(conn_log.read_conn_log(spark, log))
    train, rest = clean.where("ts < 6"), clean.where("ts > 6")
    fit = features.fit_features(train)
    assert fit.proto == ("tcp", "udp") and fit.conn_state == ("S1", "SF")
    assert fit.service == ("dns", "http", "telnet")
    assert len(fit.columns) == 41
    unseen = features.transform(rest, fit).where("resp_h = '10.0.0.5'").first()
    assert unseen["conn_state_S1"] == 0 and unseen["conn_state_SF"] == 0 and unseen["service_other"] == 1
    scaled = features.transform(train, fit)
    for name in ("orig_bytes_scaled", "duration_scaled"):
        mean, std = scaled.agg(F.avg(name), F.stddev_pop(name)).first()
        assert abs(mean) < 1e-6
        assert abs(std - (0 if name.startswith("duration") else 1)) < 1e-5
    # Changing held-out values must not move the fit.
    assert features.fit_features(clean.where("ts < 6").union(rest.limit(0))) == fit


def test_fit_round_trip(spark, log, tmp_path):
    fit = features.fit_features(cleaning.clean(conn_log.read_conn_log(spark, log)))
    features.save_features(spark, fit, str(tmp_path / "fit"))
    assert features.load_features(spark, str(tmp_path / "fit")) == fit


def test_lenient_cast(spark):
    texts = ["1", " 2.5 ", "1d", "inf", "nan", "abc", "1e3", None, ".5"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(fx.lenient_double(F.col("v"))).collect()]
    assert got == [1.0, 2.5, None, None, None, None, 1000.0, None, 0.5]
    assert df.limit(1).select(fx.lenient_long(F.lit("80.0"))).first()[0] == 80


def test_label_modes(spark):
    df = spark.createDataFrame([("b",), ("Benign",), ("A",)], "detailed_label string")
    index = {r[0]: r[1] for r in features.label_index(df, "benign_first").collect()}
    assert index == {"Benign": 0, "A": 1, "b": 2}
    fixed = features.label_index(df, "fixed", taxonomy=("A", "Benign"))
    with pytest.raises(Exception, match="unknown label"):
        features.with_label_index(df, fixed).collect()


def test_json_refusal(spark):
    good = {"ts": 1.0, "id.orig_h": "a", "id.orig_p": 1, "id.resp_h": "b", "id.resp_p": 2, "proto": "tcp", "conn_state": "SF"}
    rows = [json.dumps(good), json.dumps({**good, "detailed-label": "x"}), "{}", "[1]", "  "]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    errors = [r["record_error"] for r in zeek_json.parse_zeek_json(lines).collect()]
    assert errors[0] is None and "label keys: detailed-label" == errors[1] and "missing" in errors[2] and errors[3] == "invalid record"
    with pytest.raises(Exception, match="label keys: detailed-label in"):
        zeek_json.parse_zeek_json(lines.where(F.contains("value", F.lit("label"))), mode="fail").collect()
    defaults = cleaning.apply_production_schema(lines.limit(1)).first()
    assert defaults["service"] == "-" and defaults["orig_bytes"] == 0.0 and defaults["schema_error"] is None


def test_event_log(spark):
    rows = [
        {"timestamp": "t", "level": "INFO", "event": "e", "fields": {"n": 1}},
        {"timestamp": "t", "level": "INFO", "event": "e", "fields": {"deep": {"my_password": 1}}},
        {"timestamp": "t", "level": "INFO", "event": "e", "fields": {"list": list(range(101))}},
    ]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    errors = [r["event_error"] for r in logs.parse_event_log(lines).collect()]
    assert errors == [None, "sensitive field: my_password", "field too large: list"]
    texts = [
        json.dumps({"event": "e", "fields": {"a": {"b": list(range(150))}}}),
        '{"event": "e", "fields": {"pass\\u0077ord": 1}}',
        json.dumps({"event": "e", "fields": {"a": [{"c": {"api_token": 1}}]}}),
        json.dumps({"event": "e", "fields": {"a": 'the word "password": in a text'}}),
        json.dumps({"event": "e", "fields": {"a": [[[[[[[[[1]]]]]]]]]}}),
        '{"fields":' + '{"a":[' * 30 + '{"x_secret":0}' + "]}" * 30 + "}",
        '{"fields":' + "[" * 200 + ",".join(["1"] * 101) + "]" * 200 + "}",
        "no object", "[1]", None, '{"a":' * 1500 + "1" + "}" * 1500,
    ]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    errors = [r["event_error"] for r in logs.parse_event_log(lines).collect()]
    unread = ["not a readable object"] * 4
    assert errors == [
        "field too large: b", "sensitive field: password", "sensitive field: api_token", None, None,
        "sensitive field: x_secret", "field too large: fields", *unread,
    ]


def test_entity_hash_equals_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(fx.entity_hash(key, F.lit("sensor-1"), F.lit("10.0.0.1"))).first()[0]
        assert got == hmac.new(key, b"sensor-1\x0010.0.0.1", hashlib.sha256).hexdigest()


def test_numeric_bucket(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.5, 0.74, 0.75, 3.0)], "v double")
    got = [r[0] for r in df.select(fx.numeric_bucket(F.col("v"), (0.5, 0.75, 1.0))).collect()]
    assert got == ["<0.5", "0.5-0.75", "0.5-0.75", "0.75-1", ">=1"]


def test_canonical_reuse(spark, log, tmp_path):
    build = lambda: cleaning.clean(conn_log.read_conn_log(spark, log))
    first, state = tables.write_canonical(spark, log, "s", str(tmp_path / "c"), build)
    again, second = tables.write_canonical(spark, log, "s", str(tmp_path / "c"), build)
    assert (state, second) == ("MISS", "HIT") and first.count() == again.count() == 7
    with open(log, "a") as handle:
        handle.write(log_text().rstrip("\n").split("\n")[-1] + "\n")
    changed, third = tables.write_canonical(spark, log, "s", str(tmp_path / "c"), build)
    assert third == "MISS" and changed.count() == 8


def test_only_changed_files_are_parsed_again(spark, tmp_path):
    text, cache = log_text(), str(tmp_path / "cache")
    (tmp_path / "logs").mkdir()
    for name in ("a", "b"):
        (tmp_path / "logs" / f"{name}.log").write_text(text)
    parsed = []

    def clean(rows):
        parsed.append(sorted(os.path.basename(r[0]) for r in rows.select("__file").distinct().collect()))
        return cleaning.clean(rows)

    def run():
        rows, report = tables.canonical_files(spark, str(tmp_path / "logs"), cache, clean)
        found = {os.path.basename(r["path"]): (r["status"], r["rows"]) for r in report.collect()}
        assert rows.count() == sum(n for _, n in found.values())
        return found

    assert run() == {"a.log": ("PARSED", 7), "b.log": ("PARSED", 7)}
    assert run() == {"a.log": ("HIT", 7), "b.log": ("HIT", 7)}
    (tmp_path / "logs" / "c.log").write_text(text)
    with open(tmp_path / "logs" / "a.log", "a") as handle:
        handle.write(text.rstrip("\n").split("\n")[-1] + "\n")
    assert run() == {"a.log": ("PARSED", 8), "b.log": ("HIT", 7), "c.log": ("PARSED", 7)}
    os.remove(tmp_path / "logs" / "b.log")
    assert run() == {"a.log": ("HIT", 8), "c.log": ("HIT", 7)}
    assert parsed == [["a.log", "b.log"], ["a.log", "c.log"]]


def test_replay_and_graph_tables(spark, tmp_path):
    rows = spark.createDataFrame(
        [("c1", "test", "A", 1.0, 5), ("c1", "validation", "B", 2.0, 6)],
        "client string, split string, detailed_label string, ts double, source_edge_index long",
    )
    target = str(tmp_path / "replay")
    tables.write_labelled_replay(rows, target)
    back, mismatches = tables.read_labelled_replay(spark, target, rows.schema)
    assert back.count() == 2 and mismatches.count() == 0
    edges = rows.selectExpr("client", "1L as src", "2L as dst", "split", "1 as label_idx")
    nodes = rows.selectExpr("client", "'n' as node", "0L as node_id")
    tables.write_graph_tables(nodes, edges, str(tmp_path / "g"), ["client"])
    assert tables.read_graph_tables(spark, str(tmp_path / "g"))[1].count() == 2
    with pytest.raises(Exception):
        tables.write_graph_tables(nodes, edges, str(tmp_path / "g"), ["client"])


def test_round_logs(spark, tmp_path):
    docs = [{"run_id": "r", "round": i, "loss": 1.0, "macro-f1": 0.5} for i in (1, 2, 4)]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(d) for d in docs))
    rounds = logs.read_round_logs(spark, str(tmp_path / "r.json"))
    assert [r["macro_f1"] for r in rounds.collect()] == [0.5] * 3
    assert logs.round_contiguity(rounds).first()["contiguous"] is False
    assert math.isclose(rounds.agg(F.avg("loss")).first()[0], 1.0)
