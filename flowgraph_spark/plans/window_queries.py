"""Rolling windows, alerts and reports over the flow view."""

from pyspark.sql import functions as F

from ..functions import flows as fx
from ..functions import vectors as vx
from ..operators import features, metrics
from ..operators.neighbors import scored
from ..schema import HISTORY_FLAGS, SCALED_COLUMNS
from ..session import cut_lineage
from ..streaming import alerts, detect, rolling
from . import views
from .feature_queries import FLAGS, PROTOS, SERVICES, STATES, history_sql, seen_sql
from .flow_queries import CLEANED
from .metric_queries import (
    BASE as PREDICTED,
    ENTROPY,
    K,
    confusion_sql,
    overall_sql,
    per_class_sql,
    round_all,
)
from .views import CLASSES, RAW_FLOWS, SENSORS, rounded_sql

DURATION, MAX_FLOWS, STRIDE, LATENESS = 21600.0, 12, 5, 1800.0
GRID_DURATIONS, GRID_LIMITS = (5400.0, 21600.0), (6, 12)
ROUTES = {s: f"client-{i}" for i, s in enumerate(SENSORS)}
SEVERITY = {"click": "low", "error": "medium", "purchase": "high"}
CONFIDENCE_BOUNDS, ENTROPY_BOUNDS = (0.6, 0.75, 0.9), (0.25, 0.5, 1.0)
KEY = b"entity-key"
DIGEST = "ab" * 32


def stream_flows(spark, sf_dir):
    """Flows in arrival order; every 17th is an hour old, so some are late."""
    flows = views.raw_flows(spark, sf_dir)
    late = F.when(F.col("seq") % 17 == 0, 3600.0).otherwise(0.0)
    return flows.select(
        F.col("scenario").alias("sensor_id"), "seq", (F.col("ts").cast("double") - late).alias("ts"),
        "orig_h", "resp_h", F.col("duration").cast("double").alias("duration"),
        F.col("resp_pkts").cast("double").alias("resp_pkts"),
    )


STREAM = f"""{RAW_FLOWS},
stream_flows AS (SELECT scenario AS sensor_id, seq, CAST(ts AS DOUBLE) - CASE WHEN seq % 17 = 0 THEN 3600 ELSE 0 END AS ts,
  orig_h, resp_h, CAST(duration AS DOUBLE) AS duration, CAST(resp_pkts AS DOUBLE) AS resp_pkts FROM raw_flows),
prior AS (SELECT *, max(ts) OVER (PARTITION BY sensor_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stream_flows),
flagged AS (SELECT *, coalesce(ts < before - {LATENESS}, FALSE) AS late, greatest(coalesce(before, ts), ts) AS max_seen FROM prior),
accepted AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS ordinal, count(*) OVER (PARTITION BY sensor_id) AS total
  FROM flagged WHERE NOT late)"""
BASE = f"WITH {STREAM}"


def _context_sql(emissions, duration, limit, name="ctx"):
    return f"""{name}_all AS (SELECT e.*, f.seq AS flow_seq, f.ts AS flow_ts, f.ordinal AS flow_ordinal, f.orig_h AS flow_orig_h,
    f.resp_h AS flow_resp_h, f.duration AS flow_duration, f.resp_pkts AS flow_resp_pkts,
    row_number() OVER (PARTITION BY e.sensor_id, e.seq ORDER BY f.ts DESC, f.seq DESC) AS newest
  FROM {emissions} e JOIN accepted f ON f.sensor_id = e.sensor_id AND f.seq <= e.seq AND f.ts >= e.max_seen - {duration}),
{name} AS (SELECT * FROM {name}_all WHERE newest <= {limit})"""


EMITTED = f"""{BASE}, emitted AS (SELECT *, CAST(ceil(ordinal / {STRIDE}.0) AS BIGINT) AS window_no FROM accepted
  WHERE ordinal % {STRIDE} = 0 OR ordinal = total), {_context_sql('emitted', DURATION, MAX_FLOWS)},
windows AS (SELECT sensor_id, sensor_id || '-window-' || lpad(CAST(window_no AS VARCHAR), 8, '0') AS window_id, window_no,
  min(flow_ts) OVER w AS start_ts, max_seen AS end_ts, flow_seq, flow_ts, count(*) OVER w - newest AS position,
  flow_ordinal > (window_no - 1) * {STRIDE} AS is_new, flow_orig_h AS orig_h, flow_resp_h AS resp_h, flow_duration AS duration,
  flow_resp_pkts AS resp_pkts FROM ctx WINDOW w AS (PARTITION BY sensor_id, seq))"""
PAYLOAD = ("orig_h", "resp_h", "duration", "resp_pkts")


def windows(spark, sf_dir):
    return rolling.rolling_windows(
        stream_flows(spark, sf_dir), DURATION, MAX_FLOWS, STRIDE, LATENESS, PAYLOAD
    )


def _windows(spark, sf_dir):
    rows = windows(spark, sf_dir)
    return rows.select(
        "sensor_id", "window_id", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"),
        "flow_seq", "position", "is_new",
    )


_WINDOWS_SQL = f"""{EMITTED} SELECT sensor_id, window_id, round(start_ts, 3) AS start_ts, round(end_ts, 3) AS end_ts,
  flow_seq, position, is_new FROM windows"""


def _snapshots(spark, sf_dir):
    rows = rolling.snapshots(windows(spark, sf_dir), ["orig_h"])
    return rows.select(
        "window_id", F.size("flows").alias("flows"),
        F.concat_ws(",", F.transform("flows", lambda f: f["flow_seq"].cast("string"))).alias("flow_seqs"),
        F.concat_ws(",", F.transform("emission_indices", lambda i: i.cast("string"))).alias("emission_indices"),
    )


_SNAPSHOTS_SQL = f"""{EMITTED} SELECT window_id, count(*) AS flows, string_agg(CAST(flow_seq AS VARCHAR), ',' ORDER BY position) AS flow_seqs,
  coalesce(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (is_new), '') AS emission_indices FROM windows GROUP BY window_id"""


def _late(spark, sf_dir):
    rows = rolling.flag_late(stream_flows(spark, sf_dir), LATENESS)
    return rows.select("seq", "late", F.round("max_seen", 3).alias("max_seen"))


def _counters(spark, sf_dir):
    return round_all(
        rolling.window_counters(stream_flows(spark, sf_dir), DURATION, MAX_FLOWS, LATENESS)
    )


_COUNTERS_SQL = f"""{BASE}, {_context_sql('accepted', DURATION, MAX_FLOWS + 1)},
ev AS (SELECT sensor_id, count(*) AS evicted FROM ctx WHERE newest = {MAX_FLOWS + 1} AND ts >= max_seen - {DURATION} GROUP BY sensor_id),
c AS (SELECT sensor_id, count(*) FILTER (NOT late) AS accepted, count(*) FILTER (late) AS late_dropped FROM flagged GROUP BY sensor_id)
SELECT sensor_id, accepted, late_dropped, coalesce(evicted, 0) AS capacity_evictions,
  {rounded_sql('late_dropped / CAST(accepted + late_dropped AS DOUBLE)', 6)} AS flow_drop_rate,
  {rounded_sql('coalesce(evicted, 0) / CAST(accepted AS DOUBLE)', 6)} AS capacity_eviction_rate FROM c LEFT JOIN ev USING (sensor_id)"""


def _probe(spark, sf_dir):
    return round_all(
        rolling.late_event_probe(stream_flows(spark, sf_dir), 60.0)
    )


_PROBE_SQL = f"""{BASE}, r AS (SELECT sensor_id, ts, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, seq) - 1 AS o,
  count(*) OVER (PARTITION BY sensor_id) AS n FROM stream_flows),
s AS (SELECT sensor_id, ts, CASE WHEN o % 20 = 0 AND o + 1 < n THEN o + 1 WHEN o % 20 = 1 THEN o - 1 ELSE o END AS arrival FROM r),
p AS (SELECT *, max(ts) OVER (PARTITION BY sensor_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT sensor_id, count(*) AS input_flows, count(*) FILTER (ts < before - 60) AS late_drop_count,
  {rounded_sql('count(*) FILTER (ts < before - 60) / CAST(count(*) AS DOUBLE)', 6)} AS flow_drop_rate FROM p GROUP BY sensor_id"""

GRID_HEAD = {
    "w": [[((i * 5 + j * 3) % 7 - 3) / 2 for j in range(4)] for i in range(K)],
    "b": [(i % 3 - 1) / 4 for i in range(K)],
}


def _grid_rows(spark, sf_dir):
    """Scored grid with candidate keys and the truth of each flow."""
    flows = stream_flows(spark, sf_dir).withColumnRenamed("duration", "flow_len")
    labels = views.labelled_flows(spark, sf_dir)
    names = F.array(*[F.lit(c) for c in CLASSES])
    truth = labels.select("seq", (F.array_position(names, F.col("detailed_label")) - 1).cast("int").alias("true_idx"))

    rows = rolling.grid_contexts(
        flows.join(truth, "seq"), GRID_DURATIONS, GRID_LIMITS, LATENESS, ["flow_len", "resp_pkts"], "orig_h",
        keep=["flow_len", "resp_pkts", "true_idx"],
    )
    means = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("flow_len_mean", "resp_pkts_mean")]
    inputs = [F.col("flow_len") / 500, F.col("resp_pkts") / 30, means[0] / 500, means[1] / 30]
    logits = F.array(*vx.dense(inputs, GRID_HEAD["w"], GRID_HEAD["b"]))
    packed = rows.select(
        "sensor_id", "seq", "ts", "duration", "max_flows", "context", "true_idx",
        F.transform(vx.softmax(logits), lambda p: F.round(p, 9)).alias("probabilities"),
    )
    # Four reports read the scored grid.
    return cut_lineage(scored(packed))


def _grid(spark, sf_dir):
    by = ["duration", "max_flows"]
    rows = _grid_rows(spark, sf_dir)
    overall = metrics.classification_metrics(rows, K, by)
    stability = metrics.adjacent_agreement(
        rows, "sensor_id", ["seq"], by=by
    )
    size = rows.groupBy(*by).agg(F.avg("context").alias("mean_context"), F.avg("confidence").alias("confidence"))
    expected = rolling.flag_late(stream_flows(spark, sf_dir), LATENESS).where(~F.col("late"))
    covered = rolling.coverage(rows, expected, by, ["sensor_id", "seq"])
    return round_all(overall.join(stability, by).join(size, by).join(covered, by), 5)


_LOGITS = "[" + ", ".join(
    " + ".join([str(float(b))] + [f"{float(w)}::DOUBLE * {x}" for w, x in zip(row, ("flow_len / 500", "resp_pkts / 30", "d / 500", "p / 30"))])
    for row, b in zip(GRID_HEAD["w"], GRID_HEAD["b"])
) + "]"
_CANDIDATES = " UNION ALL ".join(
    f"SELECT CAST({d} AS DOUBLE) AS duration, {m} AS max_flows" for d in GRID_DURATIONS for m in GRID_LIMITS
)
_GRID_SQL = f"""{BASE}, truth AS (SELECT seq, CAST(list_position({list(CLASSES)!r}, CASE WHEN trim(detailed_label) = '-' THEN 'Benign' ELSE trim(detailed_label) END) - 1 AS INTEGER) AS true_idx FROM raw_flows),
{_context_sql('accepted', max(GRID_DURATIONS), max(GRID_LIMITS))},
cand AS ({_CANDIDATES}),
g AS (SELECT sensor_id, seq, c.duration, c.max_flows, x.duration AS flow_len, x.resp_pkts, count(*) AS context,
  coalesce(avg(flow_duration) FILTER (flow_orig_h = orig_h), 0) AS d, coalesce(avg(flow_resp_pkts) FILTER (flow_orig_h = orig_h), 0) AS p
  FROM ctx x, cand c WHERE newest <= c.max_flows AND max_seen - flow_ts <= c.duration GROUP BY ALL),
lg AS (SELECT *, {_LOGITS} AS logits FROM g JOIN truth USING (seq)),
pw AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS pows FROM lg),
pr AS (SELECT *, list_transform(pows, lambda x: round(x / list_sum(pows), 9)) AS probs FROM pw),
sc AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred_idx, list_max(probs) AS confidence FROM pr),
{confusion_sql('sc', ['duration', 'max_flows'])}, {per_class_sql('cm', ['duration', 'max_flows'])},
o AS ({overall_sql('pc', ['duration', 'max_flows']).replace(', 6)', ', 5)')}),
l AS (SELECT *, lag(pred_idx) OVER (PARTITION BY duration, max_flows, sensor_id ORDER BY seq) AS previous FROM sc),
a0 AS (SELECT duration, max_flows, sensor_id, avg(CAST(pred_idx = previous AS DOUBLE)) AS share FROM l WHERE previous IS NOT NULL GROUP BY ALL),
a AS (SELECT duration, max_flows, {rounded_sql('avg(share)', 5)} AS adjacent_agreement FROM a0 GROUP BY ALL),
z AS (SELECT duration, max_flows, {rounded_sql('avg(context)', 5)} AS mean_context, {rounded_sql('avg(confidence)', 5)} AS confidence,
  count(*) AS scored, count(DISTINCT (sensor_id, seq)) AS distinct_flows, (SELECT count(*) FROM accepted) AS expected FROM sc GROUP BY ALL)
SELECT * FROM o JOIN a USING (duration, max_flows) JOIN z USING (duration, max_flows)"""


def _route(spark, sf_dir):
    """Half of the routes are known; the others are quarantined with a reason."""
    known = {s: c for i, (s, c) in enumerate(sorted(ROUTES.items())) if i < 3}
    rows = alerts.route_sensor(stream_flows(spark, sf_dir), known, mode="quarantine")
    return rows.groupBy("sensor_id", "client_id", "route_error").agg(F.count(F.lit(1)).alias("n"))


_ROUTE_SQL = f"""{BASE} SELECT sensor_id, CASE WHEN sensor_id < 'sensor-3' THEN replace(sensor_id, 'sensor', 'client') END AS client_id,
  CASE WHEN sensor_id >= 'sensor-3' THEN 'unknown sensor: ' || sensor_id END AS route_error, count(*) AS n FROM stream_flows GROUP BY ALL"""


def scored_flows(spark, sf_dir):
    """Predictions in the shape the alert policy takes."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    rows = metrics.probabilities_and_entropy(views.predictions(spark, sf_dir))
    times = views.raw_flows(spark, sf_dir).select("seq", "orig_h", F.col("ts").cast("double").alias("flow_ts"))
    joined = rows.join(times, "seq").withColumnRenamed("client", "sensor_id")
    return alerts.route_sensor(joined, ROUTES).select(
        "seq", "sensor_id", "client_id", "flow_ts",
        rolling.window_id(F.col("sensor_id"), F.floor(F.col("seq") / 50) + 1).alias("window_id"),
        F.element_at(names, F.col("pred_idx") + 1).alias("predicted_class"), "confidence", "entropy",
        F.lit(50).alias("flow_count"), F.col("orig_h").alias("entity"),
    )


def events(spark, sf_dir):
    return alerts.apply_alert_policy(
        scored_flows(spark, sf_dir), 0.7, SEVERITY, CONFIDENCE_BOUNDS, ENTROPY_BOUNDS, KEY,
        {"model_digest": DIGEST, "head_digest": F.sha2("client_id", 256), "schema_digest": DIGEST},
        timestamp=F.timestamp_micros((F.col("flow_ts") * 1e6).cast("long")),
    )


def bucket_sql(value, bounds):
    cases = [f"WHEN {value} < {bounds[0]} THEN '<{bounds[0]:g}'"]
    cases += [f"WHEN {value} < {high} THEN '{low:g}-{high:g}'" for low, high in zip(bounds, bounds[1:])]
    return f"CASE {' '.join(cases)} ELSE '>={bounds[-1]:g}' END"


def _pads():
    block = KEY.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


_INNER, _OUTER = _pads()
HASH_SQL = (
    f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(sensor_id || chr(0) || orig_h))))"
)
EVENTS = f"""{PREDICTED}, sf AS (SELECT p.*, p.client AS sensor_id, replace(p.client, 'sensor', 'client') AS client_id, r.orig_h,
    CAST(r.ts AS DOUBLE) AS flow_ts, {list(CLASSES)!r}[pred_idx + 1] AS predicted_class, {ENTROPY} AS entropy,
    p.client || '-window-' || lpad(CAST(p.seq // 50 + 1 AS VARCHAR), 8, '0') AS window_id
  FROM predictions p JOIN raw_flows r ON r.seq = p.seq),
ev AS (SELECT *, {bucket_sql('confidence', CONFIDENCE_BOUNDS)} AS confidence_bucket, {bucket_sql('entropy', ENTROPY_BOUNDS)} AS entropy_bucket,
    CASE predicted_class WHEN 'click' THEN 'low' WHEN 'error' THEN 'medium' WHEN 'purchase' THEN 'high' END AS severity,
    sha256(client_id) AS head_digest FROM sf
  WHERE predicted_class IN ('click', 'error', 'purchase') AND confidence >= 0.7)"""


def _events(spark, sf_dir):
    rows = alerts.validate_detections(events(spark, sf_dir))
    return rows.withColumn("timestamp", F.round(F.unix_micros("timestamp") / 1e6, 2))


_EVENTS_SQL = f"""{EVENTS} SELECT round(CAST(flow_ts * 1e6 AS BIGINT) / 1e6, 2) AS timestamp, 'fedper_detection' AS event_type, sensor_id, client_id,
  window_id, predicted_class, severity, confidence_bucket, entropy_bucket, 50 AS flow_count, {HASH_SQL} AS entity_hash,
  '{DIGEST}' AS model_digest, head_digest, '{DIGEST}' AS schema_digest FROM ev"""


def _buckets(spark, sf_dir):
    rows = scored_flows(spark, sf_dir)
    return rows.groupBy(
        fx.numeric_bucket(F.col("confidence"), CONFIDENCE_BOUNDS).alias("confidence_bucket"),
        fx.numeric_bucket(F.round("entropy", 6), ENTROPY_BOUNDS).alias("entropy_bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))


_BUCKETS_SQL = f"""{EVENTS} SELECT {bucket_sql('confidence', CONFIDENCE_BOUNDS)} AS confidence_bucket,
  {bucket_sql('round(entropy, 6)', ENTROPY_BOUNDS)} AS entropy_bucket, count(*) AS n FROM sf GROUP BY ALL"""


def _hash(spark, sf_dir):
    flows = stream_flows(spark, sf_dir)
    return flows.select("seq", fx.entity_hash(KEY, F.col("sensor_id"), F.col("orig_h")).alias("entity_hash"))


def _privacy(spark, sf_dir):
    """Event properties as a map pass the gate; digests are counted."""
    from pyspark.sql import types as T

    rows = views.table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", T.MapType(T.StringType(), T.StringType())).alias("props"),
        F.sha2(F.col("event_type"), 256).alias("digest"),
    )
    gated = alerts.privacy_gate(rows)
    return gated.groupBy(F.map_keys("props")[0].alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fx.is_digest(F.col("digest"))).alias("digests"),
        F.count_if(fx.is_digest(F.upper("digest"))).alias("upper_digests"),
    )


def _rollup(spark, sf_dir):
    rows = alerts.detection_rollup(events(spark, sf_dir), "1 day")
    return rows.withColumn("window_start", F.unix_timestamp("window_start")).withColumnRenamed("window_start", "start")


_ROLLUP_SQL = f"""{EVENTS} SELECT CAST(floor(flow_ts / 86400) * 86400 AS BIGINT) AS start, client_id, predicted_class, severity,
  confidence_bucket, entropy_bucket, head_digest, count(*) AS detections, 50 * count(*) AS flows FROM ev GROUP BY ALL"""


def _panels(spark, sf_dir):
    """Alert and latency panels; the age of a flow within its window stands for the latency."""
    truth = views.predictions(spark, sf_dir).select("seq", "true_idx")
    rows = scored_flows(spark, sf_dir).join(truth, "seq").withColumns(
        {"timestamp": F.timestamp_seconds(F.floor("flow_ts")), "age_ms": F.pmod(F.col("seq") * 37, F.lit(1009))}
    )
    alerted = F.col("predicted_class").isin(*SEVERITY) & (F.col("confidence") >= 0.7)
    panels = alerts.detection_panels(rows, alerted, F.col("true_idx") == 0, "age_ms", "1 day")
    return panels.select(
        F.unix_timestamp("window_start").alias("start"), "client_id", "flows", "alerts",
        F.round("alert_rate", 6).alias("alert_rate"), F.round("benign_false_alert_rate", 6).alias("benign_false_alert_rate"),
        "latency_p50", "latency_p95",
    )


def _latency(spark, sf_dir):
    rows = scored_flows(spark, sf_dir).withColumns(
        {"timestamp": F.timestamp_seconds(F.floor("flow_ts")), "age_ms": F.pmod(F.col("seq") * 37, F.lit(1009))}
    )
    alerted = F.col("predicted_class").isin(*SEVERITY) & (F.col("confidence") >= 0.7)
    found = alerts.latency_rollup(rows, alerted, "age_ms", "1 day", accuracy=1_000_000)
    return found.select(
        F.unix_timestamp("window_start").alias("start"), "client_id", "flows", "alerts",
        F.round("alert_rate", 6).alias("alert_rate"), "latency_p50", "latency_p95",
    )


_ALERTED = "predicted_class IN ('click', 'error', 'purchase') AND confidence >= 0.7"
_PANELS_SQL = f"""{EVENTS}, x AS (SELECT CAST(floor(flow_ts / 86400) * 86400 AS BIGINT) AS start, client_id, {_ALERTED} AS alerted,
    true_idx = 0 AS benign, (seq * 37) % 1009 AS age_ms FROM sf)
SELECT start, client_id, count(*) AS flows, count(*) FILTER (alerted) AS alerts,
  round(count(*) FILTER (alerted) / count(*), 6) AS alert_rate,
  round(count(*) FILTER (alerted AND benign) / nullif(count(*) FILTER (benign), 0), 6) AS benign_false_alert_rate,
  list_sort(list(age_ms))[CAST(round_even((count(*) - 1) * 0.5, 0) AS INTEGER) + 1] AS latency_p50,
  list_sort(list(age_ms))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INTEGER) + 1] AS latency_p95 FROM x GROUP BY ALL"""


#: A fit and a head per client with fixed numbers.
SCORE_FIT = features.FittedFeatures(
    PROTOS, SERVICES, STATES, tuple((c, 1.0 + i, 2.0 + i / 2) for i, c in enumerate(SCALED_COLUMNS)), FLAGS
)
_FEATURES = list(SCORE_FIT.columns)
SCORE_HEADS = {
    client: {
        "w1": [[((i * 7 + j * 5 + k * 3) % 11 - 5) / 16 for j in range(3 * len(_FEATURES))] for i in range(3)],
        "b1": [(i - k % 3) / 4 for i in range(3)],
        "w2": [[((i * 3 + j + k) % 5 - 2) / 4 for j in range(3)] for i in range(K)],
        "b2": [(i % 3 - 1) / 8 for i in range(K)],
    }
    for k, client in enumerate(sorted(ROUTES.values()))
}


_LATENCY_SQL = f"""{EVENTS}, x AS (SELECT CAST(floor(flow_ts / 86400) * 86400 AS BIGINT) AS start, client_id, {_ALERTED} AS alerted,
    (seq * 37) % 1009 AS age_ms FROM sf)
SELECT start, client_id, count(*) AS flows, count(*) FILTER (alerted) AS alerts, round(count(*) FILTER (alerted) / count(*), 6) AS alert_rate,
  list_sort(list(age_ms))[CAST(ceil(count(*) * 0.5) AS INTEGER)] AS latency_p50,
  list_sort(list(age_ms))[CAST(ceil(count(*) * 0.95) AS INTEGER)] AS latency_p95 FROM x GROUP BY ALL"""


def _score_windows(spark, sf_dir):
    """Every window as a graph of its own; each flow scored once, by its client's head."""
    late = F.when(F.col("seq") % 17 == 0, 3600.0).otherwise(0.0)
    clean = views.clean_flows(spark, sf_dir).withColumn("arrival", F.col("ts") - late).withColumnRenamed("scenario", "sensor_id")
    # A flow has its features before it goes into several windows.
    own = clean.select("sensor_id", "seq", "arrival", "orig_h", "resp_h", *features.feature_expressions(SCORE_FIT, clean.columns))
    # Written: the sort by arrival samples its input first, which would clean every flow twice.
    flows = cut_lineage(features.with_feature_array(own, SCORE_FIT).withColumn("flow", F.monotonically_increasing_id()))
    # Windows are found from numbers; the flows meet them afterwards, by a number of their own.
    found = rolling.rolling_windows(flows.select("sensor_id", "seq", "arrival", "flow"), DURATION, MAX_FLOWS, STRIDE, LATENESS, ["flow"], ts="arrival")
    rows = found.join(flows.select("flow", "orig_h", "resp_h", "features"), "flow")
    model = detect.DetectionModel(SCORE_FIT, SCORE_HEADS, CLASSES, {})
    found = detect.score_windows(rows, model, ROUTES)
    return found.select(
        "window_id", "client_id", "flow_seq", "flow_count", "predicted_class",
        views.rounded(F.col("confidence"), 5).alias("confidence"), views.rounded(F.col("entropy"), 5).alias("entropy"),
    )


_FEATURE_SQL = ", ".join(
    [
        "CAST(resp_p < 1024 AS TINYINT) AS resp_port_well_known",
        "CAST(resp_p >= 1024 AND resp_p < 49152 AS TINYINT) AS resp_port_registered",
        "CAST(resp_p >= 49152 AS TINYINT) AS resp_port_dynamic",
        "CAST(orig_p >= 0 AND orig_p < 1024 AS TINYINT) AS orig_port_is_wellknown",
    ]
    + [seen_sql("proto", v, "proto") for v in PROTOS]
    + [seen_sql("service", v, "service") for v in SERVICES]
    + [f"CAST(service NOT IN {SERVICES!r} AS TINYINT) AS service_other"]
    + [seen_sql("conn_state", v, "conn_state") for v in STATES]
    + [history_sql(f) for f in HISTORY_FLAGS]
    + [
        f"CAST(CAST((ln(1 + {c}) - {mean!r}::DOUBLE) / {scale!r}::DOUBLE AS FLOAT) AS DOUBLE) AS {c}_scaled"
        for c, mean, scale in SCORE_FIT.scaler
    ]
    + list(FLAGS)
)


def _weights_sql(layer):
    """Rows of a layer by client, as nested lists."""
    cases = " ".join(f"WHEN '{c}' THEN {[list(map(float, row)) for row in head[layer]]}::DOUBLE[][]" for c, head in SCORE_HEADS.items())
    return f"CASE client_id {cases} END"


def _bias_sql(layer):
    cases = " ".join(f"WHEN '{c}' THEN {list(map(float, head[layer]))}::DOUBLE[]" for c, head in SCORE_HEADS.items())
    return f"CASE client_id {cases} END"


def _layer_sql(inputs, weights, bias):
    return f"list_transform(range(1, len({bias}) + 1), lambda i: list_dot_product({inputs}, {weights}[i]) + {bias}[i])"


_VECTOR = "[" + ", ".join(f'CAST("{c}" AS DOUBLE)' for c in _FEATURES) + "]"
_SCORE_WINDOWS_SQL = f"""{CLEANED}, {EMITTED.removeprefix("WITH " + RAW_FLOWS + ",")},
ft AS (SELECT seq AS flow_seq, {_FEATURE_SQL} FROM clean_flows),
wf AS (SELECT sensor_id, window_id, w.flow_seq, is_new, orig_h, resp_h, ft.* EXCLUDE (flow_seq) FROM windows w JOIN ft USING (flow_seq)),
ends AS (SELECT window_id, orig_h AS node, * EXCLUDE (window_id) FROM wf UNION ALL SELECT window_id, resp_h, * EXCLUDE (window_id) FROM wf),
means AS (SELECT window_id, node, [{", ".join(f'avg("{c}")' for c in _FEATURES)}] AS h FROM ends GROUP BY ALL),
sizes AS (SELECT window_id, count(*) AS flow_count FROM windows GROUP BY window_id),
z AS (SELECT wf.window_id, replace(sensor_id, 'sensor', 'client') AS client_id, flow_seq, flow_count,
  list_concat(list_concat(a.h, b.h), {_VECTOR}) AS z FROM wf JOIN sizes USING (window_id)
  JOIN means a ON a.window_id = wf.window_id AND a.node = orig_h JOIN means b ON b.window_id = wf.window_id AND b.node = resp_h WHERE is_new),
hw AS (SELECT client_id, {_weights_sql('w1')} AS w1, {_bias_sql('b1')} AS b1, {_weights_sql('w2')} AS w2, {_bias_sql('b2')} AS b2
  FROM (SELECT unnest({sorted(SCORE_HEADS)!r}) AS client_id)),
u AS (SELECT z.*, w2, b2, list_transform({_layer_sql('z', 'w1', 'b1')}, lambda x: greatest(x, 0)) AS units FROM z JOIN hw USING (client_id)),
lg AS (SELECT *, {_layer_sql('units', 'w2', 'b2')} AS logits FROM u),
pw AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS pows FROM lg),
pr AS (SELECT *, list_transform(pows, lambda x: x / list_sum(pows)) AS probs FROM pw)
SELECT window_id, client_id, flow_seq, flow_count, {list(CLASSES)!r}[list_position(probs, list_max(probs))] AS predicted_class,
  {rounded_sql('list_max(probs)', 5)} AS confidence,
  {rounded_sql('list_sum(list_transform(probs, lambda p: -p * ln(p + 1e-12)))', 5)} AS entropy FROM pr"""


def _predicted_counts(spark, sf_dir):
    return alerts.predicted_counts(scored_flows(spark, sf_dir))


def _graph_features(spark, sf_dir):
    edges = detect.window_graph(cut_lineage(windows(spark, sf_dir)), ["duration", "resp_pkts"], keep=["flow_seq"])
    return edges.select("window_id", "flow_seq", "src", "dst", "duration", "resp_pkts")


_GRAPH_SQL = f"""{EMITTED}, n AS (SELECT window_id, sensor_id || '::' || orig_h AS node FROM windows
  UNION SELECT window_id, sensor_id || '::' || resp_h FROM windows),
d AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY node) - 1 AS id FROM n)
SELECT w.window_id, flow_seq, a.id AS src, b.id AS dst, duration, resp_pkts FROM windows w
JOIN d a ON a.window_id = w.window_id AND a.node = sensor_id || '::' || orig_h
JOIN d b ON b.window_id = w.window_id AND b.node = sensor_id || '::' || resp_h"""


def _collector(spark, sf_dir):
    """Counters of a collection run with inference latency as an input column."""
    flows = stream_flows(spark, sf_dir)
    counters = rolling.window_counters(flows, DURATION, MAX_FLOWS, LATENESS).agg(
        F.sum(F.col("accepted") + F.col("late_dropped")).alias("observations"),
        F.sum("late_dropped").alias("dropped_flows"), F.sum("capacity_evictions").alias("window_context_evictions"),
    )
    emitted = rolling.emission_rows(rolling.accept(flows, LATENESS), STRIDE)
    latency = metrics.numeric_summary(
        emitted.withColumn("latency", (F.col("seq") % 97).cast("double")), [], "latency"
    )
    return counters.select(
        "*",
        emitted.agg(F.count(F.lit(1))).scalar().alias("windows"),
        events(spark, sf_dir).agg(F.count(F.lit(1))).scalar().alias("events"),
        latency.select("p50").scalar().alias("latency_p50"),
        latency.select("p95").scalar().alias("latency_p95"),
    )


_COLLECTOR_SQL = f"""{EVENTS}, {STREAM.removeprefix(RAW_FLOWS + ',')}, {_context_sql('accepted', DURATION, MAX_FLOWS + 1)},
emitted AS (SELECT *, CAST(seq % 97 AS DOUBLE) AS latency FROM accepted WHERE ordinal % {STRIDE} = 0 OR ordinal = total),
o AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS r, count(*) OVER () AS n FROM emitted)
SELECT (SELECT count(*) FROM stream_flows) AS observations, (SELECT count(*) FROM flagged WHERE late) AS dropped_flows,
  (SELECT count(*) FROM ctx WHERE newest = {MAX_FLOWS + 1} AND ts >= max_seen - {DURATION}) AS window_context_evictions,
  (SELECT count(*) FROM emitted) AS windows, (SELECT count(*) FROM ev) AS events,
  (SELECT max(latency) FROM o WHERE r = round_even((n - 1) * 0.5, 0)) AS latency_p50,
  (SELECT max(latency) FROM o WHERE r = round_even((n - 1) * 0.95, 0)) AS latency_p95"""


QUERIES = {
    "flag_late_flows": (
        _late, f"{BASE} SELECT seq, late, round(max_seen, 3) AS max_seen FROM flagged",
    ),
    "rolling_windows": (_windows, _WINDOWS_SQL),
    "window_snapshots": (_snapshots, _SNAPSHOTS_SQL),
    "window_counters": (_counters, _COUNTERS_SQL),
    "late_event_probe": (_probe, _PROBE_SQL),
    "evaluate_window_grid": (_grid, _GRID_SQL),
    "route_sensor": (_route, _ROUTE_SQL),
    "apply_alert_policy": (_events, _EVENTS_SQL),
    "numeric_bucket": (_buckets, _BUCKETS_SQL),
    "entity_hash": (_hash, f"{BASE} SELECT seq, {HASH_SQL} AS entity_hash FROM stream_flows"),
    "privacy_gate": (
        _privacy, "SELECT 'k' AS key, count(*) AS n, count(*) AS digests, 0 AS upper_digests FROM events",
    ),
    "window_graph": (_graph_features, _GRAPH_SQL),
    "score_windows": (_score_windows, _SCORE_WINDOWS_SQL),
    "detection_rollup": (_rollup, _ROLLUP_SQL),
    "detection_panels": (_panels, _PANELS_SQL),
    "latency_rollup": (_latency, _LATENCY_SQL),
    "predicted_counts": (
        _predicted_counts, f"{EVENTS} SELECT window_id, predicted_class, count(*) AS n FROM sf GROUP BY ALL",
    ),
    "collector_metrics": (_collector, _COLLECTOR_SQL),
}
