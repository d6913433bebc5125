"""Sources and cleaning over the flow view."""

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cleaning, features
from ..schema import CONN_FIELDS, TAXONOMY
from ..session import checkpoint_dir
from ..sources import conn_log, zeek_json
from . import views
from .views import CLEAN_FLOWS, LABELLED_FLOWS, RAW_FLOWS

HEADER = (*CONN_FIELDS[:-3], "tunnel_parents   label   detailed-label")
BASE = f"WITH {RAW_FLOWS}"
CLEANED = f"{BASE},\n{CLEAN_FLOWS}"
LABELLED = f"{BASE},\n{LABELLED_FLOWS}"


def _log_line(first):
    """A flow as a log line with its first fields in the order of ``first``; every
    23rd line has a field too many and every 29th lacks its last two fields."""
    label = F.concat_ws("   ", "tunnel_parents", "label", F.trim("detailed_label"))
    body = F.concat_ws("\t", *first, CONN_FIELDS[-4], label)
    return (
        F.when(F.col("seq") % 23 == 0, F.concat(body, F.lit("\textra")))
        .when(F.col("seq") % 29 == 0, F.concat_ws("\t", *first)).otherwise(body)
    )


def _log_lines(spark, sf_dir):
    """The flow view as lines of one log, with comments in between."""
    flows = views.raw_flows(spark, sf_dir)
    comment = F.when(F.col("seq") % 31 == 0, F.lit("#comment"))
    lines = F.array_compact(F.array(comment, _log_line(CONN_FIELDS[:-4])))
    return flows.select(F.explode(lines).alias("value"))


def _log_files(spark, sf_dir):
    """The flow view written as log files by scenario; every other task writes
    its files with another order of fields, each under its own header."""
    orders = [CONN_FIELDS[:-4], tuple(reversed(CONN_FIELDS[:-4]))]
    headers = ["\t".join(["#fields", *first, *HEADER[-2:]]) for first in orders]
    lines = views.raw_flows(spark, sf_dir).select("scenario", *[_log_line(f).alias(f"line_{i}") for i, f in enumerate(orders)])

    def write(batches):
        kind = TaskContext.get().partitionId() % 2
        for batch in batches:
            names = batch["scenario"].unique()
            yield pa.record_batch({"scenario": names, "value": pa.array([headers[kind]] * len(names), pa.string())})
            yield pa.record_batch({"scenario": batch["scenario"], "value": batch[f"line_{kind}"]})

    folder = f"{checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    dealt = lines.repartition(4)
    dealt.mapInArrow(write, "scenario string, value string").write.partitionBy("scenario").text(folder)
    return folder


def _read_log(spark, sf_dir):
    return conn_log.read_conn_log(spark, f"{_log_files(spark, sf_dir)}/*").select(*CONN_FIELDS)


def _ordered_logs(spark, rows):
    """Rows (scenario, seq, value) as one log file per scenario, in order of ``seq``."""
    folder = f"{checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    dealt = rows.repartition("scenario").sortWithinPartitions("scenario", "seq", "part")
    dealt.select("scenario", "value").write.partitionBy("scenario").text(folder)
    return f"{folder}/*"


def _changing_headers(spark, sf_dir):
    """Logs whose fields change their order after every hundred rows, each time under a new header."""
    orders = [CONN_FIELDS[:-4], tuple(reversed(CONN_FIELDS[:-4]))]
    headers = ["\t".join(["#fields", *first, *HEADER[-2:]]) for first in orders]
    block = F.floor(F.col("seq") / 100)
    even = block % 2 == 0
    flows = views.raw_flows(spark, sf_dir).withColumn(
        "place", F.row_number().over(Window.partitionBy("scenario", block).orderBy("seq"))
    )
    line = F.when(even, _log_line(orders[0])).otherwise(_log_line(orders[1]))
    lines = F.array(F.when(F.col("place") == 1, F.when(even, headers[0]).otherwise(headers[1])), line)
    rows = flows.select("scenario", "seq", F.posexplode(lines).alias("part", "value")).where("value is not null")
    return conn_log.read_conn_log(spark, _ordered_logs(spark, rows)).select(*CONN_FIELDS)


def _file_positions(spark, sf_dir):
    """Rows of written logs with their place in the file, and the identity made of it."""
    flows = views.raw_flows(spark, sf_dir).select("scenario", "seq", F.lit(0).alias("part"), F.col("uid").alias("value"))
    lines = spark.read.text(_ordered_logs(spark, flows)).withColumn(
        "scenario", F.regexp_extract("_metadata.file_path", "scenario=([^/]+)", 1)
    )
    placed = conn_log.with_stable_row_id(conn_log.with_file_position(lines), "scenario", "position")
    return placed.select(F.col("value").alias("uid"), "position", "row_id")


_GOOD = "seq % 23 <> 0"
_SHORT = "seq % 29 = 0"


def _log_field(name):
    if name in ("resp_ip_bytes", "tunnel_parents", "label"):
        return f"CASE WHEN {_SHORT} THEN NULL ELSE {name} END AS {name}"
    if name == "detailed_label":
        return f"CASE WHEN {_SHORT} THEN NULL ELSE trim({name}) END AS {name}"
    return name


def _bad_lines(spark, sf_dir):
    return conn_log.count_bad_lines(_log_lines(spark, sf_dir), HEADER)


def _quarantine(spark, sf_dir):
    lines = conn_log.bad_lines(_log_lines(spark, sf_dir), HEADER)
    return lines.groupBy(F.split("value", "\t")[1].alias("uid")).agg(F.count(F.lit(1)).alias("n"))


def _split_labels(spark, sf_dir):
    flows = views.raw_flows(spark, sf_dir)
    combined = flows.select(
        "seq", F.concat_ws("   ", "tunnel_parents", "label", F.trim("detailed_label")).alias("all labels")
    )
    return conn_log.split_label_column(combined)


def _json_lines(spark, sf_dir):
    """Live records of the flow view. Some hold a label key, lack a required
    field, carry an unknown field, or are no JSON at all."""
    flows = cleaning.null_missing_tokens(views.raw_flows(spark, sf_dir))
    i = F.col("seq")
    record = F.to_json(
        F.struct(
            F.col("ts").cast("decimal(20,6)").alias("ts"),
            F.col("uid"),
            F.when(i % 37 != 0, F.col("orig_h")).alias("id.orig_h"),
            F.col("orig_p").cast("long").alias("id.orig_p"),
            F.col("resp_h").alias("id.resp_h"),
            F.col("resp_p").cast("long").alias("id.resp_p"),
            F.col("proto"),
            F.coalesce("conn_state", F.lit("OTH")).alias("conn_state"),
            F.col("service"),
            F.col("orig_bytes").cast("decimal(20,0)").alias("orig_bytes"),
            F.when(i % 41 == 0, F.lit("Malicious")).alias("label"),
            F.when(i % 43 == 0, F.lit(1)).alias("extra"),
        )
    )
    return flows.select("seq", F.when(i % 47 == 0, F.lit("not json")).otherwise(record).alias("value"))


def _read_json(spark, sf_dir):
    parsed = zeek_json.parse_zeek_json(_json_lines(spark, sf_dir), carry=["seq"])
    return parsed.select(
        "seq", F.when(F.col("record_error").isNull(), F.col("orig_h")).alias("orig_h"),
        F.when(F.col("record_error").isNull(), F.col("resp_p")).alias("resp_p"),
        F.when(F.col("record_error").isNull(), F.col("orig_bytes")).alias("orig_bytes"),
        "record_error",
    )


_READ_JSON_SQL = f"""{BASE}, e AS (
  SELECT *, CASE WHEN seq % 47 = 0 THEN 'invalid record' WHEN seq % 41 = 0 THEN 'label keys: label'
    WHEN seq % 37 = 0 THEN 'missing fields: id.orig_h' END AS record_error FROM raw_flows)
SELECT seq, CASE WHEN record_error IS NULL THEN orig_h END AS orig_h,
  CASE WHEN record_error IS NULL THEN CAST(resp_p AS BIGINT) END AS resp_p,
  CASE WHEN record_error IS NULL THEN TRY_CAST(orig_bytes AS DOUBLE) END AS orig_bytes, record_error FROM e"""


def _production_schema(spark, sf_dir):
    parsed = cleaning.apply_production_schema(_json_lines(spark, sf_dir))
    good = F.col("schema_error").isNull()
    return parsed.groupBy("schema_error").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(good & (F.col("service") == "-")).alias("default_service"),
        F.sum(F.when(good, F.col("orig_bytes"))).alias("orig_bytes"),
    )


_PRODUCTION_SQL = f"""{BASE}, e AS (
  SELECT *, CASE WHEN seq % 47 = 0 THEN 'not a JSON object'
    WHEN seq % 41 = 0 AND seq % 43 = 0 THEN 'unknown fields: extra,label'
    WHEN seq % 41 = 0 THEN 'unknown fields: label' WHEN seq % 43 = 0 THEN 'unknown fields: extra'
    WHEN seq % 37 = 0 THEN 'missing fields: id.orig_h' END AS schema_error FROM raw_flows)
SELECT schema_error, count(*) AS n,
  count(*) FILTER (schema_error IS NULL AND service = '-') AS default_service,
  sum(CASE WHEN schema_error IS NULL THEN coalesce(TRY_CAST(orig_bytes AS DOUBLE), 0) END) AS orig_bytes
FROM e GROUP BY schema_error"""


def _scan_scenarios(spark, sf_dir):
    """All logs in one scan, each file by its own header."""
    folder = _log_files(spark, sf_dir)
    rows = conn_log.scan_scenarios(spark, {name: f"{folder}/scenario={name}" for name in views.SENSORS})
    return rows.groupBy("scenario", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.try_to_number("resp_p", F.lit("99999"))).cast("long").alias("ports"),
    )


def _row_ids(spark, sf_dir):
    flows = views.raw_flows(spark, sf_dir).select("seq", "scenario")
    return conn_log.with_stable_row_id(flows, "scenario", "seq").select("seq", "row_id")


def _requests(spark, sf_dir):
    """Flow view rows seen as HTTP access rows."""
    flows = cleaning.cast_numbers(cleaning.null_missing_tokens(views.raw_flows(spark, sf_dir)))
    requests = flows.select(
        "uid", F.col("orig_h").alias("source_host"), F.col("orig_p").alias("source_port"),
        F.col("resp_h").alias("target_host"), F.col("resp_p").alias("target_port"),
        (F.col("orig_ip_bytes") - 100).alias("request_bytes"),
        (F.col("resp_ip_bytes") - 100).alias("response_bytes"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.col("duration") - 5).alias("ended_at"),
    )
    rows = zeek_json.observed_requests_to_flows(requests)
    return rows.withColumn("ts", F.round("ts", 3)).withColumn("duration", F.round("duration", 2))


_REQUESTS_SQL = f"""{BASE} SELECT round(CAST(ts AS DOUBLE), 3) AS ts, 'ingress-' || uid AS uid, orig_h,
  CAST(orig_p AS BIGINT) AS orig_p, resp_h, CAST(resp_p AS BIGINT) AS resp_p, 'tcp' AS proto,
  'http' AS service, round(greatest(0, CAST(duration AS DOUBLE) - 5), 2) AS duration,
  greatest(CAST(orig_ip_bytes AS DOUBLE) - 100, 0) AS orig_bytes,
  greatest(CAST(resp_ip_bytes AS DOUBLE) - 100, 0) AS resp_bytes, 'SF' AS conn_state,
  '-' AS local_orig, '-' AS local_resp, 0 AS missed_bytes, 'ShADadFf' AS history, 1 AS orig_pkts,
  greatest(CAST(orig_ip_bytes AS DOUBLE) - 100, 0) AS orig_ip_bytes, 1 AS resp_pkts,
  greatest(CAST(resp_ip_bytes AS DOUBLE) - 100, 0) AS resp_ip_bytes, '-' AS tunnel_parents FROM raw_flows"""


def _canonical_label(spark, sf_dir):
    labelled = cleaning.canonicalise_label(views.raw_flows(spark, sf_dir))
    return labelled.groupBy("scenario", "detailed_label").agg(F.count(F.lit(1)).alias("n"))


def _drop_identifiers(spark, sf_dir):
    return cleaning.drop_identifiers(views.raw_flows(spark, sf_dir))


def _null_tokens(spark, sf_dir):
    return cleaning.null_missing_tokens(views.raw_flows(spark, sf_dir)).select(
        "seq", "service", "orig_bytes", "resp_bytes", "conn_state", "history", "local_orig",
        "tunnel_parents", "detailed_label",
    )


_NULL_SQL = f"{BASE} SELECT seq, " + ", ".join(
    f"CASE WHEN {c} IN ('-', '(empty)') THEN NULL ELSE {c} END AS {c}"
    for c in ("service", "orig_bytes", "resp_bytes", "conn_state", "history", "local_orig",
              "tunnel_parents", "detailed_label")
) + " FROM raw_flows"


def _casts(spark, sf_dir):
    """Numbers as text, some with a type suffix, a word, or a decimal port."""
    flows = views.raw_flows(spark, sf_dir)
    i = F.col("seq")
    odd = flows.select(
        "seq",
        F.when(i % 6 == 0, F.concat("orig_bytes", F.lit("d"))).when(i % 6 == 1, F.lit("inf"))
        .when(i % 6 == 2, F.concat("orig_bytes", F.lit("e1"))).otherwise(F.col("orig_bytes")).alias("orig_bytes"),
        F.when(i % 3 == 0, F.concat("orig_p", F.lit(".0"))).otherwise(F.col("orig_p")).alias("orig_p"),
    )
    return cleaning.cast_numbers(odd)


_CASTS_SQL = f"""{BASE} SELECT seq,
  CASE WHEN seq % 6 IN (0, 1) OR orig_bytes = '-' THEN NULL
    WHEN seq % 6 = 2 THEN CAST(orig_bytes AS DOUBLE) * 10 ELSE CAST(orig_bytes AS DOUBLE) END AS orig_bytes,
  CAST(orig_p AS BIGINT) AS orig_p FROM raw_flows"""


def _clean(spark, sf_dir):
    flows = views.clean_flows(spark, sf_dir)
    return flows.withColumn("ts", F.round("ts", 3))


def _align(spark, sf_dir):
    """Chunks of the clean view with different columns, merged by name."""
    flows = views.clean_flows(spark, sf_dir).select(
        "seq", "scenario", "duration", "resp_p", "orig_bytes_missing", "proto"
    )
    even = flows.where(F.col("proto") == "tcp").drop("duration", "resp_p")
    odd = flows.where(F.col("proto") == "udp").drop("orig_bytes_missing")
    return cleaning.align_union([even, odd])


_ALIGN_SQL = f"""{CLEANED} SELECT seq, scenario, proto,
  CASE WHEN proto = 'udp' THEN duration END AS duration, CASE WHEN proto = 'udp' THEN resp_p ELSE 0 END AS resp_p,
  CASE WHEN proto = 'tcp' THEN orig_bytes_missing ELSE 0 END AS orig_bytes_missing FROM clean_flows"""


def _profile(spark, sf_dir):
    return cleaning.profile_missing(views.raw_flows(spark, sf_dir).drop("scenario"))


_PROFILED = ("seq", *CONN_FIELDS)
_PROFILE_SQL = f"{BASE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, "
    f"count(*) FILTER (CAST({c} AS VARCHAR) = '-') AS n_dash, "
    f"count(*) FILTER (CAST({c} AS VARCHAR) = '(empty)') AS n_empty FROM raw_flows"
    for c in _PROFILED
)


def _label_counts(spark, sf_dir):
    return cleaning.label_counts(views.labelled_flows(spark, sf_dir))


def _flow_ids(spark, sf_dir):
    flows = views.raw_flows(spark, sf_dir).withColumn(
        "uid", F.when(F.col("seq") % 3 == 0, "-").when(F.col("seq") % 3 == 1, "").otherwise(F.col("uid"))
    )
    return cleaning.with_flow_id(flows).select("seq", "flow_id")


def _unknown_labels(spark, sf_dir):
    return features.unknown_labels(views.labelled_flows(spark, sf_dir), TAXONOMY)


def _event_log_lines(spark, sf_dir):
    """Operational events rendered from the events table; some hide a name 3, 9 or 30 levels deep."""
    events = views.table(spark, sf_dir, "events")
    i = F.col("event_id")

    def hidden(levels):
        return F.lit('"user":' + '{"a":' * levels + '[{"Password":1}]' + "}" * levels + ',"user":')

    plain = F.lit('"user":')
    deep = F.when(i % 67 == 0, hidden(3)).when(i % 71 == 0, hidden(9)).when(i % 73 == 0, hidden(30)).otherwise(plain)
    rows = events.select(
        deep.alias("deep"),
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                F.when(i % 9 == 0, "WARNING").otherwise("INFO").alias("level"),
                F.col("event_type").alias("event"),
                F.struct(
                    F.when(i % 59 == 0, F.lit("x")).alias("api_token"),
                    F.when(i % 61 == 0, F.sequence(F.lit(1), F.lit(101))).alias("items"),
                    F.col("user_id").alias("user"),
                ).alias("fields"),
            )
        ).alias("value"),
    )
    return rows.select(F.replace("value", plain, F.col("deep")).alias("value"))


def _event_log(spark, sf_dir):
    from ..sources.logs import parse_event_log

    parsed = parse_event_log(_event_log_lines(spark, sf_dir))
    return parsed.groupBy("level", "event", "event_error").agg(F.count(F.lit(1)).alias("n"))


_EVENT_LOG_SQL = """SELECT CASE WHEN event_id % 9 = 0 THEN 'WARNING' ELSE 'INFO' END AS level,
  event_type AS event, CASE WHEN event_id % 59 = 0 THEN 'sensitive field: api_token'
    WHEN event_id % 67 = 0 OR event_id % 71 = 0 OR event_id % 73 = 0 THEN 'sensitive field: Password'
    WHEN event_id % 61 = 0 THEN 'field too large: items' END AS event_error, count(*) AS n
FROM events GROUP BY ALL"""


QUERIES = {
    "read_changing_headers": (
        _changing_headers, f"{BASE} SELECT {', '.join(_log_field(c) for c in CONN_FIELDS)} FROM raw_flows WHERE {_GOOD}",
    ),
    "read_conn_log": (
        _read_log, f"{BASE} SELECT {', '.join(_log_field(c) for c in CONN_FIELDS)} FROM raw_flows WHERE {_GOOD}",
    ),
    "count_bad_lines": (
        _bad_lines,
        f"{BASE} SELECT count(*) FILTER ({_GOOD}) AS parsed_rows, count(*) FILTER (NOT ({_GOOD})) AS parse_error_rows FROM raw_flows",
    ),
    "quarantine_bad_lines": (
        _quarantine, f"{BASE} SELECT uid, count(*) AS n FROM raw_flows WHERE NOT ({_GOOD}) GROUP BY uid",
    ),
    "split_label_column": (
        _split_labels, f"{BASE} SELECT seq, tunnel_parents, label, trim(detailed_label) AS detailed_label FROM raw_flows",
    ),
    "read_zeek_json": (_read_json, _READ_JSON_SQL),
    "scan_scenarios": (
        _scan_scenarios,
        f"""{BASE} SELECT scenario, CASE WHEN {_SHORT} THEN NULL ELSE label END AS label, count(*) AS n,
  CAST(sum(CAST(resp_p AS BIGINT)) AS BIGINT) AS ports FROM raw_flows WHERE {_GOOD} GROUP BY ALL""",
    ),
    "stable_row_id": (
        _row_ids,
        f"{BASE} SELECT seq, sha256('phase1-clean-v1:' || scenario || ':' || seq) AS row_id FROM raw_flows",
    ),
    "file_position": (
        _file_positions,
        f"""{BASE}, p AS (SELECT uid, scenario, row_number() OVER (PARTITION BY scenario ORDER BY seq) - 1 AS position FROM raw_flows)
SELECT uid, position, sha256('phase1-clean-v1:' || scenario || ':' || position) AS row_id FROM p""",
    ),
    "observed_requests_to_flows": (_requests, _REQUESTS_SQL),
    "read_event_log": (_event_log, _EVENT_LOG_SQL),
    "canonical_label": (
        _canonical_label,
        f"{LABELLED} SELECT scenario, detailed_label, count(*) AS n FROM labelled_flows GROUP BY ALL",
    ),
    "drop_identifiers": (
        _drop_identifiers,
        f"{BASE} SELECT * EXCLUDE (uid, tunnel_parents, local_orig, local_resp) FROM raw_flows",
    ),
    "null_missing_tokens": (_null_tokens, _NULL_SQL),
    "lenient_numeric_cast": (_casts, _CASTS_SQL),
    "clean_flows": (_clean, f"{CLEANED} SELECT * REPLACE (round(ts, 3) AS ts) FROM clean_flows"),
    "align_union": (_align, _ALIGN_SQL),
    "profile_missing": (_profile, _PROFILE_SQL),
    "label_value_counts": (
        _label_counts, f"{LABELLED} SELECT detailed_label, count(*) AS n FROM labelled_flows GROUP BY ALL",
    ),
    "apply_production_schema": (_production_schema, _PRODUCTION_SQL),
    "flow_id": (
        _flow_ids,
        f"{BASE} SELECT seq, CASE WHEN seq % 3 = 2 THEN uid ELSE orig_h || ':' || orig_p || '->' || resp_h || ':' || resp_p END AS flow_id FROM raw_flows",
    ),
    "union_label_check": (
        _unknown_labels,
        f"{LABELLED} SELECT detailed_label, count(*) AS n FROM labelled_flows WHERE detailed_label NOT IN {TAXONOMY!r} GROUP BY ALL",
    ),
}
