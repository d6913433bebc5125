"""Column sets, fixed values and struct types of the flow data model."""

from pyspark.sql import types as T

# Connection-log field names that carry dots or dashes, and the
# column names used here instead.
FIELD_RENAMES = {
    "id.orig_h": "orig_h",
    "id.orig_p": "orig_p",
    "id.resp_h": "resp_h",
    "id.resp_p": "resp_p",
    "detailed-label": "detailed_label",
    "det_label": "detailed_label",
    "label_val": "label",
}

# Tokens that mean "no value" in a connection log.
MISSING_TOKENS = ("-", "(empty)")
BENIGN = "Benign"

# Column groups of the clean flow table.
FLOAT_COLUMNS = (
    "ts", "duration", "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
)
PORT_COLUMNS = ("orig_p", "resp_p")
DROP_COLUMNS = ("uid", "tunnel_parents", "local_orig", "local_resp")
SCALED_COLUMNS = FLOAT_COLUMNS[1:]

# Connection-log header in file order.
CONN_FIELDS = (
    "ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig",
    "local_resp", "missed_bytes", "history", "orig_pkts", "orig_ip_bytes",
    "resp_pkts", "resp_ip_bytes", "tunnel_parents", "label", "detailed_label",
)
LABEL_COLUMNS = ("tunnel_parents", "label", "detailed_label")

# Responder-port buckets and history letters that become features.
RESP_PORT_BUCKETS = ("well_known", "registered", "dynamic")
HISTORY_FLAGS = "sShHaAdDfFrRcCgGtTwW"
SERVICE_MIN_SHARE = 0.01

# Label taxonomy of the labelled captures, in index order.
TAXONOMY = (
    "Attack", "Benign", "C&C", "C&C-HeartBeat", "DDoS", "Okiru",
    "Okiru-Attack", "PartOfAHorizontalPortScan",
)

# JSON record fields of a live connection record.
JSON_REQUIRED = (
    "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "conn_state",
)
JSON_LABEL_KEYS = ("label", "detailed-label", "detailed_label")
JSON_OPTIONAL_DEFAULTS = {
    "uid": "-", "service": "-", "duration": 0.0, "orig_bytes": 0.0,
    "resp_bytes": 0.0, "local_orig": "-", "local_resp": "-",
    "missed_bytes": 0.0, "history": "-", "orig_pkts": 0.0,
    "orig_ip_bytes": 0.0, "resp_pkts": 0.0, "resp_ip_bytes": 0.0,
    "tunnel_parents": "-",
}

# Names that must not reach a detection store, and fragments that
# must not occur in operational log fields.
FORBIDDEN_FIELDS = (
    "id.orig_h", "id.resp_h", "source_ip", "destination_ip", "raw_ip",
    "features", "edge_attr", "tensor", "ground_truth", "detailed-label",
    "detailed_label", "probabilities",
)
SENSITIVE_FRAGMENTS = (
    "password", "secret", "token", "credential", "raw_ip", "edge_attr",
    "tensor", "private_key", "access_key",
)

# Supervised splits.
SPLITS = ("train", "validation", "test")

# Thresholds of the class-balance reports.
SEVERE_SUPPORT = 30
RARE_SUPPORT = 1000
NEAR_CONSTANT_STD = 1e-8


def _json_type(name):
    if name in ("ts",) or JSON_OPTIONAL_DEFAULTS.get(name) == 0.0:
        return T.DoubleType()
    if name in ("id.orig_p", "id.resp_p"):
        return T.LongType()
    return T.StringType()


JSON_RECORD = T.StructType(
    [
        T.StructField(name, _json_type(name))
        for name in (*JSON_REQUIRED, *JSON_OPTIONAL_DEFAULTS)
    ]
)

# The document a detection store accepts, in field order.
DETECTION_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("window_id", T.StringType()),
        T.StructField("predicted_class", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence_bucket", T.StringType()),
        T.StructField("entropy_bucket", T.StringType()),
        T.StructField("flow_count", T.IntegerType()),
        T.StructField("entity_hash", T.StringType()),
        T.StructField("model_digest", T.StringType()),
        T.StructField("head_digest", T.StringType()),
        T.StructField("schema_digest", T.StringType()),
    ]
)
# Fixed value: the type every stored detection carries.
DETECTION_EVENT_TYPE = "fedper_detection"
DIGEST_FIELDS = ("entity_hash", "model_digest", "head_digest", "schema_digest")
