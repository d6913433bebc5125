"""Live connection records: one JSON object per line, never labelled."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JSON_LABEL_KEYS, JSON_RECORD, JSON_REQUIRED


def _quoted(names):
    return F.array(*[F.lit(n) for n in names])


def parse_zeek_json(lines: DataFrame, column="value", carry=(), mode="quarantine") -> DataFrame:
    """Parsed records with ``record_error``; ``mode='fail'`` raises instead.

    A record is refused when it is no JSON object, holds a label key, or lacks
    a required field. Blank lines are skipped. A failing run names the place of
    the record, if ``carry`` has one, and never its content, which holds addresses.
    """
    text = F.col(column)
    keys = F.json_object_keys(text)
    labels = F.array_intersect(F.array_sort("__keys"), _quoted(JSON_LABEL_KEYS))
    missing = F.array_except(_quoted(JSON_REQUIRED), F.col("__keys"))
    error = (
        F.when(F.col("__keys").isNull(), F.lit("invalid record"))
        .when(F.size(labels) > 0, F.concat(F.lit("label keys: "), F.concat_ws(",", labels)))
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.concat_ws(",", missing)))
    )
    if mode == "fail":
        place = F.concat_ws(":", *[F.col(c).cast("string") for c in carry]) if carry else F.lit("the input")
        error = F.when(error.isNotNull(), F.raise_error(F.concat(error, F.lit(" in "), place)))
    parsed = lines.where(F.trim(text) != "").select(
        *carry, keys.alias("__keys"),
        F.from_json(text, JSON_RECORD).alias("__r"),
    )
    return parsed.select(
        *carry,
        *[F.col("__r").getField(f.name).alias(f.name.removeprefix("id.")) for f in JSON_RECORD],
        error.cast("string").alias("record_error"),
    )


def read_zeek_json(spark: SparkSession, path, streaming=False, mode="quarantine", **options):
    """JSON-lines records from files, as a batch or as a stream of new files."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").options(**options).load(path)
    if mode != "fail":
        return parse_zeek_json(lines, mode=mode)
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")
    )
    return parse_zeek_json(placed, mode=mode, carry=["__file", "__block"]).drop("__file", "__block")


def observed_requests_to_flows(requests: DataFrame) -> DataFrame:
    """HTTP access rows as flow-shaped rows.

    Expects ``source_host, source_port, target_host, target_port,
    request_bytes, response_bytes, started_at, ended_at`` and ``uid``. One
    packet each way, byte counts and duration never negative.
    """
    sent = F.greatest(F.col("request_bytes"), F.lit(0))
    received = F.greatest(F.col("response_bytes"), F.lit(0))
    # What an observed request looks like as a flow.
    return requests.select(
        F.col("started_at").alias("ts"),
        F.concat(F.lit("ingress-"), F.col("uid")).alias("uid"),
        F.col("source_host").alias("orig_h"),
        F.col("source_port").alias("orig_p"),
        F.col("target_host").alias("resp_h"),
        F.col("target_port").alias("resp_p"),
        F.lit("tcp").alias("proto"),
        F.lit("http").alias("service"),
        F.greatest(F.lit(0.0), F.col("ended_at") - F.col("started_at")).alias("duration"),
        sent.alias("orig_bytes"),
        received.alias("resp_bytes"),
        F.lit("SF").alias("conn_state"),
        F.lit("-").alias("local_orig"),
        F.lit("-").alias("local_resp"),
        F.lit(0).alias("missed_bytes"),
        F.lit("ShADadFf").alias("history"),
        F.lit(1).alias("orig_pkts"),
        sent.alias("orig_ip_bytes"),
        F.lit(1).alias("resp_pkts"),
        received.alias("resp_ip_bytes"),
        F.lit("-").alias("tunnel_parents"),
    )
