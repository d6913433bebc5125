"""Routing, alert policy, privacy gate and detection reports.

All expressions work on batch and streaming frames alike.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flows as fx
from ..functions.ordering import exact_quantiles, value_counts
from ..schema import (
    BENIGN,
    DETECTION_EVENT,
    DETECTION_EVENT_TYPE,
    DIGEST_FIELDS,
    FORBIDDEN_FIELDS,
)


def literal_map(mapping):
    """A small fixed mapping as a map literal; nothing is joined."""
    return F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])


def route_sensor(df: DataFrame, routes, mode="fail", sensor="sensor_id") -> DataFrame:
    """Attach the client of each sensor. An unknown sensor is never a default:
    it fails, or with ``mode='quarantine'`` keeps a null client and a reason."""
    client = F.try_element_at(literal_map(routes), F.col(sensor))
    reason = F.concat(F.lit("unknown sensor: "), F.coalesce(sensor, F.lit("null")))
    if mode == "fail":
        return df.withColumn(
            "client_id", F.when(client.isNull(), F.raise_error(reason)).otherwise(client).cast("string")
        )
    return df.withColumns({"client_id": client, "route_error": F.when(client.isNull(), reason)})


def check_policy(threshold, severity):
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("The confidence threshold must be in [0, 1].")
    if not severity or BENIGN in severity:
        raise ValueError("Severity must name attack classes only.")


def apply_alert_policy(
    df: DataFrame, threshold, severity, confidence_bounds, entropy_bounds, entity_key, digests, timestamp=None
) -> DataFrame:
    """Detection events of predictions that pass the policy.

    Benign predictions, low confidence and classes without severity are
    dropped. Needs ``sensor_id, client_id, window_id, predicted_class,
    confidence, entropy, flow_count, entity``; ``digests`` gives the model, head
    and schema digests as columns or text.
    """
    check_policy(threshold, severity)
    level = F.try_element_at(literal_map(severity), F.col("predicted_class"))
    alerts = df.where(
        (F.col("predicted_class") != BENIGN) & (F.col("confidence") >= float(threshold)) & level.isNotNull()
    )

    def column(value):
        return F.lit(value) if isinstance(value, str) else value

    events = alerts.select(
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        F.lit(DETECTION_EVENT_TYPE).alias("event_type"),
        "sensor_id", "client_id", "window_id", "predicted_class", level.alias("severity"),
        fx.numeric_bucket(F.col("confidence"), confidence_bounds).alias("confidence_bucket"),
        fx.numeric_bucket(F.col("entropy"), entropy_bounds).alias("entropy_bucket"),
        F.col("flow_count").cast("int").alias("flow_count"),
        fx.entity_hash(entity_key, F.col("sensor_id"), F.col("entity")).alias("entity_hash"),
        *[column(digests[name]).alias(name) for name in ("model_digest", "head_digest", "schema_digest")],
    )
    return events


def _forbidden(data_type, path):
    if isinstance(data_type, T.StructType):
        for field in data_type:
            here = f"{path}.{field.name}" if path else field.name
            if field.name in FORBIDDEN_FIELDS or here in FORBIDDEN_FIELDS:
                yield here
            yield from _forbidden(field.dataType, here)
    elif isinstance(data_type, T.ArrayType):
        yield from _forbidden(data_type.elementType, path)
    elif isinstance(data_type, T.MapType):
        yield from _forbidden(data_type.valueType, path)


def _map_guards(column, data_type):
    """Conditions that are true when a map holds a forbidden key, at any depth."""
    if isinstance(data_type, T.MapType):
        yield F.exists(F.map_keys(column), lambda k: k.cast("string").isin(*FORBIDDEN_FIELDS))
        for _ in _map_guards(column, data_type.valueType):
            yield F.exists(
                F.map_values(column),
                lambda v: _any(list(_map_guards(v, data_type.valueType))),
            )
            break
    elif isinstance(data_type, T.StructType):
        for field in data_type:
            yield from _map_guards(column.getField(field.name), field.dataType)
    elif isinstance(data_type, T.ArrayType):
        for _ in _map_guards(column, data_type.elementType):
            yield F.exists(column, lambda v: _any(list(_map_guards(v, data_type.elementType))))
            break


def _any(conditions):
    found = F.lit(False)
    for condition in conditions:
        found = found | F.coalesce(condition, F.lit(False))
    return found


def privacy_gate(df: DataFrame) -> DataFrame:
    """Refuse forbidden names at any depth.

    Struct fields are checked when the plan is built, map keys on every row.
    """
    names = list(_forbidden(df.schema, ""))
    if names:
        raise ValueError(f"Forbidden fields: {', '.join(sorted(names))}.")
    guards = [g for f in df.schema for g in _map_guards(F.col(f"`{f.name}`"), f.dataType)]
    if not guards:
        return df
    first = df.columns[0]
    checked = F.when(_any(guards), F.raise_error(F.lit("forbidden key in a map"))).otherwise(F.col(first))
    return df.withColumn(first, checked.cast(df.schema[first].dataType))


def detection_problems(events: DataFrame) -> DataFrame:
    """Events whose digests are not 64 lower-case hex digits or that lack a field."""
    bad = F.lit(False)
    for name in DIGEST_FIELDS:
        bad = bad | ~fx.is_digest(F.col(name))
    for field in DETECTION_EVENT:
        bad = bad | F.col(field.name).isNull()
    return events.where(bad)


def validate_detections(events: DataFrame) -> DataFrame:
    """Exactly the document fields, private names refused, digests checked."""
    wanted = DETECTION_EVENT.fieldNames()
    if sorted(events.columns) != sorted(wanted):
        raise ValueError(f"A detection has the fields {wanted}.")
    ok = F.lit(True)
    for name in DIGEST_FIELDS:
        ok = ok & fx.is_digest(F.col(name))
    checked = F.when(~ok, F.raise_error(F.lit("digest fields must be lower-case SHA-256 hex"))).otherwise(
        F.col("entity_hash")
    )
    return privacy_gate(events).withColumn("entity_hash", checked.cast("string")).select(*wanted)


def detection_rollup(events: DataFrame, width="1 hour", watermark=None) -> DataFrame:
    """Detections per tumbling window, client, class and bucket."""
    source = events.withWatermark("timestamp", watermark) if watermark else events
    rows = source.groupBy(
        F.window("timestamp", width).alias("w"), "client_id", "predicted_class", "severity",
        "confidence_bucket", "entropy_bucket", "head_digest",
    ).agg(F.count(F.lit(1)).alias("detections"), F.sum("flow_count").alias("flows"))
    return rows.select(
        F.col("w.start").alias("window_start"), "client_id", "predicted_class", "severity",
        "confidence_bucket", "entropy_bucket", "head_digest", "detections", "flows",
    )


def detection_panels(scored: DataFrame, alerted, benign, latency, width="1 hour") -> DataFrame:
    """Per tumbling window and client: flows, alert rate, benign false-alert rate, latency p50 and p95.

    A batch report over scored flows with ``timestamp`` and ``client_id``.
    ``alerted`` and ``benign`` are conditions; percentiles of the ``latency``
    column are actual values by nearest rank. Rates are null without flows.
    """
    rows = scored.select(
        F.window("timestamp", width)["start"].alias("window_start"), "client_id",
        alerted.alias("__alert"), benign.alias("__benign"), F.col(latency).alias("__latency"),
    )
    by = ["window_start", "client_id"]
    false_alerts, innocent = F.count_if(F.col("__alert") & F.col("__benign")), F.count_if("__benign")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("__alert").alias("alerts"),
        (F.count_if("__alert") / F.count(F.lit(1))).alias("alert_rate"),
        F.when(innocent > 0, false_alerts / innocent).alias("benign_false_alert_rate"),
    )
    ranks = exact_quantiles(
        value_counts(rows, by, "__latency"), by, "__latency", {"latency_p50": 0.5, "latency_p95": 0.95}, nearest=True
    )
    return counts.join(ranks, by, "left")


def latency_rollup(scored: DataFrame, alerted, latency, width="1 hour", watermark=None, accuracy=10_000) -> DataFrame:
    """Per tumbling window and client: flows, alerts, alert rate, latency p50 and p95; on a stream too.

    The percentiles come from a mergeable quantile sketch: they are actual values whose
    rank is off by at most the window's flows over ``accuracy``. With ``watermark`` a
    stream gives a window out once it is complete. :func:`detection_panels` has exact
    ones for stored rows. Null latencies count as flows but not in percentiles.
    """
    source = scored.withWatermark("timestamp", watermark) if watermark else scored
    found = source.groupBy(F.window("timestamp", width).alias("w"), "client_id").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(alerted).alias("alerts"),
        F.percentile_approx(F.col(latency), [0.5, 0.95], accuracy).alias("ranks"),
    )
    return found.select(
        F.col("w.start").alias("window_start"), "client_id", "flows", "alerts",
        (F.col("alerts") / F.col("flows")).alias("alert_rate"),
        F.try_element_at("ranks", F.lit(1)).alias("latency_p50"), F.try_element_at("ranks", F.lit(2)).alias("latency_p95"),
    )


def predicted_counts(df: DataFrame) -> DataFrame:
    """Labels predicted per emitted window."""
    return df.groupBy("window_id", "predicted_class").agg(F.count(F.lit(1)).alias("n"))
