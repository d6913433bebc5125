"""From emitted windows to stored detections: graph, score, route, alert, write."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, neighbors
from ..operators.features import FittedFeatures, feature_expressions, with_feature_array
from ..session import cut_lineage, temporary_tables
from .alerts import apply_alert_policy, route_sensor, validate_detections

WINDOW = ["sensor_id", "window_id"]


class DetectionModel(NamedTuple):
    """A fitted preprocessor, one head per client, the class names and encoder layers.

    ``layers`` are edge-SAGE weights as in :func:`neighbors.encode_nodes`; without
    them a node's vector is the mean of its incident edges.
    """

    fit: FittedFeatures
    heads: dict
    classes: tuple
    digests: dict
    layers: tuple = ()


class DetectionPolicy(NamedTuple):
    threshold: float
    severity: dict
    confidence_bounds: tuple
    entropy_bounds: tuple
    entity_key: bytes
    routes: dict


def unpack_payload(windows: DataFrame, schema) -> DataFrame:
    """Window rows with the payload's columns in place of its JSON text."""
    parsed = windows.withColumn("__p", F.from_json("payload", schema))
    return parsed.select(*[c for c in windows.columns if c != "payload"], "__p.*")


def window_graph(rows: DataFrame, features, by=WINDOW, sensor="sensor_id", keep=()) -> DataFrame:
    """Edges of every window with namespaced nodes and ids, without labels.

    Rows are window rows with ``orig_h``, ``resp_h`` and feature columns.
    """
    spaced = graph.namespace_nodes(rows, sensor).select(*by, *keep, "orig_h", "resp_h", *features)
    return graph.build_small_edges(spaced, by)


def score_windows(rows: DataFrame, model: DetectionModel, routes) -> DataFrame:
    """Predictions of the flows each window emits for the first time.

    ``rows`` are clean window rows, or have the ``features`` of the model's fit as one
    array already. Every window is a graph of its own, whose nodes are encoded by the
    model's layers; a flow is scored by the head of its sensor's client. All clients are
    scored in one pass.
    """
    kept = ["flow_seq", "is_new", "flow_ts", "entity"]
    named = [*WINDOW, "flow_seq", "is_new", "flow_ts", "orig_h", "resp_h", F.col("orig_h").alias("entity")]
    if "features" in rows.columns:
        featured = rows.select(*named, "features")
    else:
        featured = with_feature_array(rows.select(*named, *feature_expressions(model.fit, rows.columns)), model.fit)
    # Features are one array, which is sorted and moved as one value.
    edges = window_graph(featured, ["features"], keep=kept)
    if model.layers:
        represented = _encoded(cut_lineage(edges), model, kept)
    else:
        carried = ["flow_seq", "flow_ts", "entity"]
        represented = neighbors.represent_small_graphs(edges, WINDOW, "features", "is_new", "flow_count", carried)
    scored = neighbors.score_clients_wide(route_sensor(represented, routes), model.heads, "client_id")
    names = F.array(*[F.lit(c) for c in model.classes])
    return scored.withColumn("predicted_class", F.element_at(names, F.col("pred_idx") + 1))


def _encoded(edges, model, kept):
    """Written edges of windows, new ones only, with ``z`` of nodes encoded by the model's layers."""
    columns = list(model.fit.columns)
    apart = edges.select(*WINDOW, "src", "dst", *[F.col("features")[i].alias(c) for i, c in enumerate(columns)])
    encoded = neighbors.encode_nodes(apart, WINDOW, columns, model.layers)
    vector = F.array(*[F.col(c) for c in neighbors.hidden(len(model.layers[-1]["upd_b"]))])
    nodes = encoded.select(*WINDOW, "node", vector.alias("h_0"))
    sizes = edges.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("flow_count"))
    new = edges.where("is_new").join(sizes, WINDOW)
    carried = [c for c in kept if c != "is_new"] + ["flow_count"]
    represented = neighbors.edge_representation(new, nodes, WINDOW, ["features"], 1, keep=carried, by_end=False)
    parts = [F.col(f"z_{i}").cast("array<double>") for i in range(3)]
    return represented.select(*WINDOW, *carried, F.concat(*parts).alias("z"))


def detections(scored: DataFrame, model: DetectionModel, policy: DetectionPolicy) -> DataFrame:
    """Validated detection documents of scored flows, keyed by window and flow."""
    when = F.timestamp_micros((F.col("flow_ts") * 1e6).cast("long"))
    events = apply_alert_policy(
        scored, policy.threshold, policy.severity, policy.confidence_bounds, policy.entropy_bounds,
        policy.entity_key, model.digests, timestamp=when,
    )
    return validate_detections(events)


def write_detections(events: DataFrame, path, batch_id):
    """Write one micro-batch under its own key, so a replay replaces itself.

    Events are dealt by window and sorted within, so a replay writes the same lines.
    """
    target = f"{path}/batch_id={batch_id}"
    dealt = events.repartition("sensor_id", "window_id").sortWithinPartitions(*events.columns)
    dealt.write.mode("overwrite").json(target)


def start_detection_stream(windows: DataFrame, schema, prepare, model, policy, path, checkpoint, trigger=None):
    """One streaming query: windows to scored flows to stored detections.

    ``windows`` comes from ``rolling_window_stream``; its state crosses micro-batch
    borders. ``prepare`` cleans the unpacked payload rows. Every table that a
    micro-batch writes on the way (its rows, features, nodes, encoder layers) is
    deleted when it ends, also when it fails.
    """

    def process(batch, batch_id):
        with temporary_tables():
            # Written once: every later read of the batch would run the stateful stage again.
            held = cut_lineage(batch)
            scored = score_windows(prepare(unpack_payload(held, schema)), model, policy.routes)
            write_detections(detections(scored, model, policy), path, batch_id)

    writer = windows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
