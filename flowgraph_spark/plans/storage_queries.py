"""Tables written to the shared folder and read back."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, splitting
from ..schema import CONN_FIELDS
from ..session import checkpoint_dir, cut_lineage
from ..sources import tables
from ..streaming import alerts, detect
from . import views, window_queries
from .flow_queries import BASE, LABELLED
from .split_queries import EDGES, SPLIT_LABELLED, split_labelled
from .graph_queries import NODE_IDS


HEADER_COLUMNS = CONN_FIELDS
HEADER = (*CONN_FIELDS[:-1], "detailed-label")


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _manifest(spark, sf_dir):
    rows = tables.canonical_manifest(views.labelled_flows(spark, sf_dir))
    return rows.select(
        "scenario", "parsed_rows", F.size("label_counts").alias("labels"),
        F.col("label_counts")["Benign"].alias("benign_rows"),
    )


def _cache(spark, sf_dir):
    """Logs of four scenarios are cached; two more come and one grows: only these three are parsed."""
    flows = views.raw_flows(spark, sf_dir)
    header = F.lit("\t".join(["#fields", *HEADER]))
    line = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("-")) for c in HEADER_COLUMNS])
    place = F.row_number().over(Window.partitionBy("scenario").orderBy("seq"))
    both = F.array(F.when(F.col("place") == 1, header), line)
    lines = flows.withColumn("place", place).select("scenario", "seq", F.posexplode(both).alias("part", "value"))
    lines = cut_lineage(lines.where("value is not null"))
    source, cache = _folder(spark, "logs"), _folder(spark, "cache")

    def write(rows, mode):
        dealt = rows.repartition("scenario").sortWithinPartitions("scenario", "seq", "part")
        dealt.select("scenario", "value").write.mode(mode).partitionBy("scenario").text(source)

    late = F.col("scenario").isin(*views.SENSORS[4:])
    growing = F.col("scenario") == views.SENSORS[0]
    write(lines.where(~late & (~growing | (F.col("seq") % 2 == 0) | (F.col("part") == 0))), "append")
    tables.canonical_files(spark, f"{source}/*", cache)
    # The log of one scenario is replaced by a longer one; its old file is gone.
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    write(lines.where(late | growing), "overwrite")
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    rows, report = tables.canonical_files(spark, f"{source}/*", cache)
    scenario = F.regexp_extract("path", "scenario=([^/]+)", 1)
    counted = report.groupBy(scenario.alias("scenario"), "status").agg(F.sum("rows").alias("recorded_rows"))
    read = rows.groupBy(F.regexp_extract("source_file", "scenario=([^/]+)", 1).alias("scenario")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("ts").alias("timed"), F.sum("resp_ip_bytes").alias("bytes")
    )
    return counted.join(read, "scenario")


def _replay(spark, sf_dir):
    """Held-out rows written as gzip JSON lines, read back and counted."""
    rows = splitting.heldout_rows(split_labelled(spark, sf_dir), "signup").select(
        F.col("scenario").alias("client"), "split", "detailed_label", F.col("seq").alias("source_edge_index"),
    )
    folder = _folder(spark, "replay")
    held = cut_lineage(rows)
    tables.write_labelled_replay(held, folder)
    back, mismatches = tables.read_labelled_replay(spark, folder, held.schema)
    wrong = mismatches.agg(F.count(F.lit(1))).scalar()
    return back.groupBy("client", "split", "detailed_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("source_edge_index").alias("ordinals"),
    ).withColumn("mismatched_groups", wrong)


_REPLAY_SQL = f"""{SPLIT_LABELLED} SELECT scenario AS client, split, detailed_label, count(*) AS rows, sum(seq) AS ordinals,
  0 AS mismatched_groups FROM split_labelled WHERE split <> 'train' AND detailed_label <> 'signup' GROUP BY ALL"""


def _graph_tables(spark, sf_dir):
    # The cuts are known by now: a row finds its split on its own, so each reader does without a table.
    rows = views.split_edges(spark, sf_dir)
    nodes = graph.node_dictionary(rows, ["scenario"])
    edges = graph.build_edges(rows, nodes, ["scenario"])
    folder = _folder(spark, "graph")
    tables.write_graph_tables(nodes, edges, folder, ["scenario"])
    _, stored, _ = tables.read_graph_tables(spark, folder)
    return stored.groupBy("scenario", "split").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum")
    )


_GRAPH_TABLES_SQL = f"""{EDGES}, {NODE_IDS} SELECT e.scenario, split, count(*) AS edges, sum(a.node_id) AS src_sum, sum(b.node_id) AS dst_sum
FROM split_edges e JOIN node_ids a ON a.scenario = e.scenario AND a.node = orig_h
JOIN node_ids b ON b.scenario = e.scenario AND b.node = resp_h GROUP BY ALL"""


def _detections(spark, sf_dir):
    """Detections written twice under one micro-batch key: a replay replaces itself."""
    events = cut_lineage(alerts.validate_detections(window_queries.events(spark, sf_dir)))
    folder = _folder(spark, "detections")
    for _ in range(2):
        detect.write_detections(events, folder, 0)
    stored = spark.read.schema(events.schema).json(folder)
    return stored.groupBy("client_id", "severity").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "canonical_manifest": (
        _manifest,
        f"""{LABELLED} SELECT scenario, count(*) AS parsed_rows, count(DISTINCT detailed_label) AS labels,
  count(*) FILTER (detailed_label = 'Benign') AS benign_rows FROM labelled_flows GROUP BY scenario""",
    ),
    "canonical_files": (
        _cache,
        f"""{BASE} SELECT scenario, CASE WHEN scenario IN ('sensor-0', 'sensor-4', 'sensor-5') THEN 'PARSED' ELSE 'HIT' END AS status,
  count(*) AS recorded_rows, count(*) AS rows, count(*) AS timed, sum(CAST(resp_ip_bytes AS DOUBLE)) AS bytes FROM raw_flows GROUP BY scenario""",
    ),
    "labelled_replay": (_replay, _REPLAY_SQL),
    "graph_tables": (_graph_tables, _GRAPH_TABLES_SQL),
    "write_detections": (
        _detections, f"{window_queries.EVENTS} SELECT client_id, severity, count(*) AS n FROM ev GROUP BY ALL",
    ),
}
