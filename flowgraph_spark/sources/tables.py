"""Canonical tables, replay sets and graph tables on storage."""

import hashlib
import inspect
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import membership_digest
from ..operators import cleaning
from ..schema import CONN_FIELDS, FLOAT_COLUMNS, MISSING_TOKENS, PORT_COLUMNS
from ..session import cut_lineage
from . import conn_log

CLEANING_VERSION = 1


def source_fingerprint(spark: SparkSession, path):
    """Identity of a log: every file's path, size and time, the parsing code and the schema contract.

    Only file metadata is read. The digests of the files are summed, so neither
    their order nor their number matters to the driver.
    """
    totals = membership_digest(file_identities(spark, path), [], F.col("key")).first()
    return hashlib.sha256(json.dumps([totals["n_rows"], totals["digest"], contract_digest()]).encode()).hexdigest()


def canonical_manifest(clean: DataFrame, scenario="scenario", label="detailed_label") -> DataFrame:
    """Row and label counts per scenario."""
    counts = clean.groupBy(scenario, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(scenario).agg(
        F.sum("n").alias("parsed_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("label_counts"),
    )


def _exists(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_canonical(spark: SparkSession, path, scenario, directory, build):
    """Clean table of a log, reused while its fingerprint is unchanged.

    ``build()`` makes the clean frame. Returns the table and HIT or MISS. A
    change of the log, the schema or the cleaning version gives a new folder.
    """
    target = f"{directory}/scenario={scenario}/{source_fingerprint(spark, path)}"
    if _exists(spark, f"{target}/manifest/_SUCCESS"):
        return spark.read.parquet(f"{target}/rows"), "HIT"
    build().write.mode("overwrite").option("compression", "snappy").parquet(f"{target}/rows")
    rows = spark.read.parquet(f"{target}/rows")
    manifest = canonical_manifest(rows.withColumn("scenario", F.lit(scenario)))
    # One row; written last, so it marks a complete table.
    manifest.write.mode("overwrite").parquet(f"{target}/manifest")
    return rows, "MISS"


def contract_digest():
    """Digest of the parsing and cleaning code and of the schema contract."""
    contract = [CLEANING_VERSION, list(CONN_FIELDS), list(FLOAT_COLUMNS), list(PORT_COLUMNS), list(MISSING_TOKENS)]
    code = "".join(inspect.getsource(module) for module in (conn_log, cleaning))
    return hashlib.sha256(json.dumps([hashlib.sha256(code.encode()).hexdigest(), contract]).encode()).hexdigest()


def file_identities(spark: SparkSession, path) -> DataFrame:
    """``path`` and ``key`` of every file: its path, size and time. Contents are not read."""
    facts = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("length").cast("string").alias("size"),
        F.unix_micros("modificationTime").cast("string").alias("time"),
    )
    return facts.select("path", F.sha2(F.concat_ws("\u0001", "path", "size", "time"), 256).alias("key"))


def canonical_files(spark: SparkSession, path, directory, clean=cleaning.clean):
    """Clean rows of many log files, of which only new and changed ones are parsed.

    Returns the rows of the files that are there now, with ``source_file``, and a report
    ``path, status, rows`` with status HIT or PARSED. Each file is a partition of the table
    under its identity. Rows are written first and the record that makes them count
    after them, so a job that stops in between parses those files again. Code or schema
    that changed begin a new table. A file that is gone is no longer read; its rows stay
    on storage. Without files the rows are an error, as there is no header.
    """
    base = f"{directory}/{contract_digest()}"
    present = cut_lineage(file_identities(spark, path))
    if _exists(spark, f"{base}/files"):
        recorded = spark.read.parquet(f"{base}/files").select("key", "rows").dropDuplicates(["key"])
    else:
        recorded = spark.createDataFrame([], "key string, rows long")
    missing = cut_lineage(present.join(recorded, "key", "left_anti"))
    # As many paths as files changed; the file scan lists them on the driver as well.
    changed = [row["path"] for row in missing.select("path").collect()]
    if changed:
        lines = conn_log.file_lines(spark, changed)
        rows = clean(conn_log.parse_files(lines, ["__file"])).withColumnRenamed("__file", "source_file")
        keyed = rows.join(missing.select(F.col("path").alias("source_file"), "key"), "source_file")
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{base}/rows")
        counts = spark.read.parquet(f"{base}/rows").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        done = missing.join(counts, "key", "left").select("key", "path", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
        done.write.mode("append").parquet(f"{base}/files")
    stored = spark.read.option("mergeSchema", "true").parquet(f"{base}/rows")
    counts = spark.read.parquet(f"{base}/files").select("key", "rows").dropDuplicates(["key"])
    parsed = missing.select("key", F.lit("PARSED").alias("status"))
    report = present.join(parsed, "key", "left").join(counts, "key", "left").select(
        "path", F.coalesce("status", F.lit("HIT")).alias("status"), "rows"
    )
    return stored.join(present.select("key"), "key", "left_semi").drop("key"), report


def write_labelled_replay(heldout: DataFrame, directory, client="client"):
    """Held-out rows as gzip JSON lines by client and split, with their counts."""
    heldout.write.mode("errorifexists").partitionBy(client, "split").option("compression", "gzip").json(
        f"{directory}/rows"
    )
    counts = heldout.groupBy(client, "split", "detailed_label").agg(F.count(F.lit(1)).alias("rows"))
    counts.write.mode("errorifexists").parquet(f"{directory}/counts")


def read_labelled_replay(spark: SparkSession, directory, schema, client="client"):
    """Rows of a replay set and the groups whose count is not the recorded one.

    Files keep no order; :func:`replay_order` sorts where order is needed.
    """
    rows = spark.read.schema(schema).json(f"{directory}/rows")
    recorded = spark.read.parquet(f"{directory}/counts")
    keys = [client, "split", "detailed_label"]
    actual = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    mismatches = recorded.join(actual, keys, "full").where(
        ~F.col("rows").eqNullSafe(F.col("actual"))
    )
    return rows, mismatches


def replay_order(rows: DataFrame, ts="ts", ordinal="source_edge_index") -> DataFrame:
    """Rows by time, then by their original position."""
    return rows.orderBy(ts, ordinal)


def write_graph_tables(nodes: DataFrame, edges: DataFrame, directory, by):
    """Graph tables partitioned by graph; existing tables are never overwritten.

    Counts come from the edges as stored, so those are made once.
    """
    for name, frame in (("nodes", nodes), ("edges", edges)):
        frame.write.mode("errorifexists").partitionBy(*by).parquet(f"{directory}/{name}")
    stored = edges.sparkSession.read.schema(edges.schema).parquet(f"{directory}/edges")
    counts = stored.groupBy(*by, "split", "label_idx").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("errorifexists").parquet(f"{directory}/counts")


def read_graph_tables(spark: SparkSession, directory):
    return tuple(spark.read.parquet(f"{directory}/{name}") for name in ("nodes", "edges", "counts"))
