"""JSON artefacts of runs: round logs, histories, operational event logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SENSITIVE_FRAGMENTS

ROUND_SCHEMA = (
    "run_id string, round long, loss double, accuracy double, macro_f1 double, "
    "`macro-f1` double, weighted_f1 double, `weighted-f1` double"
)
EVENT_MAX_ITEMS = 100


def normalise_rounds(rounds: DataFrame) -> DataFrame:
    """Round metrics under one spelling of each key."""

    def first_of(*names):
        present = [F.col(f"`{n}`") for n in names if n in rounds.columns]
        return F.coalesce(*present).alias(names[0])

    return rounds.select(
        "run_id", "round", "loss", "accuracy",
        first_of("macro_f1", "macro-f1"), first_of("weighted_f1", "weighted-f1"),
    )


def read_round_logs(spark: SparkSession, path, **options) -> DataFrame:
    """Per-round JSON documents, one row per round."""
    return normalise_rounds(spark.read.schema(ROUND_SCHEMA).options(**options).json(path))


def round_contiguity(rounds: DataFrame) -> DataFrame:
    """Per run: whether rounds run 1, 2, 3, ... without gaps or repeats."""
    return rounds.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rounds"),
        (
            (F.min("round") == 1)
            & (F.max("round") == F.count(F.lit(1)))
            & (F.count_distinct("round") == F.count(F.lit(1)))
        ).alias("contiguous"),
    )


def flatten_history(runs: DataFrame, history="history") -> DataFrame:
    """Training curves kept inside run documents, one row per epoch."""
    kept = [c for c in runs.columns if c != history]
    return runs.select(*kept, F.posexplode(history).alias("epoch_index", "point")).select(
        *kept, (F.col("epoch_index") + 1).alias("epoch"), "point.*"
    )


def _document_faults():
    """Faults of JSON texts level by level: sensitive names and large collections.

    Objects and arrays are opened with Spark's JSON functions, so names are
    compared as parsed, whatever escapes the text uses.
    """
    fragments = F.array(*[F.lit(f) for f in SENSITIVE_FRAGMENTS])

    def opened(node):
        """Children of one ``(name, text)`` node: of an object by key, of an array under its name."""
        members = F.map_entries(F.from_json(node["text"], "map<string,string>"))
        named = F.transform(members, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text")))
        items = F.transform(
            F.from_json(node["text"], "array<string>"),
            lambda v: F.struct(node["name"].alias("name"), v.alias("text")),
        )
        none = F.array().cast("array<struct<name:string,text:string>>")
        text = F.coalesce(F.ltrim(node["text"]), F.lit(""))
        return (
            F.when(F.startswith(text, F.lit("{")), F.coalesce(named, none))
            .when(F.startswith(text, F.lit("[")), F.coalesce(items, none)).otherwise(none)
        )

    def size_of(node):
        return F.greatest(
            F.coalesce(F.json_array_length(node["text"]), F.lit(0)),
            F.coalesce(F.size(F.json_object_keys(node["text"])), F.lit(0)),
        )

    def is_sensitive(node):
        return F.exists(fragments, lambda f: F.contains(F.lower(F.coalesce(node["name"], F.lit(""))), f))

    return opened, size_of, is_sensitive


def parse_event_log(lines: DataFrame, column="value") -> DataFrame:
    """Operational events ``timestamp, level, event, fields``; fields stay text.

    ``event_error`` names a sensitive field or a collection of more than 100 items, at
    any depth; good rows have null. A document is opened level by level, as many times
    as it has brackets at most, within one expression; so it works on a stream too. Text
    that is no JSON object, or nested deeper than the parser reads (1,000 levels), is an
    error of its own, since nothing in it was looked at.
    """
    opened, size_of, is_sensitive = _document_faults()
    text = F.col(column)
    document = F.from_json(text, "timestamp string, level string, event string, fields string")
    root = F.array(F.struct(F.lit(None).cast("string").alias("name"), text.alias("text")))
    nothing = F.lit(None).cast("string")
    brackets = F.length(F.regexp_replace(text, r"[^\[{]", ""))
    steps = F.when(brackets > 0, F.sequence(F.lit(1), brackets)).otherwise(F.array().cast("array<int>"))

    def open_level(found, _):
        level = F.flatten(F.transform(found["level"], opened))

        def first(test):
            return F.try_element_at(F.filter(level, test), F.lit(1))["name"]

        return F.struct(
            level.alias("level"),
            F.coalesce(found["sensitive"], first(is_sensitive)).alias("sensitive"),
            F.coalesce(found["large"], first(lambda n: size_of(n) > EVENT_MAX_ITEMS)).alias("large"),
        )

    start = F.struct(root.alias("level"), nothing.alias("sensitive"), nothing.alias("large"))
    rows = lines.select(
        document.alias("d"), F.json_object_keys(text).isNull().alias("__unread"), F.aggregate(steps, start, open_level).alias("__found")
    )
    return rows.select(
        "d.timestamp", "d.level", "d.event", "d.fields",
        F.when(F.col("__unread"), F.lit("not a readable object"))
        .when(F.col("__found.sensitive").isNotNull(), F.concat(F.lit("sensitive field: "), "__found.sensitive"))
        .when(F.col("__found.large").isNotNull(), F.concat(F.lit("field too large: "), "__found.large")).alias("event_error"),
    )


def read_event_log(spark: SparkSession, path, streaming=False, **options) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_event_log(reader.format("text").options(**options).load(path))
