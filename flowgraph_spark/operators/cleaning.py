"""Cleaning and projection of connection-log rows.

Order matters: the label becomes canonical before missing tokens become null.
Every operator is one ``select``; nothing here shuffles except the profile.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flows as fx
from ..schema import (
    DROP_COLUMNS,
    FLOAT_COLUMNS,
    JSON_OPTIONAL_DEFAULTS,
    JSON_RECORD,
    JSON_REQUIRED,
    MISSING_TOKENS,
    PORT_COLUMNS,
)


def canonicalise_label(df: DataFrame) -> DataFrame:
    return df.withColumn("detailed_label", fx.canonical_label(F.col("detailed_label")))


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*DROP_COLUMNS)


def null_missing_tokens(df: DataFrame) -> DataFrame:
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(
        *[fx.missing_to_null(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def cast_numbers(df: DataFrame) -> DataFrame:
    """Floats and ports from text; text that is no number becomes null."""

    def cast(column):
        if column in FLOAT_COLUMNS:
            return fx.lenient_double(F.col(column)).alias(column)
        if column in PORT_COLUMNS:
            return fx.lenient_long(F.col(column)).alias(column)
        return F.col(column)

    return df.select(*[cast(c) for c in df.columns])


def fill_missing_with_flags(df: DataFrame) -> DataFrame:
    """Null numbers become 0 with ``<column>_missing`` = 1; null service, unknown.

    Flags are always emitted, so the schema does not depend on the data; the
    feature fit keeps the flags its train rows use.
    """
    numbers = [c for c in (*FLOAT_COLUMNS, *PORT_COLUMNS) if c in df.columns]

    def fill(column):
        if column in numbers:
            return F.coalesce(F.col(column), F.lit(0)).cast(
                "long" if column in PORT_COLUMNS else "double"
            ).alias(column)
        if column == "service":
            return F.coalesce(F.col(column), F.lit("unknown")).alias(column)
        return F.col(column)

    return df.select(
        *[fill(c) for c in df.columns],
        *[F.col(c).isNull().cast("byte").alias(f"{c}_missing") for c in numbers],
    )


def clean(df: DataFrame) -> DataFrame:
    """Full cleaning of raw text rows."""
    steps = (
        canonicalise_label, drop_identifiers, null_missing_tokens, cast_numbers,
        fill_missing_with_flags,
    )
    for step in steps:
        df = step(df)
    return df


def clean_unlabelled(df: DataFrame) -> DataFrame:
    """Cleaning of live rows, which carry no label columns."""
    for step in (drop_identifiers, null_missing_tokens, cast_numbers, fill_missing_with_flags):
        df = step(df)
    return df


def align_union(frames) -> DataFrame:
    """Union by name of frames with different columns, first-seen order.

    Ports and flags a frame lacks become 0; missing floats stay null.
    """
    frames = list(frames)
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)

    def default(column):
        if column in PORT_COLUMNS or column.endswith("_missing"):
            return F.coalesce(F.col(column), F.lit(0).cast(merged.schema[column].dataType)).alias(column)
        return F.col(column)

    return merged.select(*[default(c) for c in merged.columns])


def profile_missing(df: DataFrame) -> DataFrame:
    """Per column: nulls and each missing token, from one pass over the rows."""
    columns = df.columns
    texts = {name for name, kind in df.dtypes if kind == "string"}
    dash, empty = MISSING_TOKENS
    counts = []
    for c in columns:
        column = F.col(c)
        counts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(column.isNull()).alias("n_null"),
                (F.count_if(column == dash) if c in texts else F.lit(0).cast("long")).alias("n_dash"),
                (F.count_if(column == empty) if c in texts else F.lit(0).cast("long")).alias("n_empty"),
            )
        )
    return df.agg(F.array(*counts).alias("profile")).select(F.inline("profile"))


def label_counts(df: DataFrame, label="detailed_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def apply_production_schema(lines: DataFrame, column="value") -> DataFrame:
    """Live JSON records: unknown keys are an error, optional keys have defaults.

    Adds ``schema_error`` (null when the record is good) instead of failing, so
    the caller chooses between a quarantine and :func:`require_good`.
    """
    record = F.from_json(F.col(column), JSON_RECORD)
    keys = F.json_object_keys(F.col(column))
    allowed = F.array(*[F.lit(k) for k in (*JSON_REQUIRED, *JSON_OPTIONAL_DEFAULTS)])
    required = F.array(*[F.lit(k) for k in JSON_REQUIRED])
    parsed = lines.select(F.col(column), record.alias("r"), keys.alias("k")).select(
        column,
        "r",
        F.when(F.col("k").isNull(), F.lit("not a JSON object"))
        .when(F.size(F.array_except("k", allowed)) > 0,
              F.concat(F.lit("unknown fields: "),
                       F.concat_ws(",", F.array_sort(F.array_except("k", allowed)))))
        .when(F.size(F.array_except(required, F.col("k"))) > 0,
              F.concat(F.lit("missing fields: "),
                       F.concat_ws(",", F.array_sort(F.array_except(required, F.col("k"))))))
        .alias("schema_error"),
    )

    def field(name):
        value = F.col("r").getField(name)
        if name in JSON_OPTIONAL_DEFAULTS:
            value = F.coalesce(value, F.lit(JSON_OPTIONAL_DEFAULTS[name]))
        return value.alias(name.removeprefix("id."))

    return parsed.select(
        *[field(n) for n in (*JSON_REQUIRED, *JSON_OPTIONAL_DEFAULTS)], "schema_error"
    )


def require_good(df: DataFrame, error="schema_error") -> DataFrame:
    """Fail on the first bad row; keep the good rows without the error column."""
    others = [c for c in df.columns if c != error]
    first, *rest = others
    checked = F.when(F.col(error).isNotNull(), F.raise_error(F.col(error))).otherwise(F.col(first))
    return df.select(checked.cast(df.schema[first].dataType).alias(first), *rest)


def with_flow_id(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "flow_id",
        fx.flow_id(F.col("uid"), F.col("orig_h"), F.col("orig_p"), F.col("resp_h"), F.col("resp_p")),
    )
