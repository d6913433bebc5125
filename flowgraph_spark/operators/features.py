"""Leak-free features: fit on train rows, apply anywhere.

A fit is a few small tables (vocabularies, scaler moments, kept flags) from two
aggregations; applying it is one projection of literals, so features cost no
shuffle and no Python.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flows as fx
from ..functions.ordering import rank_in_groups
from ..schema import (
    BENIGN,
    HISTORY_FLAGS,
    RESP_PORT_BUCKETS,
    SCALED_COLUMNS,
    SERVICE_MIN_SHARE,
)
from ..session import cut_lineage

# One-hot columns of one field; a field with more values is refused, as it is no category.
# ``label_index`` has no limit.
MAX_CATEGORIES = 1000


class FittedFeatures(NamedTuple):
    proto: tuple
    service: tuple
    conn_state: tuple
    scaler: tuple  # (column, mean, scale) triples
    flags: tuple

    @property
    def columns(self):
        """Feature names in their fixed order."""
        return (
            [f"resp_port_{b}" for b in RESP_PORT_BUCKETS]
            + ["orig_port_is_wellknown"]
            + [f"proto_{v}" for v in self.proto]
            + [f"service_{v}" for v in self.service]
            + ["service_other"]
            + [f"conn_state_{v}" for v in self.conn_state]
            + [fx.history_column(c) for c in HISTORY_FLAGS]
            + [f"{name}_scaled" for name, _, _ in self.scaler]
            + list(self.flags)
        )


def vocabulary(train: DataFrame, column, by=()) -> DataFrame:
    """Distinct non-null values, one row each."""
    return train.where(F.col(column).isNotNull()).select(*by, column).distinct()


def frequent_values(train: DataFrame, column="service", share=SERVICE_MIN_SHARE, by=()) -> DataFrame:
    """Values whose share of all train rows reaches ``share``; unknown never."""
    counts = train.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, list(by)) if by else counts.withColumn("total", totals.scalar())
    return joined.select(*by, column, (F.col("n") / F.col("total")).alias("share")).where(
        (F.col("share") >= share) & ~F.col(column).isin("unknown", "")
    )


def scaler_moments(train: DataFrame, columns=SCALED_COLUMNS, by=()) -> DataFrame:
    """Mean and population deviation of ``log1p`` per column, one row each.

    A constant column gets scale 1. All columns come from one aggregation.
    """
    sums = []
    for c in columns:
        logged = F.log1p(F.col(c))
        sums += [F.avg(logged).alias(f"{c}__mean"), F.stddev_pop(logged).alias(f"{c}__std")]
    wide = train.groupBy(*by).agg(*sums)
    triples = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__mean").alias("mean"),
            F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std")).alias("scale"),
        )
        for c in columns
    ]
    return wide.select(*by, F.inline(F.array(*triples)))


def used_flags(train: DataFrame, by=()) -> DataFrame:
    """Missing flags that are set in at least one train row."""
    flags = sorted(c for c in train.columns if c.endswith("_missing"))
    wide = train.groupBy(*by).agg(*[F.max(c).alias(c) for c in flags])
    pairs = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("used")) for c in flags])
    return wide.select(*by, F.inline(pairs)).where(F.col("used") == 1).select(*by, "flag")


def category_values(train: DataFrame, columns) -> DataFrame:
    """Distinct non-null values of several columns with their counts: column_no, value, n."""
    cells = F.array(*[F.struct(F.lit(i).alias("column_no"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    pairs = train.select(F.inline(cells)).where(F.col("value").isNotNull())
    return pairs.groupBy("column_no", "value").agg(F.count(F.lit(1)).alias("n"))


def fit_features(train: DataFrame, max_categories=MAX_CATEGORIES) -> FittedFeatures:
    """Learn vocabularies, scaler and flags from train rows only.

    One aggregation gives the moments and the flags, another the values of all
    categories. Each becomes a column, so more than ``max_categories`` of them are an
    error; :func:`category_index` and :func:`transform_sparse` take any number.
    Without train rows there is nothing to learn, which is an error.
    """
    flags = sorted(c for c in train.columns if c.endswith("_missing"))
    columns = []
    for c in SCALED_COLUMNS:
        logged = F.log1p(F.col(c))
        columns += [F.avg(logged).alias(f"{c}__mean"), F.stddev_pop(logged).alias(f"{c}__std")]
    row = train.agg(
        *columns,
        *[F.max(c).alias(c) for c in flags],
        F.count(F.lit(1)).alias("train_rows"),
    ).first()
    if not row["train_rows"]:
        raise ValueError("There are no train rows to fit features on.")
    named = ("proto", "service", "conn_state")
    total = row["train_rows"]
    frequent = (F.col("n") / F.lit(total) >= SERVICE_MIN_SHARE) & ~F.col("value").isin("unknown", "")
    values = category_values(train, named).where((F.col("column_no") != 1) | frequent)
    found = values.select("column_no", "value").limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise ValueError(f"More than {max_categories} categories in {', '.join(named)}; use transform_sparse.")
    proto, service, conn_state = (tuple(sorted(v for k, v in found if k == i)) for i in range(3))
    return FittedFeatures(
        proto=proto, service=service, conn_state=conn_state,
        scaler=tuple((c, row[f"{c}__mean"], row[f"{c}__std"] or 1.0) for c in SCALED_COLUMNS),
        flags=tuple(c for c in flags if row[c] == 1),
    )


def category_index(train: DataFrame, columns) -> DataFrame:
    """Dimension ``column_no, value, position`` of the non-null values in train rows.

    Positions run from 0 over all columns in order, values sorted within a column. It
    is a table ranked by Spark, of any number of values.
    """
    values = category_values(train, columns).select("column_no", "value")
    ranked = rank_in_groups(values, [], ["column_no", "value"], rank="__r")
    return cut_lineage(ranked.select("column_no", "value", (F.col("__r") - 1).alias("position")))


def transform_sparse(df: DataFrame, fit: FittedFeatures, index: DataFrame, columns, keep=()) -> DataFrame:
    """``keep``, and ``features``: struct of size, indices (ascending) and values without zeros.

    The first places are those of ``fit``, the others one-hot places of ``columns`` by
    ``index``. Values the index does not hold are left out, as are nulls. Every column
    is one equality join, which AQE makes a broadcast of a small dimension and splits
    on a value that many rows share. Kept columns may have any names.
    """
    base = len(fit.columns)
    rows = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("__kept"),
        F.array(*[e.cast("double") for e in feature_expressions(fit, df.columns)]).alias("__dense"),
        *[F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(columns)],
    )
    for i in range(len(columns)):
        own = index.where(F.col("column_no") == i).select(F.col("value").alias(f"__c{i}"), (F.col("position") + base).alias(f"__i{i}"))
        rows = rows.join(own, f"__c{i}", "left")
    places = F.transform("__dense", lambda x, k: F.struct(k.cast("long").alias("k"), x.alias("x")))
    ones = F.array(*[F.struct(F.col(f"__i{i}").alias("k"), F.lit(1.0).alias("x")) for i in range(len(columns))])
    cells = F.filter(F.concat(places, ones), lambda cell: cell["k"].isNotNull() & (cell["x"] != 0))
    size = index.agg(F.count(F.lit(1))).scalar() + base
    return rows.select("__kept", size.alias("size"), cells.alias("__cells")).select(
        *[F.col(f"__kept.`{c}`").alias(c) for c in keep],
        F.struct(
            F.col("size"), F.transform("__cells", lambda cell: cell["k"]).alias("indices"),
            F.transform("__cells", lambda cell: cell["x"]).alias("values"),
        ).alias("features"),
    )


def fit_shared(frames) -> FittedFeatures:
    """One fit over the train rows of several scenarios."""
    frames = list(frames)
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return fit_features(merged.where(F.col("split") == "train"))


def one_hot(column, values, prefix):
    """One 0/1 byte column per value; null and unseen values are all zero."""
    return [
        F.coalesce(column == v, F.lit(False)).cast("byte").alias(f"{prefix}_{v}") for v in values
    ]


def feature_expressions(fit: FittedFeatures, available=None):
    """Feature columns of a fit, in order, as expressions over clean rows."""
    port = fx.resp_port_bucket(F.col("resp_p"))
    service = F.coalesce(F.col("service"), F.lit("unknown"))
    known = service.isin(*fit.service) if fit.service else F.lit(False)
    expressions = one_hot(port, RESP_PORT_BUCKETS, "resp_port")
    expressions.append(fx.is_wellknown_port(F.col("orig_p")).alias("orig_port_is_wellknown"))
    expressions += one_hot(F.col("proto"), fit.proto, "proto")
    expressions += one_hot(service, fit.service, "service")
    expressions.append((~known).cast("byte").alias("service_other"))
    expressions += one_hot(F.col("conn_state"), fit.conn_state, "conn_state")
    expressions += [
        count.alias(fx.history_column(flag)) for flag, count in fx.history_counts(F.col("history"))
    ]
    expressions += [
        ((F.log1p(F.col(c)) - F.lit(mean)) / F.lit(scale)).cast("float").alias(f"{c}_scaled")
        for c, mean, scale in fit.scaler
    ]
    expressions += [
        (F.col(c) if available is None or c in available else F.lit(0)).cast("byte").alias(c)
        for c in fit.flags
    ]
    return expressions


def transform(df: DataFrame, fit: FittedFeatures, keep=()) -> DataFrame:
    """Addresses, time, features in fixed order, labels."""
    labels = [c for c in ("label", "detailed_label") if c in df.columns]
    return df.select(
        *keep, "orig_h", "resp_h", "ts", *feature_expressions(fit, df.columns), *labels
    )


def with_feature_array(df: DataFrame, fit: FittedFeatures, name="features") -> DataFrame:
    """Pack the ordered features into one array column."""
    packed = F.array(*[F.col(c).cast("float") for c in fit.columns])
    return df.withColumn(name, packed).drop(*fit.columns)


def fitted_table(spark: SparkSession, fit: FittedFeatures) -> DataFrame:
    """A fit as rows ``(kind, position, name, mean, scale)``."""
    rows = []
    for kind in ("proto", "service", "conn_state", "flags"):
        rows += [(kind, i, v, None, None) for i, v in enumerate(getattr(fit, kind))]
    rows += [("scaler", i, c, m, s) for i, (c, m, s) in enumerate(fit.scaler)]
    return spark.createDataFrame(
        rows, "kind string, position int, name string, mean double, scale double"
    )


def save_features(spark: SparkSession, fit: FittedFeatures, path):
    fitted_table(spark, fit).coalesce(1).write.mode("errorifexists").parquet(path)


def load_features(spark: SparkSession, path) -> FittedFeatures:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["position"])
    kinds = {
        kind: tuple(r["name"] for r in rows if r["kind"] == kind)
        for kind in ("proto", "service", "conn_state", "flags")
    }
    scaler = tuple((r["name"], r["mean"], r["scale"]) for r in rows if r["kind"] == "scaler")
    return FittedFeatures(scaler=scaler, **kinds)


def label_index(labels: DataFrame, mode, label="detailed_label", taxonomy=None) -> DataFrame:
    """Dimension ``(label, idx)``.

    ``fixed``: the given taxonomy in its order. ``sorted``: sorted union of the
    labels present. ``benign_first``: Benign is 0, the others sorted after it.
    The index is a table ranked by Spark, of any number of labels.
    """
    if mode == "fixed":
        rows = [(name, i) for i, name in enumerate(taxonomy)]
        return labels.sparkSession.createDataFrame(rows, f"{label} string, label_idx int")
    present = vocabulary(labels, label)
    if mode == "benign_first":
        # Benign is in the index even without rows.
        benign = labels.sparkSession.createDataFrame([(BENIGN,)], f"{label} string")
        present = present.union(benign).distinct()
        first = (F.col(label) != BENIGN).cast("int")
    elif mode == "sorted":
        first = F.lit(0)
    else:
        raise ValueError(f"Unknown label index mode {mode}.")
    ranked = rank_in_groups(present.withColumn("__later", first), [], ["__later", label], rank="__r")
    return ranked.select(label, (F.col("__r") - 1).cast("int").alias("label_idx"))


def unknown_labels(df: DataFrame, taxonomy, label="detailed_label") -> DataFrame:
    """Labels outside the taxonomy with their row counts; empty when all is well."""
    return (
        df.where(~F.col(label).isin(*taxonomy) | F.col(label).isNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_label_index(df: DataFrame, index: DataFrame, label="detailed_label") -> DataFrame:
    """Attach the index by a join; an unknown label is an error, never a null."""
    known = index.select(F.col(label).alias("__label"), F.col("label_idx").alias("__idx"))
    joined = df.join(known, F.col(label) == F.col("__label"), "left")
    checked = F.when(
        F.col("__idx").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    ).otherwise(F.col("__idx"))
    return joined.withColumn("label_idx", checked.cast("int")).drop("__label", "__idx")
