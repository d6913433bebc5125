"""Class balance, label exploration and dataset verification.

Reports are built on class counts per scope and split, which are small; global
and per-client figures come from one ``grouping sets`` pass over them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NEAR_CONSTANT_STD, RARE_SUPPORT, SEVERE_SUPPORT, SPLITS

GLOBAL = "global"


def class_distribution(counts: DataFrame, by) -> DataFrame:
    """Counts ``(by..., label, n)`` with shares; 0 where a group is empty."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__t"))
    joined = counts.join(totals, list(by)) if by else counts.withColumn("__t", totals.scalar())
    return joined.withColumn(
        "share", F.when(F.col("__t") > 0, F.col("n") / F.col("__t")).otherwise(0.0)
    ).drop("__t")


def scoped_counts(df: DataFrame, taxonomy, client="scenario", label="detailed_label") -> DataFrame:
    """``(scope, split, label, n)`` for the global scope and each client.

    Splits include ``all``; every class of the taxonomy appears. Row data is
    aggregated once per (client, split, class); the cube is over that.
    """
    base = df.groupBy(client, "split", label).agg(F.count(F.lit(1)).alias("n"))
    rolled = base.groupingSets(
        [[client, "split", label], [client, label], ["split", label], [label]], client, "split", label
    ).agg(F.sum("n").alias("n"), F.grouping(client).alias("__c"), F.grouping("split").alias("__s"))
    known = rolled.select(
        F.when(F.col("__c") == 1, GLOBAL).otherwise(F.col(client)).alias("scope"),
        F.when(F.col("__s") == 1, "all").otherwise(F.col("split")).alias("split"),
        label, "n",
    )
    splits = F.array(*[F.lit(s) for s in ("all", *SPLITS)])
    classes = F.array(*[F.lit(c) for c in taxonomy])
    frame = (
        known.select("scope").distinct()
        .select("scope", F.explode(splits).alias("split"))
        .select("scope", "split", F.explode(classes).alias(label))
    )
    return frame.join(known, ["scope", "split", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def entropy_bits(counts: DataFrame, by, classes) -> DataFrame:
    """Entropy in bits over non-zero shares, normalised, effective classes."""
    shares = class_distribution(counts, by)
    p = F.col("share")
    rows = shares.groupBy(*by).agg(
        F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0)).alias("entropy_bits")
    )
    h = F.col("entropy_bits")
    normalised = h / F.log2(F.lit(float(classes))) if classes > 1 else F.lit(0.0)
    return rows.select(
        *by, "entropy_bits", normalised.alias("normalized_entropy"),
        F.pow(F.lit(2.0), h).alias("effective_classes"),
    )


def js_divergence_from_union(counts: DataFrame, label="detailed_label") -> DataFrame:
    """Base-2 Jensen-Shannon divergence of each scope from the global shares."""
    shares = class_distribution(counts, ["scope"])
    union = shares.where(F.col("scope") == GLOBAL).select(label, F.col("share").alias("u"))
    p, u = F.col("share"), F.col("u")
    middle = (p + u) / 2

    def side(x):
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    rows = shares.join(union, label).groupBy("scope").agg(
        (F.sum(side(p)) * 0.5 + F.sum(side(u)) * 0.5).alias("js")
    )
    return rows.select(
        "scope", F.when(F.col("scope") == GLOBAL, 0.0).otherwise(F.col("js")).alias("js_from_union_bits")
    )


def balance_summary(scoped: DataFrame, classes, label="detailed_label") -> DataFrame:
    """One row per scope: totals per split, support extremes, entropy, divergence."""
    every = scoped.where(F.col("split") == "all").drop("split")
    totals = scoped.groupBy("scope").agg(
        *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in SPLITS]
    )
    n = F.col("n")
    extremes = every.groupBy("scope").agg(
        F.sum("n").alias("total"),
        F.count_if(n > 0).alias("classes_present"),
        F.count_if(n == 0).alias("zero_support_classes"),
        F.coalesce(F.min(F.when(n > 0, n)), F.lit(0)).alias("minority_support"),
        F.coalesce(F.max(F.when(n > 0, n)), F.lit(0)).alias("majority_support"),
    )
    ratio = F.when(
        F.col("minority_support") > 0, F.col("majority_support") / F.col("minority_support")
    ).otherwise(0.0)
    return (
        totals.join(extremes, "scope")
        .withColumn("imbalance_ratio", ratio)
        .join(entropy_bits(every, ["scope"], classes), "scope")
        .join(js_divergence_from_union(every, label), "scope")
    )


def class_support_by_client(scoped: DataFrame, label="detailed_label") -> DataFrame:
    """Scope x split x class with support, share, privacy and rarity flags."""
    every = scoped.where(F.col("split") == "all")
    facts = every.groupBy(label).agg(
        F.sum(F.when(F.col("scope") == GLOBAL, F.col("n")).otherwise(0)).alias("global_support"),
        F.count_if((F.col("scope") != GLOBAL) & (F.col("n") > 0)).alias("clients_with_class"),
    )
    rows = class_distribution(scoped, ["scope", "split"]).join(facts, label)
    private = F.col("clients_with_class") == 1
    rare = F.col("global_support") < SEVERE_SUPPORT
    return rows.select(
        "scope", "split", label, F.col("n").alias("support"), F.col("share").alias("proportion"),
        "global_support", "clients_with_class", (F.col("n") == 0).alias("zero_support"),
        private.alias("private_class"), rare.alias("ultra_rare_class"),
        ((F.col("n") == 0) | private | rare).alias("severe_trigger"),
    )


def severe_classes(scoped: DataFrame, label="detailed_label") -> DataFrame:
    """Classes that are private, ultra rare or without validation support."""
    support = class_support_by_client(scoped, label).where(F.col("scope") == GLOBAL)
    validation = scoped.where((F.col("scope") == GLOBAL) & (F.col("split") == "validation")).select(
        label, F.col("n").alias("validation_support")
    )
    rows = support.where(F.col("split") == "all").join(validation, label)
    return rows.where(
        F.col("private_class") | F.col("ultra_rare_class") | (F.col("validation_support") == 0)
    ).select(label, "global_support", "clients_with_class", "validation_support")


def feature_distribution(df: DataFrame, features, client="scenario") -> DataFrame:
    """Per scope and feature: moments, zero rate, near-constancy, flag rate.

    Features are unpivoted inside each row and every scope is combined before
    the shuffle, so one scan serves the clients and the global scope.
    """
    long = df.select(
        client,
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
            )
        ),
    )
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs(F.col("x")) != float("inf"))
    x = F.when(finite, F.col("x"))
    rows = long.groupingSets([[client, "feature"], ["feature"]], client, "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~finite).alias("nonfinite"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.count_if(x == 0) / F.count(x)).alias("zero_rate"), F.grouping(client).alias("__c"),
    )
    return rows.select(
        F.when(F.col("__c") == 1, GLOBAL).otherwise(F.col(client)).alias("scope"), "feature", "rows", "nonfinite", "mean", "std", "min", "max",
        "zero_rate",
        F.coalesce(F.col("std") <= NEAR_CONSTANT_STD, F.lit(False)).alias("near_constant"),
        F.when(F.endswith(F.col("feature"), F.lit("_missing")), F.col("mean")).alias("missing_rate"),
    )


def label_distribution(df: DataFrame, by=("scenario",), label="detailed_label") -> DataFrame:
    """Count and percent of each label per scenario."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return class_distribution(counts, list(by)).select(
        *by, label, "n", (F.col("share") * 100).alias("percent")
    )


def presence_matrix(df: DataFrame, scenarios, label="detailed_label") -> DataFrame:
    """Class x scenario counts, total, private and rare flags."""
    wide = df.groupBy(label).pivot("scenario", list(scenarios)).agg(F.count(F.lit(1)))
    columns = [F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in scenarios]
    total, present = columns[0], (columns[0] > 0).cast("int")
    for c in columns[1:]:
        total, present = total + c, present + (c > 0).cast("int")
    return wide.select(
        label, *[c.alias(s) for c, s in zip(columns, scenarios)], total.alias("total"),
        (present == 1).alias("private"), ((total > 0) & (total < RARE_SUPPORT)).alias("rare"),
    )


# The rule of thumb for a class cap.
CAP_SMALL, CAP_RATIO, CAP_FACTOR, CAP_EXTREME, CAP_FLOOR, CAP_BINARY_FLOOR = 1000, 100, 5, 5000, 1000, 10000


def suggest_cap(df: DataFrame, by=("scenario",), label="detailed_label") -> DataFrame:
    """Suggested rows per class of each scenario; null keeps everything."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(*by).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"), F.max("n").alias("most"),
        F.min("n").alias("least"), F.median("n").alias("median"),
    )
    moderate = F.least(F.col("median") * CAP_FACTOR, F.col("most"))
    extreme = F.greatest(F.col("median"), F.lit(CAP_EXTREME))
    ratio = F.col("most") / F.col("least")
    cap = F.greatest(F.floor(F.when(ratio <= CAP_RATIO, moderate).otherwise(extreme)), F.lit(CAP_FLOOR))
    cap = F.when(F.col("classes") <= 2, F.greatest(cap, F.lit(CAP_BINARY_FLOOR))).otherwise(cap)
    return rows.select(
        *by, "total", "classes", ratio.alias("ratio"),
        F.when(F.col("total") >= CAP_SMALL, cap.cast("long")).alias("suggested_cap"),
    )


def verify_dataset(df: DataFrame, required, taxonomy, bad_rows=None, approximate=False, label="detailed_label") -> DataFrame:
    """One verification row per required scenario.

    Counts, distinct endpoints, missing and unexpected labels, status. Distinct
    endpoints are exact by default: addresses are grouped first, so a scenario
    with tens of millions of them is counted by many tasks.
    ``bad_rows(scenario, parse_error_rows)`` comes from the parser.
    """
    if approximate:
        ends = df.groupBy("scenario").agg(
            F.approx_count_distinct("orig_h").alias("unique_sources"),
            F.approx_count_distinct("resp_h").alias("unique_destinations"),
        )
    else:
        sides = F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("orig_h").alias("ip")),
                F.struct(F.lit(1).alias("side"), F.col("resp_h").alias("ip")),
            )
        )
        ends = df.select("scenario", sides).where(F.col("ip").isNotNull()).distinct().groupBy("scenario").agg(
            F.count_if(F.col("side") == 0).alias("unique_sources"),
            F.count_if(F.col("side") == 1).alias("unique_destinations"),
        )
    counts = df.groupBy("scenario", label).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.groupBy("scenario").agg(
        F.sum("n").alias("clean_rows"),
        F.array_sort(F.collect_set(label)).alias("observed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("label_counts"),
    )
    frame = df.sparkSession.createDataFrame([(s,) for s in required], "scenario string")
    rows = frame.join(labels, "scenario", "left").join(ends, "scenario", "left")
    if bad_rows is not None:
        rows = rows.join(bad_rows.select("scenario", "parse_error_rows"), "scenario", "left")
    else:
        rows = rows.withColumn("parse_error_rows", F.lit(0).cast("long"))
    expected = F.array(*[F.lit(c) for c in sorted(taxonomy)])
    observed = F.coalesce("observed", F.array().cast("array<string>"))
    rows = rows.withColumns(
        {
            "clean_rows": F.coalesce("clean_rows", F.lit(0)),
            "parse_error_rows": F.coalesce("parse_error_rows", F.lit(0)),
            "missing_labels": F.array_except(expected, observed),
            "unexpected_labels": F.array_except(observed, expected),
        }
    )
    serious = (F.size("unexpected_labels") > 0) | (F.col("parse_error_rows") > 0) | F.col("observed").isNull()
    warned = (F.size("missing_labels") > 0) | (F.col("clean_rows") == 0)
    return rows.select(
        "scenario", (F.col("clean_rows") + F.col("parse_error_rows")).alias("raw_rows"), "clean_rows",
        "parse_error_rows", "label_counts",
        F.coalesce("unique_sources", F.lit(0)).alias("unique_sources"),
        F.coalesce("unique_destinations", F.lit(0)).alias("unique_destinations"),
        "missing_labels", "unexpected_labels",
        F.when(serious, "ERROR").when(warned, "WARNING").otherwise("OK").alias("status"),
    )
