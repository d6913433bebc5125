"""Averaging client parameters as tables.

A model state is a long table ``(client, param, pos, row, value)``; ``row`` is
the class row of a classifier output and null elsewhere. Client weights are
``(client, num_examples)``, class support ``(client, class_idx, support)``.
Averages are grouped sums, combined before the shuffle; nothing gathers a model.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ("param", "pos", "row")


def state_problems(params: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per violation kind with its count; all zero for a sound input.

    Every client must hold the same keys once, weights must be positive, and
    values finite.
    """
    clients = weights.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_key = params.groupBy("param", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("client").alias("k")
    )
    value = F.col("value")
    nonfinite = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    bad_keys = per_key.agg(F.count_if((F.col("n") != clients) | (F.col("k") != clients))).scalar()
    bad_values = params.agg(F.count_if(nonfinite)).scalar()
    return weights.agg(F.count_if(F.col("num_examples") <= 0).alias("bad_weights")).select(
        "bad_weights", bad_keys.alias("bad_keys"), bad_values.alias("bad_values")
    )


def _finite(value):
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("parameter is not finite"))).otherwise(value).cast("double")


def _complete(value, weights):
    """``value`` of a position that every client holds exactly once; else an error."""
    clients = weights.agg(F.count(F.lit(1))).scalar()
    once = (F.count(F.lit(1)) == clients) & (F.count_distinct("client") == clients)
    return F.when(once, value).otherwise(F.raise_error(F.lit("clients hold different parameters")))


def _weight(n):
    """The weight of a row's client; a client without one is an error."""
    return (
        F.when(n.isNull(), F.raise_error(F.lit("a client has no weight")))
        .when(n <= 0, F.raise_error(F.lit("client weight must be positive"))).otherwise(n).cast("double")
    )


def weighted_average(params: DataFrame, weights: DataFrame, exact=()) -> DataFrame:
    """``sum(value * n) / sum(n)`` per parameter position.

    Parameters named in ``exact`` (counters, booleans) must agree on all
    clients and are copied. Clients and weights must match, and every client
    must hold every position once; anything else is an error.
    """
    joined = params.join(weights, "client", "left")
    weight = _weight(F.col("num_examples"))
    mean = F.sum(_finite(F.col("value")) * weight) / F.sum(weight)
    low, high = F.min("value"), F.max("value")
    copied = F.when(low != high, F.raise_error(F.lit("exact entry differs across clients"))).otherwise(low)
    value = F.when(F.col("param").isin(*exact), copied.cast("double")).otherwise(mean) if exact else mean
    return joined.groupBy(*POSITION).agg(_complete(value, weights).cast("double").alias("value"))


def weighted_average_complex(params: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted average of complex parameters kept as ``re`` and ``im``."""
    joined = params.join(weights, "client", "left")
    n = _weight(F.col("num_examples"))
    return joined.groupBy(*POSITION).agg(
        *[
            _complete(F.sum(_finite(F.col(part)) * n) / F.sum(n), weights).cast("double").alias(part)
            for part in ("re", "im")
        ]
    )


def class_support_head_average(params, weights, support, heads=("head.weight", "head.bias")) -> DataFrame:
    """Weighted average, but classifier rows weigh clients by class support."""
    is_head = F.col("param").isin(*heads)
    trunk = weighted_average(params.where(~is_head), weights)
    rows = params.where(is_head).join(
        support.select("client", F.col("class_idx").alias("row"), "support"), ["client", "row"], "left"
    )
    s = F.coalesce(F.col("support"), F.lit(0)).cast("double")
    total = F.sum(s)
    value = F.when(total <= 0, F.raise_error(F.lit("a class has no support"))).otherwise(
        F.sum(_finite(F.col("value")) * s) / total
    )
    value = _complete(value, weights)
    head = rows.groupBy(*POSITION).agg(value.cast("double").alias("value"))
    return trunk.unionByName(head)


def class_balanced_client_weights(support: DataFrame) -> DataFrame:
    """``(client, weight)``: mean over classes of the client's share of each class."""
    totals = support.groupBy("class_idx").agg(F.sum("support").alias("total"))
    classes = totals.agg(F.count(F.lit(1))).scalar()
    share = F.when(
        F.col("total") <= 0, F.raise_error(F.lit("a class has no support"))
    ).otherwise(F.col("support") / F.col("total"))
    raw = support.join(totals, "class_idx").groupBy("client").agg(
        (F.sum(share.cast("double")) / classes).alias("raw")
    )
    total = raw.agg(F.sum("raw")).scalar()
    weight = F.when(F.col("raw") <= 0, F.raise_error(F.lit("a client has no support"))).otherwise(
        F.col("raw") / total
    )
    return raw.select("client", weight.cast("double").alias("weight"))


def class_balanced_average(params, support) -> DataFrame:
    """Weighted average with class-balanced client weights."""
    weights = class_balanced_client_weights(support).withColumnRenamed("weight", "num_examples")
    return weighted_average(params, weights)


def class_balanced_head_average(params, weights, support, heads=("head.weight", "head.bias")) -> DataFrame:
    """Class-balanced trunk with support-weighted classifier rows."""
    is_head = F.col("param").isin(*heads)
    trunk = class_balanced_average(params, support).where(~is_head)
    head = class_support_head_average(params.where(is_head), weights, support, heads)
    return trunk.unionByName(head)


def aggregate(mode, params, weights, support=None) -> DataFrame:
    """Averaging rule by name. Support must come from train rows only."""
    if mode == "sample":
        return weighted_average(params, weights)
    if mode == "support_head":
        return class_support_head_average(params, weights, support)
    if mode == "class_balanced":
        return class_balanced_average(params, support)
    if mode == "class_balanced_head":
        return class_balanced_head_average(params, weights, support)
    raise ValueError(f"Unknown averaging mode {mode}.")


def split_personalised(params: DataFrame, prefixes):
    """Shared and private parameters by name prefix."""
    private = F.lit(False)
    for prefix in prefixes:
        private = private | F.startswith(F.col("param"), F.lit(prefix))
    return params.where(~private), params.where(private)


def merge_personalised(shared: DataFrame, private: DataFrame, places=64) -> DataFrame:
    """Per-client states from shared ``(param, pos, row, value)`` and private rows.

    A parameter on both sides is an error. Shared rows go to ``places`` places, each of
    which holds some of the clients, and meet them there by an equality join.
    """
    clients = private.select("client").distinct().withColumn("__place", F.pmod(F.xxhash64("client"), F.lit(places)))
    repeated = private.select("param").distinct().withColumn("__both", F.lit(1))
    checked = shared.join(repeated, "param", "left").withColumn(
        "value",
        F.when(F.col("__both").isNotNull(), F.raise_error(F.lit("parameter is shared and private")))
        .otherwise(F.col("value")).cast("double"),
    )
    spread = checked.groupBy(*POSITION).agg(F.first("value").alias("value"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long")))
    copies = spread.withColumn("__place", every).join(clients, "__place")
    columns = ["client", *POSITION, "value"]
    return copies.select(*columns).unionByName(private.select(*columns))


def update_diagnostics(params, before, after, weights) -> DataFrame:
    """Per client: update norms, distance and cosine to the aggregate update.

    ``before`` and ``after`` are ``(param, pos, value)``.
    """
    keys = ["param", "pos"]
    reference = before.select(*keys, F.col("value").alias("b")).join(
        after.select(*keys, F.col("value").alias("a")), keys
    )
    v, b, a = F.col("value"), F.col("b"), F.col("a")
    sums = params.join(reference, keys).groupBy("client").agg(
        F.sum((v - b) * (v - b)).alias("delta2"),
        F.sum(b * b).alias("ref2"),
        F.sum((v - a) * (v - a)).alias("dist2"),
        F.sum((v - b) * (a - b)).alias("dot"),
        F.sum((a - b) * (a - b)).alias("agg2"),
    )
    total = weights.agg(F.sum("num_examples")).scalar()
    norm = F.sqrt("delta2")
    scale = norm * F.sqrt("agg2")
    epsilon = 2.220446049250313e-16
    return sums.join(weights, "client").select(
        "client", "num_examples",
        (F.col("num_examples") / total).alias("sample_weight"),
        norm.alias("update_l2"),
        (norm / F.greatest(F.sqrt("ref2"), F.lit(epsilon))).alias("relative_update_l2"),
        F.sqrt("dist2").alias("distance_to_aggregate_l2"),
        F.when(scale > 0, F.col("dot") / scale).otherwise(0.0).alias("cosine_to_aggregate"),
    )


def output_row_update_l2(params, before, heads=("head.weight", "head.bias")) -> DataFrame:
    """Update norm per client and classifier row, over weights and bias."""
    keys = ["param", "pos"]
    mine = params.where(F.col("param").isin(*heads))
    joined = mine.join(before.select(*keys, F.col("value").alias("b")), keys)
    d = F.col("value") - F.col("b")
    return joined.groupBy("client", "row").agg(F.sqrt(F.sum(d * d)).alias("update_l2"))


def project_classes(params: DataFrame, dropped, row_width, heads=("head.weight", "head.bias")) -> DataFrame:
    """Delete the output row of one class and close the gap in rows and positions.

    ``row_width`` maps each head parameter to its values per row.
    """
    width = F.lit(1)
    for name, size in row_width.items():
        width = F.when(F.col("param") == name, size).otherwise(width)
    is_head = F.col("param").isin(*heads)
    after = is_head & (F.col("row") > dropped)
    return params.where(~(is_head & (F.col("row") == dropped))).withColumns(
        {
            "pos": F.when(after, F.col("pos") - width).otherwise(F.col("pos")).cast("int"),
            "row": F.when(after, F.col("row") - 1).otherwise(F.col("row")).cast("int"),
        }
    )


def weighted_scalar_metrics(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Example-weighted mean of the metrics every client reports.

    ``metrics`` is ``(client, metric, value)``.
    """
    clients = weights.agg(F.count(F.lit(1))).scalar()
    joined = metrics.join(weights, "client")
    n = F.col("num_examples")
    return (
        joined.groupBy("metric")
        .agg((F.sum(F.col("value") * n) / F.sum(n)).alias("value"), F.count_distinct("client").alias("__k"))
        .where(F.col("__k") == clients)
        .drop("__k")
    )


def payload_bytes(params: DataFrame, item_size=4) -> DataFrame:
    """Upload and download bytes of one round, all clients taking part."""
    return params.agg(
        (F.count(F.lit(1)) * item_size).alias("upload_bytes"),
        (F.count(F.lit(1)) * item_size).alias("download_bytes"),
        F.count_distinct("client").alias("participants"),
    )
