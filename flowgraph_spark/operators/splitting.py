"""Per-class splits, split checks and leave-one-scenario-out folds.

Random order is hash order: it does not depend on partitioning and gives the
same split on every run. A class is cut at the hash of the rows where its parts
meet, so rows are compared with a bound and no class is sorted. Rows without a
label are a class of their own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import hash_order, hash_segments, membership_digest
from ..schema import SPLITS
from .sampling import undersample


def split_sizes(n, ratios):
    """Train and validation counts of a class of ``n`` rows, as expressions."""
    train_ratio, val_ratio, _ = ratios
    train = F.when(n == 1, 1).otherwise(
        F.greatest(F.lit(1), F.floor(n * F.lit(float(train_ratio))))
    )
    floor_val = F.floor(n * F.lit(float(val_ratio)))
    wanted = (
        F.when(n == 1, 0).when((n >= 3) & (floor_val == 0), 1).otherwise(floor_val)
    )
    validation = F.when(
        (n > 1) & (train + wanted >= n), F.greatest(F.lit(0), n - train - 1)
    ).otherwise(wanted)
    return train, validation


def split_per_class(df: DataFrame, keys, row_id, ratios=(0.7, 0.1, 0.2), seed=42) -> DataFrame:
    """Train / validation / test per class; singletons go to train."""
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("Split ratios must sum to 1.")

    def cuts(n):
        train, validation = split_sizes(n, ratios)
        return [train, train + validation]

    cut = hash_segments(df, keys, hash_order(seed, row_id), cuts, segment="__segment")
    name = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("__segment") + 1)
    return cut.withColumn("split", name).drop("__segment")


def split_stratified(df: DataFrame, label, row_id, ratios=(0.7, 0.1, 0.2), seed=42, by=()) -> DataFrame:
    """Proportional split per class, singletons in train, by the rule of
    :func:`split_per_class`; library tie-breaking of remainders is not kept."""
    return split_per_class(df, [*by, label], row_id, ratios, seed)


def train_validation_split(df: DataFrame, label, row_id, val_ratio=0.1, seed=42, by=()) -> DataFrame:
    """Only validation is cut off; singletons stay in train.

    Per class ``floor(n * ratio)`` rows, at least one when the class has two.
    """

    def cuts(n):
        validation = F.when(n == 1, 0).otherwise(
            F.greatest(F.lit(1), F.floor(n * F.lit(float(val_ratio))))
        )
        return [n - validation]

    cut = hash_segments(df, [*by, label], hash_order(seed, row_id), cuts, segment="__segment")
    return cut.withColumn(
        "split", F.when(F.col("__segment") == 0, SPLITS[0]).otherwise(SPLITS[1])
    ).drop("__segment")


def split_plan_checks(df: DataFrame, by, row_id, source=None) -> DataFrame:
    """Per group: counts per split, identities seen twice or in two splits.

    With ``source`` the plan must also hold exactly its identities.
    """
    per_id = df.groupBy(*by, row_id).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("split").alias("splits"),
        F.first("split").alias("split"),
    )
    if source is not None:
        expected = source.select(*by, row_id).withColumn("__expected", F.lit(1))
        per_id = per_id.join(expected, [*by, row_id], "full")
        outside = F.count_if(F.col("__expected").isNull() | F.col("rows").isNull())
    else:
        outside = F.lit(0).cast("long")
    return per_id.groupBy(*by).agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
        F.count_if(F.col("rows") > 1).alias("duplicate_ids"),
        F.count_if(F.col("splits") > 1).alias("overlapping_ids"),
        outside.alias("coverage_errors"),
    )


def split_digest(df: DataFrame, by, row_id) -> DataFrame:
    """Fingerprint of the identities of each split."""
    return membership_digest(df, [*by, "split"], F.col(row_id))


def loso_rows(df: DataFrame, scenarios, scenario="scenario") -> DataFrame:
    """Every row once per fold: ``fold`` is the scenario held out.

    The list of folds is the caller's; each row is repeated that many times,
    which is what leave-one-out evaluates. There is no join.
    """
    folds = F.explode(F.array(*[F.lit(s) for s in scenarios]))
    return df.withColumn("fold", folds).withColumn(
        "held_out", F.col("fold") == F.col(scenario)
    )


def loso_folds(df: DataFrame, scenarios, label, row_id, val_ratio=0.1, seed=42, scenario="scenario") -> DataFrame:
    """``(fold, row, role)``: the held-out scenario is test, others train or
    validation. The split inside a fold is per class over the other scenarios."""
    rows = loso_rows(df, scenarios, scenario)
    test = rows.where("held_out").withColumn("role", F.lit("test"))
    rest = train_validation_split(
        rows.where("not held_out"), label, row_id, val_ratio, seed, by=["fold"]
    ).withColumnRenamed("split", "role")
    return rest.unionByName(test).drop("held_out")


def undersample_train_only(df: DataFrame, row_id, seed, label="detailed_label") -> DataFrame:
    """Shrink the train membership; validation and test stay as they are."""
    train = undersample(df.where(F.col("split") == "train"), row_id, seed, label)
    return train.unionByName(df.where(F.col("split") != "train"))


def support_by_split(df: DataFrame, taxonomy, label="detailed_label", by=()) -> DataFrame:
    """Class counts per split, zero-filled over the taxonomy."""
    counts = df.groupBy(*by, label).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    classes = F.explode(F.array(*[F.lit(c) for c in taxonomy])).alias(label)
    if by:
        frame = df.select(*by).distinct().select(*by, classes)
    else:
        frame = df.sparkSession.range(1).select(classes)
    joined = frame.join(counts, [*by, label], "left")
    return joined.select(*by, label, *[F.coalesce(s, F.lit(0)).alias(s) for s in SPLITS])


def heldout_rows(df: DataFrame, dropped_class, label="detailed_label") -> DataFrame:
    """Validation and test rows without the removed class, ordinals untouched."""
    return df.where((F.col(label) != dropped_class) & F.col("split").isin("validation", "test"))


def check_counts(df: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Groups whose row count differs from ``expected(keys..., rows)``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    joined = counts.join(expected, list(keys), "full")
    return joined.select(
        *keys, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("rows", F.lit(0)).alias("rows")
    ).where(F.col("actual") != F.col("rows"))
