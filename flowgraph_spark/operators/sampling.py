"""Per-class sampling, undersampling and class weights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import hash_order, hash_segments, rank_in_groups


def null_label_count(df: DataFrame, label="detailed_label") -> DataFrame:
    """Rows without a label, which class-based samples take as a class of its own."""
    return df.agg(F.count_if(F.col(label).isNull()).alias("null_labels"))


def sample_bottom_k(df: DataFrame, keys, row_id, cap, seed) -> DataFrame:
    """Uniform sample of ``cap`` rows per group: the smallest hash priorities.

    ``cap`` None keeps all. A null key is a group of its own. Rows are compared
    with the hash at the cap, so no group is sorted.
    """
    if cap is None:
        return df
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    cut = hash_segments(df, keys, hash_order(seed, row_id), lambda n: [limit], segment="__segment")
    return cut.where(F.col("__segment") == 0).drop("__segment")


def cap_first_come(df: DataFrame, keys, position, cap) -> DataFrame:
    """First ``cap`` rows per group in file order; a null key is a group of its own."""
    return rank_in_groups(df, keys, [position], rank="__rank", limit=cap).drop("__rank")


def class_counts(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def undersample_target(df: DataFrame, label="detailed_label", min_keep=None) -> DataFrame:
    """One row: the second-largest class count, or the only one, or ``min_keep``."""
    largest = class_counts(df, [label]).orderBy(F.desc("n")).limit(2)
    target = largest.agg(F.min("n").alias("target"))
    if min_keep is not None:
        target = target.select(F.least("target", F.lit(min_keep)).alias("target"))
    return target


def undersample(df: DataFrame, row_id, seed, label="detailed_label", min_keep=None) -> DataFrame:
    """Cut classes above the target down to it; smaller classes stay whole."""
    target = undersample_target(df, label, min_keep).scalar()
    return sample_bottom_k(df, [label], row_id, target, seed)


def undersample_impact(before: DataFrame, after: DataFrame, endpoints=("orig_h", "resp_h")) -> DataFrame:
    """Edges and nodes before and after, and nodes lost to undersampling."""

    def nodes(df, flag):
        ends = df.select(F.explode(F.array(*endpoints)).alias("node")).distinct()
        return ends.withColumn(flag, F.lit(1))

    both = nodes(before, "b").join(nodes(after, "a"), "node", "full")
    node_counts = both.agg(
        F.count("b").alias("nodes_before"),
        F.count("a").alias("nodes_after"),
        F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("isolated_nodes"),
    )
    edges_before = before.agg(F.count(F.lit(1)).alias("edges_before"))
    edges_after = after.agg(F.count(F.lit(1)).alias("edges_after"))
    return node_counts.select(
        edges_before.scalar().alias("edges_before"), edges_after.scalar().alias("edges_after"), "*"
    )


def class_weights(df: DataFrame, label="detailed_label", by=(), taxonomy=None) -> DataFrame:
    """Balanced weights ``n / (k * count)``, ``k`` classes with support.

    With ``taxonomy`` every class appears and a class without rows weighs 0.
    ``by`` gives weights per client; without it they are global.
    """
    counts = class_counts(df, [*by, label])
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    if taxonomy is not None:
        groups = totals.withColumn(label, F.explode(F.array(*[F.lit(c) for c in taxonomy])))
        rows = groups.join(counts, [*by, label], "left")
    elif by:
        rows = counts.join(totals, list(by))
    else:
        rows = counts.select(
            "*", totals.select("total").scalar().alias("total"), totals.select("k").scalar().alias("k")
        )
    return rows.select(
        *by,
        label,
        F.coalesce("n", F.lit(0)).alias("support"),
        F.when(F.col("n") > 0, F.col("total") / (F.col("k") * F.col("n"))).otherwise(0.0).alias("weight"),
    )


def imbalance_variants(df: DataFrame, row_id, seed, label="detailed_label"):
    """Full rows, undersampled rows and class weights, from one input."""
    return {
        "full": df,
        "undersampled": undersample(df, row_id, seed, label),
        "weights": class_weights(df, label),
    }
