"""Classification and uncertainty metrics from additive counts.

Everything starts from confusion counts or from per-score counts, which merge
across partitions, clients and runs. ``by`` columns separate reports.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.ordering import (
    exact_quantiles,
    previous_value,
    running_sums,
    value_counts,
)
from ..session import cut_lineage


def class_frame(df: DataFrame, by, num_classes) -> DataFrame:
    """``(by..., class_idx)`` for every class, K rows per group."""
    classes = F.explode(F.expr(f"sequence(0, {num_classes - 1})")).alias("class_idx")
    if by:
        return df.select(*by).distinct().select(*by, classes)
    return df.sparkSession.range(1).select(classes)


def confusion(df: DataFrame, num_classes, by=(), true="true_idx", pred="pred_idx") -> DataFrame:
    """Dense ``(by..., true_idx, pred_idx, n)``; indexes outside [0, K) fail."""
    inside = (F.col(true) >= 0) & (F.col(true) < num_classes) & (F.col(pred) >= 0) & (F.col(pred) < num_classes)
    checked = F.when(F.coalesce(inside, F.lit(False)), F.col(true)).otherwise(
        F.raise_error(F.lit("label outside the class space"))
    )
    counts = df.groupBy(*by, checked.cast("int").alias("true_idx"), F.col(pred).cast("int").alias("pred_idx")).agg(
        F.count(F.lit(1)).alias("n")
    )
    frame = class_frame(counts, by, num_classes).withColumnRenamed("class_idx", "true_idx").withColumn(
        "pred_idx", F.explode(F.expr(f"sequence(0, {num_classes - 1})"))
    )
    return frame.join(counts, [*by, "true_idx", "pred_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merge_confusions(matrices: DataFrame, by=()) -> DataFrame:
    """Sum of client matrices; F1 values are never averaged."""
    return matrices.groupBy(*by, "true_idx", "pred_idx").agg(F.sum("n").alias("n"))


def confusion_problems(matrices: DataFrame, weights: DataFrame, num_classes, client="client") -> DataFrame:
    """Clients whose matrix has another class space or another total than their weight."""
    sizes = matrices.groupBy(client).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total"))
    joined = sizes.join(weights, client, "full")
    return joined.where(
        F.coalesce(F.col("cells") != num_classes * num_classes, F.lit(True))
        | F.coalesce(F.col("total") != F.col("num_examples"), F.lit(True))
    )


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def per_class_metrics(matrix: DataFrame, by=(), null_when_unsupported=False) -> DataFrame:
    """Precision, recall, F1 and support per class; zero division gives 0."""
    hit = F.col("true_idx") == F.col("pred_idx")
    sides = F.inline(
        F.array(
            F.struct(
                F.col("true_idx").alias("class_idx"), F.col("n").alias("support"),
                F.lit(0).cast("long").alias("predicted"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            ),
            F.struct(
                F.col("pred_idx").alias("class_idx"), F.lit(0).cast("long").alias("support"),
                F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"),
            ),
        )
    )
    sums = matrix.select(*by, sides).groupBy(*by, "class_idx").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    rows = sums.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))}
    )
    p, r = F.col("precision"), F.col("recall")
    rows = rows.withColumn("f1", _ratio(2.0 * p * r, p + r))
    if null_when_unsupported:
        rows = rows.select(
            *by, "class_idx", "support", "tp", F.col("f1").alias("__f1"),
            *[F.when(F.col("support") > 0, F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
        )
        return rows
    return rows.select(*by, "class_idx", "support", "tp", "precision", "recall", "f1")


def overall_metrics(per_class: DataFrame, by=()) -> DataFrame:
    """Accuracy, macro-F1 over all classes and support-weighted F1."""
    f1 = F.col("__f1") if "__f1" in per_class.columns else F.col("f1")
    total = F.sum("support")
    return per_class.groupBy(*by).agg(
        total.alias("num_examples"),
        F.when(total > 0, F.sum("tp") / total).otherwise(0.0).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.when(total > 0, F.sum(f1 * F.col("support")) / total).otherwise(0.0).alias("weighted_f1"),
    )


def classification_metrics(df: DataFrame, num_classes, by=()) -> DataFrame:
    return overall_metrics(per_class_metrics(confusion(df, num_classes, by), by), by)


def seen_class_macro_f1(matrix: DataFrame, train_support: DataFrame, by=()) -> DataFrame:
    """Macro-F1 over classes with train support that occur in the truth; null if none.

    ``train_support`` is ``(class_idx, train_support)``.
    """
    rows = per_class_metrics(matrix, by).join(train_support, "class_idx", "left")
    seen = (F.coalesce("train_support", F.lit(0)) > 0) & (F.col("support") > 0)
    return rows.groupBy(*by).agg(F.avg(F.when(seen, F.col("f1"))).alias("seen_class_macro_f1"))


def binary_metrics(df: DataFrame, benign_idx, by=(), true="true_idx", pred="pred_idx") -> DataFrame:
    """Benign against everything else: accuracy and scores of the malicious side."""
    t, p = F.col(true) != benign_idx, F.col(pred) != benign_idx
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("same"),
        F.count_if(t & p).alias("tp"), F.count_if(t).alias("truth"), F.count_if(p).alias("called"),
    )
    rows = sums.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("called")), "recall": _ratio(F.col("tp"), F.col("truth"))}
    )
    pr, re = F.col("precision"), F.col("recall")
    return rows.select(
        *by, (F.col("same") / F.col("n")).alias("accuracy"), pr.alias("malicious_precision"),
        re.alias("malicious_recall"), _ratio(2.0 * pr * re, pr + re).alias("malicious_f1"),
    )


def probabilities_and_entropy(df: DataFrame, probabilities="probabilities", logits="logits") -> DataFrame:
    """Checked probabilities, else the softmax of logits, with entropy and source.

    Bad rows keep null probabilities and say why in ``score_error``.
    """
    has_logits, has_probabilities = logits in df.columns, probabilities in df.columns
    if has_probabilities:
        source = F.col(probabilities)
        error = F.when(
            ~vx.probabilities_valid(source), F.lit("probabilities must be finite, in [0,1] and sum to 1")
        )
        name = "probabilities"
    elif has_logits:
        finite = F.forall(
            F.col(logits), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        )
        source = vx.softmax(F.col(logits))
        error = F.when(~F.coalesce(finite, F.lit(False)), F.lit("logits must be finite"))
        name = "logits"
    else:
        raise ValueError("Neither probabilities nor logits are present.")
    kept = [c for c in df.columns if c not in (probabilities, logits)]
    rows = df.select(*kept, error.alias("score_error"), source.alias("__p"))
    good = F.col("score_error").isNull()
    return rows.select(
        *kept, F.when(good, F.col("__p")).alias("probabilities"),
        F.when(good, vx.entropy_clipped(F.col("__p"))).alias("entropy"),
        F.lit(name).alias("entropy_source"), "score_error",
    )


def ranking_scores(df: DataFrame, by, score, target) -> DataFrame:
    """Exact AUROC (ties averaged) and average precision (ties grouped).

    Rows are counted per distinct score first; the running sums over scores run
    in ranges, so neither a popular score nor many scores meet in one
    task. Null unless both classes are present. A row without a score is an error.
    """
    positive = F.col(target).cast("int") == 1
    scored = F.when(F.col(score).isNull(), F.raise_error(F.lit("a row has no score"))).otherwise(F.col(score))
    rows = df.withColumn("__s", scored.cast(dict(df.dtypes)[score]))
    counts = cut_lineage(
        rows.groupBy(*by, "__s").agg(
            F.count_if(positive).alias("__pos"), F.count_if(~positive).alias("__neg")
        )
    )
    rows = running_sums(counts, list(by), ["__s"], {"cp": F.col("__pos"), "cn": F.col("__neg")})
    pos, neg = F.col("__pos").cast("double"), F.col("__neg").cast("double")
    below = F.col("cn") - F.col("__neg")
    tp = F.col("cp_total") - F.col("cp") + F.col("__pos")
    fp = F.col("cn_total") - F.col("cn") + F.col("__neg")
    p, n = F.max("cp_total"), F.max("cn_total")
    both = (p > 0) & (n > 0)
    return rows.groupBy(*by).agg(
        p.alias("positive_count"), n.alias("negative_count"),
        F.when(both, F.sum(pos * (below + neg / 2)) / (p.cast("double") * n)).alias("auroc"),
        F.when(both, F.sum(pos * (tp / (tp + fp))) / p).alias("auprc"),
    )


def describe(df: DataFrame, by, value, extremes=()) -> DataFrame:
    """Count, mean, population deviation, quartiles, extremes per group.

    All of it comes from the distinct values and their counts. The deviation is
    taken around the group mean, not as a difference of squares.
    """
    by = list(by)
    fractions = {"q25": 0.25, "median": 0.5, "q75": 0.75, **dict(extremes)}
    counts = value_counts(df, by, value)
    n, x = F.col("n"), F.col(value)
    first = counts.groupBy(*by).agg(
        F.sum("n").alias("count"), (F.sum(x * n) / F.sum("n")).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    spread = counts.join(first, by).groupBy(*by).agg(
        F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / F.sum("n")).alias("std")
    )
    return first.join(spread, by).join(exact_quantiles(counts, by, value, fractions), by)


def entropy_memberships(df: DataFrame, five=True, benign_idx=0) -> DataFrame:
    """One row per group a prediction belongs to; groups may overlap.

    Needs ``absent`` (class without train support), ``true_idx``, ``pred_idx``.
    """
    absent, correct = F.col("absent"), F.col("true_idx") == F.col("pred_idx")
    groups = {
        "known_correct": ~absent & correct,
        "known_incorrect": ~absent & ~correct,
        "absent_from_train": absent,
    }
    if five:
        groups["benign"] = F.col("true_idx") == benign_idx
        groups["malicious"] = F.col("true_idx") != benign_idx
    member = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in groups.items()]))
    return df.withColumn("group", F.explode(member))


def entropy_groups(df: DataFrame, five=True, benign_idx=0) -> DataFrame:
    """Entropy summary of three or five groups."""
    rows = entropy_memberships(df, five, benign_idx)
    return describe(rows, ["group"], "entropy", () if five else {"q05": 0.05, "q95": 0.95}.items())


# The comparisons of the entropy report.
PAIRINGS = (
    ("absent_from_train vs known_correct", "absent_from_train", "known_correct"),
    ("known_incorrect vs known_correct", "known_incorrect", "known_correct"),
    ("malicious vs benign", "malicious", "benign"),
)
NEEDS_BOTH = "Requires at least one positive and one negative sample."


def entropy_detection(df: DataFrame, benign_idx=0) -> DataFrame:
    """AUROC and average precision of entropy for the three comparisons."""
    rows = entropy_memberships(df, True, benign_idx)
    sides = F.array_compact(
        F.array(
            *[
                F.when(F.col("group") == g, F.struct(F.lit(name).alias("comparison"), F.lit(t).alias("target")))
                for name, positive, negative in PAIRINGS
                for g, t in ((positive, 1), (negative, 0))
            ]
        )
    )
    paired = rows.select("entropy", F.inline(sides))
    scores = ranking_scores(paired, ["comparison"], "entropy", "target")
    frame = df.sparkSession.createDataFrame([(name,) for name, _, _ in PAIRINGS], "comparison string")
    both = F.col("auroc").isNotNull()
    return frame.join(scores, "comparison", "left").select(
        "comparison", "auroc", "auprc",
        F.coalesce("positive_count", F.lit(0)).alias("positive_count"),
        F.coalesce("negative_count", F.lit(0)).alias("negative_count"),
        F.when(both, "AVAILABLE").otherwise("NOT_AVAILABLE").alias("status"),
        F.when(both, "").otherwise(NEEDS_BOTH).alias("reason"),
    )


def threshold_tradeoff(df: DataFrame, thresholds, benign_idx, by=()) -> DataFrame:
    """Alert rates at each confidence threshold, all from one aggregation."""
    if any(not 0.0 <= t <= 1.0 for t in thresholds):
        raise ValueError("Thresholds must be in [0, 1].")
    benign = F.col("true_idx") == benign_idx
    called = F.col("pred_idx") != benign_idx
    counts = [F.count_if(benign).alias("benign"), F.count_if(~benign).alias("malicious")]
    for i, t in enumerate(thresholds):
        alert = called & (F.col("confidence") >= float(t))
        counts += [
            F.count_if(alert).alias(f"a_{i}"),
            F.count_if(alert & benign).alias(f"f_{i}"),
            F.count_if(alert & ~benign).alias(f"m_{i}"),
            F.count_if(alert & ~benign & (F.col("pred_idx") == F.col("true_idx"))).alias(f"c_{i}"),
        ]
    wide = df.groupBy(*by).agg(*counts)
    each = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("confidence_threshold"), F.col(f"a_{i}").alias("alert_count"),
                F.col(f"f_{i}").alias("benign_false_alerts"), F.col(f"m_{i}").alias("malicious_alerts"),
                F.col(f"c_{i}").alias("correct_class_alerts"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    rows = wide.select(*by, "benign", "malicious", F.inline(each))

    def rate(top, bottom):
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))

    return rows.select(
        *by, "confidence_threshold", "alert_count", F.col("benign").alias("benign_support"),
        "benign_false_alerts", rate("benign_false_alerts", "benign").alias("benign_false_alert_rate"),
        F.col("malicious").alias("malicious_support"), "malicious_alerts",
        rate("malicious_alerts", "malicious").alias("malicious_alert_recall"),
        "correct_class_alerts", rate("correct_class_alerts", "malicious").alias("correct_class_alert_recall"),
        rate("malicious_alerts", "alert_count").alias("alert_precision_malicious"),
    )


def adjacent_agreement(df: DataFrame, client, order, pred="pred_idx", by=()) -> DataFrame:
    """Mean over clients of the share of equal consecutive predictions."""
    rows = previous_value(df, [*by, client], order, F.col(pred), "__previous")
    shares = rows.where(F.col("__previous").isNotNull()).groupBy(*by, client).agg(
        F.avg((F.col(pred) == F.col("__previous")).cast("double")).alias("share")
    )
    return shares.groupBy(*by).agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("adjacent_agreement"))


def numeric_summary(df: DataFrame, by, value) -> DataFrame:
    """Min, mean, median, 95th percentile and max; percentiles are actual values."""
    by = list(by)
    counts = value_counts(df, by, value)
    n, x = F.col("n"), F.col(value)
    base = counts.groupBy(*by).agg(
        F.min(x).alias("min"), (F.sum(x * n) / F.sum("n")).alias("mean"), F.max(x).alias("max")
    )
    ranks = exact_quantiles(counts, by, value, {"p50": 0.5, "p95": 0.95}, nearest=True)
    if not by:
        return base.select(
            "min", "mean", ranks.select("p50").scalar().alias("p50"), ranks.select("p95").scalar().alias("p95"), "max"
        )
    return base.join(ranks, by).select(*by, "min", "mean", "p50", "p95", "max")


def row_normalised(matrix: DataFrame, by=()) -> DataFrame:
    """Confusion rows as shares; an empty row is all zero."""
    totals = matrix.groupBy(*by, "true_idx").agg(F.sum("n").alias("__t"))
    return matrix.join(totals, [*by, "true_idx"]).select(
        *by, "true_idx", "pred_idx", _ratio(F.col("n"), F.col("__t")).alias("share")
    )


def weighted_loss(losses: DataFrame, by=()) -> DataFrame:
    """``sum(loss * n) / sum(n)`` of ``(loss, num_examples)`` rows."""
    n = F.col("num_examples")
    return losses.groupBy(*by).agg((F.sum(F.col("loss") * n) / F.sum(n)).alias("loss"))


def cross_head_f1(df: DataFrame, num_classes, head="head") -> DataFrame:
    """Head by class F1 from the head's merged matrix; null without support."""
    rows = per_class_metrics(confusion(df, num_classes, [head]), [head], null_when_unsupported=True)
    return rows.select(head, "class_idx", "support", "f1")


def oracle_mapping(cross: DataFrame, head="head") -> DataFrame:
    """Best head per class; equal scores go to the greatest head name."""
    best = F.max_by(F.col(head), F.struct("f1", head))
    return cross.where(F.col("f1").isNotNull()).groupBy("class_idx").agg(best.alias(head))


def oracle_evaluate(df: DataFrame, mapping: DataFrame, num_classes, head="head") -> DataFrame:
    """Confusion when each row uses the head mapped to its true class.

    A class with rows but without a mapped head is an error.
    """
    chosen = mapping.select(F.col("class_idx").alias("true_idx"), F.col(head).alias("__chosen"))
    rows = df.join(chosen, "true_idx", "left")
    own = F.when(
        F.col("__chosen").isNull(), F.raise_error(F.concat(F.lit("no head for class "), F.col("true_idx").cast("string")))
    ).otherwise(F.col(head) == F.col("__chosen"))
    return confusion(rows.where(own).drop("__chosen"), num_classes)


#: Classes whose train support travels to the rows as a map.
SUPPORT_CLASSES = 10_000


def with_train_support(df: DataFrame, train: DataFrame, true="true_idx", max_classes=SUPPORT_CLASSES) -> DataFrame:
    """Attach the train support of the true class and the absence flag.

    The supports of up to ``max_classes`` classes go to the rows as one map, so no row is
    shuffled; more are joined.
    """
    support = train.groupBy(F.col(true)).agg(F.count(F.lit(1)).alias("train_support"))
    known = support.where(F.col(true).isNotNull()).limit(max_classes + 1).collect()
    if len(known) > max_classes:
        joined = df.join(support, true, "left")
    else:
        pairs = [F.lit(v) for row in known for v in (row[true], row["train_support"])]
        found = F.try_element_at(F.create_map(*pairs), F.col(true)) if pairs else F.lit(None)
        joined = df.withColumn("train_support", found.cast("long"))
    return joined.withColumns(
        {
            "train_support": F.coalesce("train_support", F.lit(0)),
            "absent": F.col("train_support").isNull(),
        }
    )


def prediction_export(df: DataFrame, train: DataFrame, classes) -> DataFrame:
    """Prediction rows with labels, entropy, support and a probability map."""
    rows = with_train_support(probabilities_and_entropy(df), train)
    names = F.array(*[F.lit(c) for c in classes])
    return rows.withColumns(
        {
            "true_label": F.element_at(names, F.col("true_idx") + 1),
            "predicted_label": F.element_at(names, F.col("pred_idx") + 1),
            "probability": F.map_from_arrays(names, F.col("probabilities")),
        }
    ).drop("probabilities", "score_error", "entropy_source").withColumnRenamed(
        "absent", "true_class_absent_from_train"
    ).withColumnRenamed("train_support", "true_class_train_support")
