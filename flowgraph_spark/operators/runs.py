"""Analytics over result tables: one row per run, round, fold or prediction file.

Runs are rows ``(protocol, model, mode, seed, scenario, metrics...)``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import metrics as mx

MEAN = "MEAN"


def select_winner(results: DataFrame, group, metric="macro_f1", by=()) -> DataFrame:
    """The group with the highest mean metric, mean rows left out; ties by name."""
    means = results.where(F.col("scenario") != MEAN).groupBy(*by, group).agg(F.avg(metric).alias(metric))
    best = F.max_by(F.struct(group, metric), F.struct(F.col(metric), F.col(group)))
    return means.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{group}", f"b.{metric}")


def pending_configs(planned: DataFrame, results: DataFrame, keys) -> DataFrame:
    """Planned configurations without results."""
    return planned.join(results.select(*keys).distinct(), list(keys), "left_anti")


def protocol_text(duration, max_flows, stride, lateness):
    """``rolling-window-v1:duration=...`` of a window candidate; numbers as %g."""

    def short(value):
        # Six significant digits, trailing zeros cut, an exponent below -4 or from 6 on.
        text = F.format_string("%.5e", value.cast("double"))
        digits, exponent = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1)
        cut = lambda number: F.regexp_replace(number, r"\.?0+$", "")
        plain = cut(text.cast("decimal(38,12)").cast("string"))
        return F.when(exponent.cast("int").between(-4, 5), plain).otherwise(F.concat(cut(digits), F.lit("e"), exponent))

    return F.concat(
        F.lit("rolling-window-v1:duration="), short(duration), F.lit("s:max-flows="),
        max_flows.cast("string"), F.lit(":stride="), stride.cast("string"),
        F.lit(":lateness="), short(lateness), F.lit("s"),
    )


def select_candidate(candidates: DataFrame) -> DataFrame:
    """Best macro-F1, then lowest p95 latency, fewest flows, shortest duration.

    Needs ``macro_f1, latency_p95, max_flows, duration, stride, lateness``.
    """
    best = candidates.orderBy(
        F.desc("macro_f1"), F.asc("latency_p95"), F.asc("max_flows"), F.asc("duration")
    ).limit(1)
    return best.withColumn(
        "graph_protocol",
        protocol_text(F.col("duration"), F.col("max_flows"), F.col("stride"), F.col("lateness")),
    )


RUN_DOCUMENT = (
    "run_id string, status string, config_digest string, dataset_digest string, model_digest string, "
    "summary struct<strategy:string, kind:string, best_round:long, epochs:long, validation_macro_f1:double, "
    "validation_metrics:map<string,double>, test_metrics:map<string,double>, "
    "total_upload_bytes:long, total_download_bytes:long>"
)
PROVENANCE = ("config_digest", "dataset_digest", "model_digest")


def compare_runs(documents: DataFrame, column="value") -> DataFrame:
    """One row per completed run with the same provenance.

    A run that is not completed, lacks a digest or has another provenance is an
    error.
    """
    runs = documents.select(F.from_json(column, RUN_DOCUMENT).alias("d")).select("d.*")
    kinds = runs.agg(F.count_distinct(F.struct(*PROVENANCE))).scalar()
    missing = F.lit(False)
    for name in PROVENANCE:
        missing = missing | F.coalesce(F.col(name) == "", F.lit(True))
    problem = (
        F.when(F.coalesce(F.col("status") != "completed", F.lit(True)), F.lit("run is not completed: "))
        .when(missing, F.lit("run lacks provenance: "))
        .when(kinds > 1, F.lit("runs are not comparable: "))
    )
    run_id = F.when(
        problem.isNotNull(), F.raise_error(F.concat(problem, F.col("run_id")))
    ).otherwise(F.col("run_id"))
    s = F.col("summary")
    return runs.select(
        run_id.cast("string").alias("run_id"),
        F.coalesce(s["strategy"], s["kind"], F.lit("unknown")).alias("strategy"),
        F.coalesce(s["best_round"], s["epochs"]).alias("best_round"),
        F.coalesce(s["validation_macro_f1"], F.try_element_at(s["validation_metrics"], F.lit("macro_f1"))).alias("validation_macro_f1"),
        F.try_element_at(s["test_metrics"], F.lit("macro_f1")).alias("test_macro_f1"),
        F.try_element_at(s["test_metrics"], F.lit("accuracy")).alias("test_accuracy"),
        F.coalesce(s["total_upload_bytes"], F.lit(0)).alias("upload_bytes"),
        F.coalesce(s["total_download_bytes"], F.lit(0)).alias("download_bytes"),
        *PROVENANCE,
    )


def best_round(rounds: DataFrame, metric="macro_f1") -> DataFrame:
    """Earliest round with the greatest metric of each run."""
    best = F.max_by("round", F.struct(F.col(metric), -F.col("round")))
    return rounds.groupBy("run_id").agg(best.alias("best_round"), F.max(metric).alias(metric))


def seed_aggregate(runs: DataFrame, group, metrics) -> DataFrame:
    """Over seeds: count, mean, population deviation, extremes and text."""
    columns = [F.count_distinct("seed").alias("seed_count")]
    for m in metrics:
        columns += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    rows = runs.groupBy(*group).agg(*columns)
    return rows.withColumns(
        {
            f"{m}_mean_std": F.format_string("%.6f ± %.6f", F.col(f"{m}_mean"), F.col(f"{m}_std"))
            for m in metrics
        }
    )


def with_mean_row(rows: DataFrame, key, metrics, by=()) -> DataFrame:
    """Append a MEAN row over the numeric columns, per ``by`` group."""
    columns = [F.avg(m).alias(m) for m in metrics]
    rolled = rows.groupingSets([[*by, key], [*by]], *by, key).agg(*columns, F.grouping(key).alias("__g"))
    return rolled.select(
        *by, F.when(F.col("__g") == 1, MEAN).otherwise(F.col(key)).alias(key), *metrics
    )


def hardest(rows: DataFrame, key, metric="macro_f1", by=()) -> DataFrame:
    """The key with the lowest metric; ties by name."""
    worst = F.min_by(F.struct(key, metric), F.struct(metric, key))
    return rows.where(F.col(key) != MEAN).groupBy(*by).agg(worst.alias("w")).select(*by, f"w.{key}", f"w.{metric}")


def baseline_vs_current(history: DataFrame, runs: DataFrame, metric="macro_f1", seed=42) -> DataFrame:
    """Historical value beside the current value at one seed and over seeds.

    Leave-one-out runs are averaged inside each seed before seeds are averaged.
    Both tables hold ``protocol`` and the metric.
    """
    per_seed = runs.groupBy("protocol", "seed").agg(F.avg(metric).alias(metric))
    current = per_seed.groupBy("protocol").agg(
        F.avg(F.when(F.col("seed") == seed, F.col(metric))).alias("current_seed_metric"),
        F.avg(metric).alias("current_mean_metric"),
    )
    past = history.groupBy("protocol").agg(F.avg(metric).alias("historical_metric"))
    return past.join(current, "protocol", "full").select(
        "protocol", "historical_metric", "current_seed_metric", "current_mean_metric"
    )


def class_support_table(support: DataFrame, protocol="protocol") -> DataFrame:
    """Flags on ``(protocol, ..., train, validation, test)`` support rows."""
    present = F.col("train") > 0
    return support.withColumns(
        {
            "present_in_train": present,
            "private_to_held_out": (F.col(protocol) == "loso") & ~present & (F.col("test") > 0),
        }
    )


def prediction_audit(predictions: DataFrame, has_train_support, classes):
    """Per field of a prediction table: exported, derived or not available, and ``filled``,
    the rows that have a value (null where the table has no such field)."""
    columns = set(predictions.columns)
    rows = [
        (c, "EXPORTED" if c in columns else "NOT_AVAILABLE")
        for c in ("seed", "protocol", "scenario", "split", "true_label", "predicted_label")
    ]
    rows.append(("held_out", "EXPORTED" if "held_out" in columns else "DERIVED_FROM_METADATA"))
    if "class_present_in_train" in columns:
        presence = "EXPORTED"
    elif "true_class_absent_from_train" in columns:
        presence = "DERIVED_FROM_EXPORTED_ABSENCE_FLAG"
    elif has_train_support and "true_label" in columns:
        presence = "DERIVED_FROM_CLASS_SUPPORT"
    else:
        presence = "NOT_AVAILABLE"
    rows.append(("class_present_in_train", presence))
    if columns >= {f"probability::{c}" for c in classes}:
        scores = "PROBABILITIES_EXPORTED"
    elif columns >= {f"logit::{c}" for c in classes}:
        scores = "LOGITS_EXPORTED"
    else:
        scores = "NOT_AVAILABLE"
    rows.append(("probabilities_or_logits", scores))
    rows.append(("entropy", "EXPORTED" if "entropy" in columns else "DERIVABLE_FROM_SCORES"))
    present = [f for f, _ in rows if f in columns]
    counts = predictions.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(f).alias(f) for f in present])
    filled = counts.select(F.map_from_arrays(F.array(*[F.lit(f) for f in present]).cast("array<string>"), F.array(*present).cast("array<long>"))).scalar()
    table = predictions.sparkSession.createDataFrame(rows, "field string, status string")
    return table.withColumn("filled", F.try_element_at(filled, F.col("field")))


def per_class_f1_matrix(runs: DataFrame, classes, metrics="test_metrics", per_class="per_class") -> DataFrame:
    """Run by class F1 from either layout.

    ``metrics`` is a map with keys ``f1-class-<i>``; ``per_class`` a map from
    class name to its F1. The first layout wins.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("class_name"),
                F.coalesce(
                    F.try_element_at(F.col(metrics), F.lit(f"f1-class-{i}")),
                    F.try_element_at(F.col(per_class), F.lit(name)),
                ).alias("f1"),
            )
            for i, name in enumerate(classes)
        ]
    )
    return runs.select("run_id", F.inline(pairs))


def learning_curve(rounds: DataFrame, metrics=("loss", "accuracy", "macro_f1", "weighted_f1")) -> DataFrame:
    """Long form of round metrics with the best macro-F1 so far."""
    so_far = Window.partitionBy("run_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    points = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return rounds.withColumn("running_best", F.max("macro_f1").over(so_far)).select(
        "run_id", "round", "running_best", F.inline(points)
    )


def unseen_classes_per_fold(df: DataFrame, scenarios, label="detailed_label", scenario="scenario") -> DataFrame:
    """Classes of the held-out scenario that no training scenario has.

    A class is unseen in a fold exactly when it occurs in one scenario only, so
    no fold repeats any rows.
    """
    owners = df.groupBy(scenario, label).agg(F.count(F.lit(1)).alias("n")).groupBy(label).agg(
        F.count(F.lit(1)).alias("k"), F.first(scenario).alias("fold")
    )
    unseen = owners.where(F.col("k") == 1).groupBy("fold").agg(F.array_sort(F.collect_set(label)).alias("unseen"))
    frame = df.sparkSession.createDataFrame([(s,) for s in scenarios], "fold string")
    empty = F.array().cast("array<string>")
    return frame.join(unseen, "fold", "left").select(
        "fold", F.size(F.coalesce("unseen", empty)).alias("n_unseen"), F.coalesce("unseen", empty).alias("unseen")
    )


def fold_records(overall: DataFrame, per_class: DataFrame, by, classes) -> DataFrame:
    """One row per fold: overall metrics and per-class F1 and support columns."""
    wide = per_class.groupBy(*by).pivot("class_idx", list(range(len(classes)))).agg(
        F.first("f1").alias("f1"), F.first("support").alias("support")
    )
    renamed = wide.select(
        *by,
        *[F.col(f"`{i}_f1`").alias(f"f1_{c}") for i, c in enumerate(classes)],
        *[F.col(f"`{i}_support`").alias(f"support_{c}") for i, c in enumerate(classes)],
    )
    return overall.join(renamed, list(by))


def in_scenario_order(rows: DataFrame, order, column="held_out") -> DataFrame:
    """Rows in the fixed scenario order, unknown ones last, then by seed."""
    position = F.lit(len(order))
    for i, name in enumerate(order):
        position = F.when(F.col(column) == name, i).otherwise(position)
    return rows.orderBy(position, "seed")


def policy_by_seed(scores: DataFrame, policies, baseline, metric="macro_f1") -> DataFrame:
    """Seed by policy score and the gain over the baseline policy.

    A seed without a score for every policy is an error.
    """
    wide = scores.groupBy("seed").pivot("policy", list(policies)).agg(F.avg(metric))
    missing = F.lit(False)
    for p in policies:
        missing = missing | F.col(f"`{p}`").isNull()
    seed = F.when(missing, F.raise_error(F.lit("a seed lacks a policy"))).otherwise(F.col("seed"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(p).alias("policy"), F.col(f"`{p}`").alias("score"),
                (F.col(f"`{p}`") - F.col(f"`{baseline}`")).alias("delta"),
            )
            for p in policies
        ]
    )
    return wide.select(seed.cast("int").alias("seed"), F.inline(pairs))


IDENTITY_COLUMNS = ("row_id", "scenario", "true_label", "predicted_label")


def analysable_predictions(predictions: DataFrame, runs: DataFrame, taxonomy, run="run_id", identity=IDENTITY_COLUMNS) -> DataFrame:
    """Per run: AVAILABLE, or why its predictions cannot be analysed."""
    missing = sorted(set(identity) - set(predictions.columns))
    if missing:
        return runs.select(
            run, F.lit("NOT_AVAILABLE").alias("status"),
            F.lit(f"missing identity fields: {', '.join(missing)}").alias("reason"),
        )
    outside = [
        F.count_if(~F.coalesce(F.col(c).isin(*taxonomy), F.lit(False))) for c in ("true_label", "predicted_label")
    ]
    counts = predictions.groupBy(run).agg(
        F.count(F.lit(1)).alias("rows"), (outside[0] + outside[1]).alias("unknown")
    )
    rows = runs.join(counts, run, "left")
    reason = (
        F.when(F.coalesce("rows", F.lit(0)) == 0, "no rows")
        .when(F.col("unknown") > 0, "labels outside the taxonomy").otherwise("")
    )
    return rows.select(
        run, F.when(reason == "", "AVAILABLE").otherwise("NOT_AVAILABLE").alias("status"), reason.alias("reason")
    )


def _with_total(df: DataFrame, client) -> DataFrame:
    """Every row under its client and under ALL."""
    return df.withColumn(client, F.explode(F.array(F.col(client), F.lit("ALL"))))


def routed_report(df: DataFrame, num_classes, client="client") -> DataFrame:
    """Per client and merged metrics beside confidence and entropy summaries."""
    rows = _with_total(
        cut_lineage(df.select(client, "true_idx", "pred_idx", "confidence", "entropy")), client
    )
    matrix = mx.confusion(rows, num_classes, [client])
    report = mx.overall_metrics(mx.per_class_metrics(matrix, [client]), [client])
    for value in ("confidence", "entropy"):
        summary = mx.numeric_summary(rows, [client], value).select(
            client, F.col("p50").alias(f"{value}_p50"), F.col("p95").alias(f"{value}_p95")
        )
        report = report.join(summary, client)
    return report


def personalised_report(scored: DataFrame, num_classes, client="client") -> DataFrame:
    """Own-head predictions per client and merged, with the example-weighted loss.

    ``scored`` holds ``probabilities`` of each client's own head. Weighting the
    client losses by their examples is the mean over all rows.
    """
    p_true = F.element_at("probabilities", F.col("true_idx") + 1)
    rows = cut_lineage(
        scored.select(
            client, "true_idx", "pred_idx", (-F.log(F.greatest(p_true, F.lit(1e-12)))).alias("loss")
        )
    )
    every = _with_total(rows, client)
    matrix = mx.confusion(every, num_classes, [client])
    overall = mx.overall_metrics(mx.per_class_metrics(matrix, [client]), [client])
    return overall.join(every.groupBy(client).agg(F.avg("loss").alias("loss")), client)
