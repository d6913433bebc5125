"""Run, round and fold tables derived from the scored flow view."""

from pyspark.sql import functions as F

from ..operators import metrics, neighbors, runs
from ..operators.splitting import support_by_split
from ..sources import logs
from . import views
from .graph_queries import (
    BY as GRAPH_BY,
    REPR_WIDTH,
    SCORE_HEADS,
    representation,
    scored_sql,
)
from .metric_queries import BASE as PREDICTED
from .metric_queries import K, SCORED, confusion_sql, overall_sql, per_class_sql, round_all
from .split_queries import SPLIT_LABELLED, split_labelled
from .views import CLASSES, EDGE_CLASSES, SENSORS, rounded_sql

SEEDS, MODELS, MODES = (42, 1337, 2026), ("gat", "gcn", "sage"), ("class_weight", "none", "undersample")
PROTOCOLS = ("loso", "pooled")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def results(spark, sf_dir):
    """One row per (protocol, model, mode, seed, scenario) from disjoint flow shares."""
    s = F.col("seq")
    correct = (F.col("true_idx") == F.col("pred_idx")).cast("double")
    return views.predictions(spark, sf_dir).groupBy(
        _pick(PROTOCOLS, s).alias("protocol"), _pick(MODELS, F.floor(s / 2)).alias("model"),
        _pick(MODES, F.floor(s / 6)).alias("mode"), _pick(SEEDS, F.floor(s / 18)).alias("seed"),
        F.col("client").alias("scenario"),
    ).agg(
        F.avg(correct * F.col("confidence")).alias("macro_f1"), F.avg(correct).alias("accuracy"),
        F.avg("confidence").alias("weighted_f1"),
    )


def _pick_sql(values, index):
    return f"{list(values)!r}[({index}) % {len(values)} + 1]"


RESULTS = f"""{PREDICTED}, results AS (SELECT {_pick_sql(PROTOCOLS, 'seq')} AS protocol, {_pick_sql(MODELS, 'seq // 2')} AS model,
  {_pick_sql(MODES, 'seq // 6')} AS mode, {_pick_sql(SEEDS, 'seq // 18')} AS seed, client AS scenario,
  avg(CAST(true_idx = pred_idx AS DOUBLE) * confidence) AS macro_f1, avg(CAST(true_idx = pred_idx AS DOUBLE)) AS accuracy,
  avg(confidence) AS weighted_f1 FROM predictions GROUP BY ALL)"""


def rounds(spark, sf_dir):
    """Twenty rounds per run, one run per scenario."""
    correct = (F.col("true_idx") == F.col("pred_idx")).cast("double")
    return views.predictions(spark, sf_dir).groupBy(
        F.col("client").alias("run_id"), (F.col("seq") % 20 + 1).alias("round")
    ).agg(
        F.round(F.avg(1 - F.col("confidence")), 6).alias("loss"), F.round(F.avg(correct), 6).alias("accuracy"),
        F.round(F.avg(correct * F.col("confidence")), 6).alias("macro_f1"),
        F.round(F.avg("confidence"), 6).alias("weighted_f1"),
    )


ROUNDS = f"""{PREDICTED}, rounds AS (SELECT client AS run_id, seq % 20 + 1 AS round, round(avg(1 - confidence), 6) AS loss,
  round(avg(CAST(true_idx = pred_idx AS DOUBLE)), 6) AS accuracy, round(avg(CAST(true_idx = pred_idx AS DOUBLE) * confidence), 6) AS macro_f1,
  round(avg(confidence), 6) AS weighted_f1 FROM predictions GROUP BY ALL)"""


def _round_logs(spark, sf_dir):
    """Rounds written as JSON with either spelling of a key, then read back."""
    r = rounds(spark, sf_dir)
    even = F.col("round") % 2 == 0
    lines = r.select(
        F.to_json(
            F.struct(
                "run_id", "round", "loss", "accuracy", F.when(even, F.col("macro_f1")).alias("macro_f1"),
                F.when(~even, F.col("macro_f1")).alias("macro-f1"), F.col("weighted_f1").alias("weighted-f1"),
            )
        ).alias("value")
    )
    parsed = lines.select(F.from_json("value", logs.ROUND_SCHEMA).alias("d")).select("d.*")
    return logs.normalise_rounds(parsed)


def _contiguity(spark, sf_dir):
    """Rounds of every second run start at 2."""
    odd = F.substring("run_id", -1, 1).cast("int") % 2
    return logs.round_contiguity(rounds(spark, sf_dir).withColumn("round", F.col("round") + odd))


def _history(spark, sf_dir):
    """Curves packed into one document per run and flattened again."""
    points = rounds(spark, sf_dir).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("round", "loss", "macro_f1"))).alias("history")
    )
    return logs.flatten_history(points)


def _compare(spark, sf_dir):
    """Summary documents of the runs, as JSON."""
    best = runs.best_round(rounds(spark, sf_dir))
    tests = rounds(spark, sf_dir).groupBy("run_id").agg(
        F.max("accuracy").alias("a"), F.max("macro_f1").alias("m"), F.count(F.lit(1)).alias("n")
    )
    documents = best.join(tests, "run_id").select(
        F.to_json(
            F.struct(
                "run_id", F.lit("completed").alias("status"), F.lit("c1").alias("config_digest"),
                F.lit("d1").alias("dataset_digest"), F.lit("m1").alias("model_digest"),
                F.struct(
                    F.lit("averaging").alias("strategy"), "best_round",
                    F.create_map(F.lit("macro_f1"), F.col("macro_f1")).alias("validation_metrics"),
                    F.create_map(F.lit("macro_f1"), F.col("m"), F.lit("accuracy"), F.col("a")).alias("test_metrics"),
                    (F.col("n") * 100).alias("total_upload_bytes"),
                ).alias("summary"),
            )
        ).alias("value")
    )
    return round_all(runs.compare_runs(documents))


_BEST = "SELECT run_id, arg_max(round, (macro_f1, -round)) AS best_round, max(macro_f1) AS macro_f1 FROM rounds GROUP BY run_id"
_COMPARE_SQL = f"""{ROUNDS}, b AS ({_BEST}), t AS (SELECT run_id, max(accuracy) AS a, max(macro_f1) AS m, count(*) AS n FROM rounds GROUP BY run_id)
SELECT run_id, 'averaging' AS strategy, best_round, {rounded_sql('macro_f1', 6)} AS validation_macro_f1, {rounded_sql('m', 6)} AS test_macro_f1,
  {rounded_sql('a', 6)} AS test_accuracy, n * 100 AS upload_bytes, 0 AS download_bytes, 'c1' AS config_digest, 'd1' AS dataset_digest,
  'm1' AS model_digest FROM b JOIN t USING (run_id)"""


def _winner(spark, sf_dir):
    return round_all(runs.select_winner(results(spark, sf_dir), "mode", by=["protocol"]))


_WINNER_SQL = f"""{RESULTS}, m AS (SELECT protocol, mode, avg(macro_f1) AS macro_f1 FROM results GROUP BY ALL)
SELECT protocol, arg_max(mode, (macro_f1, mode)) AS mode, {rounded_sql('max(macro_f1)', 6)} AS macro_f1 FROM m GROUP BY protocol"""


def _pending(spark, sf_dir):
    """The full grid against results that lack one model under one protocol."""
    done = results(spark, sf_dir).where(~((F.col("model") == "gat") & (F.col("protocol") == "loso")))
    grid = results(spark, sf_dir).select("protocol", "model", "mode").distinct()
    return runs.pending_configs(grid, done, ["protocol", "model", "mode"])


def _candidates(spark, sf_dir):
    rows = results(spark, sf_dir).groupBy("model", "mode").agg(F.round(F.avg("macro_f1"), 2).alias("macro_f1"))
    mode = F.col("mode")
    return rows.select(
        "macro_f1", F.length("model").cast("double").alias("latency_p95"),
        F.when(mode == "none", 50).otherwise(100).alias("max_flows"),
        F.when(F.col("model") == "sage", 15.0).otherwise(7.5).alias("duration"),
        F.length("mode").alias("stride"), F.lit(1.0).alias("lateness"),
    )


def _candidate(spark, sf_dir):
    return runs.select_candidate(_candidates(spark, sf_dir))


_CANDIDATE_SQL = f"""{RESULTS}, c AS (SELECT round(avg(macro_f1), 2) AS macro_f1, CAST(length(model) AS DOUBLE) AS latency_p95,
  CASE WHEN mode = 'none' THEN 50 ELSE 100 END AS max_flows, CASE WHEN model = 'sage' THEN 15.0 ELSE 7.5 END AS duration,
  length(mode) AS stride, 1.0 AS lateness FROM results GROUP BY model, mode)
SELECT *, 'rolling-window-v1:duration=' || printf('%g', CAST(duration AS DOUBLE)) || 's:max-flows=' || max_flows || ':stride=' || stride
  || ':lateness=' || printf('%g', CAST(lateness AS DOUBLE)) || 's' AS graph_protocol FROM c ORDER BY macro_f1 DESC, latency_p95, max_flows, duration LIMIT 1"""


def _seeds(spark, sf_dir):
    rows = runs.seed_aggregate(results(spark, sf_dir), ["protocol", "model"], ["macro_f1"])
    return round_all(rows)


_SEEDS_SQL = f"""{RESULTS} SELECT protocol, model, count(DISTINCT seed) AS seed_count, {rounded_sql('avg(macro_f1)', 6)} AS macro_f1_mean,
  {rounded_sql('stddev_pop(macro_f1)', 6)} AS macro_f1_std, {rounded_sql('min(macro_f1)', 6)} AS macro_f1_min, {rounded_sql('max(macro_f1)', 6)} AS macro_f1_max,
  printf('%.6f ± %.6f', avg(macro_f1), stddev_pop(macro_f1)) AS macro_f1_mean_std FROM results GROUP BY ALL"""


def _scenario_rows(spark, sf_dir):
    return results(spark, sf_dir).groupBy("protocol", "scenario").agg(
        F.avg("macro_f1").alias("macro_f1"), F.avg("accuracy").alias("accuracy")
    )


def _mean_row(spark, sf_dir):
    return round_all(
        runs.with_mean_row(_scenario_rows(spark, sf_dir), "scenario", ["macro_f1", "accuracy"], ["protocol"])
    )


SCENARIO_ROWS = f"{RESULTS}, sr AS (SELECT protocol, scenario, avg(macro_f1) AS macro_f1, avg(accuracy) AS accuracy FROM results GROUP BY ALL)"
_MEAN_SQL = f"""{SCENARIO_ROWS} SELECT protocol, coalesce(scenario, 'MEAN') AS scenario, {rounded_sql('avg(macro_f1)', 6)} AS macro_f1,
  {rounded_sql('avg(accuracy)', 6)} AS accuracy FROM sr GROUP BY GROUPING SETS ((protocol, scenario), (protocol))"""


def _hardest(spark, sf_dir):
    return round_all(runs.hardest(_scenario_rows(spark, sf_dir), "scenario", by=["protocol"]))


def _baseline(spark, sf_dir):
    """Another split's accuracy stands for the historical metric."""
    history = results(spark, sf_dir).select("protocol", F.col("accuracy").alias("macro_f1"))
    return round_all(runs.baseline_vs_current(history, results(spark, sf_dir)))


_BASELINE_SQL = f"""{RESULTS}, s AS (SELECT protocol, seed, avg(macro_f1) AS m FROM results GROUP BY ALL),
c AS (SELECT protocol, avg(m) FILTER (seed = 42) AS a, avg(m) AS b FROM s GROUP BY protocol)
SELECT protocol, {rounded_sql('(SELECT avg(accuracy) FROM results r WHERE r.protocol = c.protocol)', 6)} AS historical_metric,
  {rounded_sql('a', 6)} AS current_seed_metric, {rounded_sql('b', 6)} AS current_mean_metric FROM c"""


def _support_table(spark, sf_dir):
    """Support of the split view; the private class has no train rows elsewhere."""
    rows = support_by_split(split_labelled(spark, sf_dir), (*CLASSES, "unseen"), by=["scenario"])
    # A held-out scenario keeps its test rows and gives up its train rows.
    loso = rows.withColumn("train", F.when(F.col("detailed_label") == "purchase", 0).otherwise(F.col("train")))
    return runs.class_support_table(loso.withColumn("protocol", F.lit("loso")))


_SUPPORT_TABLE_SQL = f"""{SPLIT_LABELLED}, x AS (SELECT DISTINCT scenario, unnest({[*CLASSES, 'unseen']!r}) AS detailed_label FROM split_labelled),
s0 AS (SELECT scenario, detailed_label, count(*) FILTER (split = 'train') AS tr,
  count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test
  FROM x LEFT JOIN split_labelled USING (scenario, detailed_label) GROUP BY ALL),
s AS (SELECT * EXCLUDE (tr), CASE WHEN detailed_label = 'purchase' THEN 0 ELSE tr END AS train FROM s0)
SELECT *, 'loso' AS protocol, train > 0 AS present_in_train, train = 0 AND test > 0 AS private_to_held_out FROM s"""


def _f1_rows(spark, sf_dir):
    matrix = metrics.confusion(views.predictions(spark, sf_dir), K, ["client"])
    return metrics.per_class_metrics(matrix, ["client"])


def _f1_matrix(spark, sf_dir):
    """Per-class F1 kept under either key layout, by scenario."""
    per_class = _f1_rows(spark, sf_dir).withColumn(
        "name", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("class_idx") + 1)
    )
    even = F.substring("client", -1, 1).cast("int") % 2 == 0
    pairs = per_class.groupBy(F.col("client").alias("run_id")).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(F.concat(F.when(even, "f1-class-").otherwise("other-"), F.col("class_idx").cast("string")), "f1")
            )
        ).alias("test_metrics"),
        F.map_from_entries(F.collect_list(F.struct("name", "f1"))).alias("per_class"),
    )
    return round_all(runs.per_class_f1_matrix(pairs, CLASSES))


CLIENT_CLASSES = f"{PREDICTED}, {confusion_sql('predictions', ['client'])}, {per_class_sql('cm', ['client'])}"


def _curve(spark, sf_dir):
    return round_all(runs.learning_curve(rounds(spark, sf_dir)))


_CURVE_SQL = f"""{ROUNDS}, b AS (SELECT *, max(macro_f1) OVER (PARTITION BY run_id ORDER BY round) AS running_best FROM rounds)
""" + " UNION ALL ".join(
    f"SELECT run_id, round, {rounded_sql('running_best', 6)} AS running_best, '{m}' AS metric, {rounded_sql(m, 6)} AS value FROM b"
    for m in ("loss", "accuracy", "macro_f1", "weighted_f1")
)


def _unseen(spark, sf_dir):
    rows = runs.unseen_classes_per_fold(views.labelled_flows(spark, sf_dir), SENSORS)
    return rows.select("fold", "n_unseen", F.concat_ws(",", "unseen").alias("unseen"))


_UNSEEN_SQL = f"""{SPLIT_LABELLED}, o AS (SELECT detailed_label, min(scenario) AS fold FROM labelled_flows GROUP BY detailed_label HAVING count(DISTINCT scenario) = 1)
SELECT s.fold, count(detailed_label) AS n_unseen, coalesce(string_agg(detailed_label, ',' ORDER BY detailed_label), '') AS unseen
FROM (SELECT DISTINCT scenario AS fold FROM labelled_flows) s LEFT JOIN o USING (fold) GROUP BY s.fold"""


def _folds(spark, sf_dir):
    per_class = _f1_rows(spark, sf_dir)
    overall = metrics.overall_metrics(per_class, ["client"])
    return round_all(runs.fold_records(overall, per_class, ["client"], CLASSES))


_FOLDS_SQL = f"""{CLIENT_CLASSES}, o AS ({overall_sql('pc', ['client'])}), w AS (SELECT client, {", ".join(
    f'''{rounded_sql(f"max(f1) FILTER (class_idx = {i})", 6)} AS "f1_{c}", max(support) FILTER (class_idx = {i}) AS "support_{c}"'''
    for i, c in enumerate(CLASSES))} FROM pc GROUP BY client) SELECT * FROM o JOIN w USING (client)"""


def _policies(spark, sf_dir):
    scores = results(spark, sf_dir).select("seed", F.col("mode").alias("policy"), "macro_f1")
    return round_all(runs.policy_by_seed(scores, MODES, "none"))


_POLICY_SQL = f"""{RESULTS}, p AS (SELECT seed, mode AS policy, avg(macro_f1) AS score FROM results GROUP BY ALL)
SELECT p.seed, p.policy, {rounded_sql('p.score', 6)} AS score, {rounded_sql('p.score - b.score', 6)} AS delta
FROM p JOIN p b ON b.seed = p.seed AND b.policy = 'none'"""


def _analysable(spark, sf_dir):
    """Predictions of each scenario; one has a foreign label, one run no rows."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    rows = views.predictions(spark, sf_dir).select(
        F.col("client").alias("run_id"), F.col("seq").alias("row_id"), F.col("client").alias("scenario"),
        F.element_at(names, F.col("true_idx") + 1).alias("true_label"),
        F.when((F.col("client") == "sensor-1") & (F.col("pred_idx") == 2), "foreign")
        .otherwise(F.element_at(names, F.col("pred_idx") + 1)).alias("predicted_label"),
    )
    planned = spark.createDataFrame([(s,) for s in (*SENSORS, "sensor-9")], "run_id string")
    return runs.analysable_predictions(rows, planned, CLASSES)


_ANALYSABLE_SQL = f"""{PREDICTED}, n AS (SELECT unnest({[*SENSORS, 'sensor-9']!r}) AS run_id),
c AS (SELECT client AS run_id, count(*) AS n FROM predictions GROUP BY client)
SELECT run_id, CASE WHEN n IS NULL OR run_id = 'sensor-1' THEN 'NOT_AVAILABLE' ELSE 'AVAILABLE' END AS status,
  CASE WHEN n IS NULL THEN 'no rows' WHEN run_id = 'sensor-1' THEN 'labels outside the taxonomy' ELSE '' END AS reason FROM n LEFT JOIN c USING (run_id)"""


def _routed(spark, sf_dir):
    rows = metrics.probabilities_and_entropy(views.predictions(spark, sf_dir)).withColumn(
        "entropy", F.round("entropy", 9)
    )
    return round_all(runs.routed_report(rows, K))


def _nearest(value, fraction):
    return f"max({value}) FILTER ({value}_r = round_even((n - 1) * {fraction}, 0))"


_ROUTED_SQL = f"""{SCORED}, bo AS (SELECT * FROM ent UNION ALL SELECT * REPLACE ('ALL' AS client) FROM ent),
{confusion_sql('bo', ['client'])}, {per_class_sql('cm', ['client'])}, o AS ({overall_sql('pc', ['client'])}),
q AS (SELECT client, confidence, entropy, row_number() OVER (PARTITION BY client ORDER BY confidence) - 1 AS confidence_r,
  row_number() OVER (PARTITION BY client ORDER BY entropy) - 1 AS entropy_r, count(*) OVER (PARTITION BY client) AS n FROM bo),
s AS (SELECT client, {", ".join(f"{rounded_sql(_nearest(v, p), 6)} AS {v}_{name}" for v in ('confidence', 'entropy') for name, p in (('p50', 0.5), ('p95', 0.95)))} FROM q GROUP BY client)
SELECT * FROM o JOIN s USING (client)"""


def _audit(spark, sf_dir):
    """What an export of predictions holds; labels of one class are withheld."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    rows = views.predictions(spark, sf_dir).select(
        F.lit(1).alias("seed"), F.col("client").alias("scenario"), "split",
        F.when(F.col("true_idx") != 2, F.element_at(names, F.col("true_idx") + 1)).alias("true_label"),
        F.element_at(names, F.col("pred_idx") + 1).alias("predicted_label"), F.when(F.col("seq") % 3 > 0, F.col("confidence")).alias("entropy"),
        *[F.col("probabilities")[i].alias(f"probability::{c}") for i, c in enumerate(CLASSES)],
    )
    return runs.prediction_audit(rows, True, CLASSES)


_AUDIT_SQL = f"""{PREDICTED} SELECT 'seed' AS field, 'EXPORTED' AS status, count(*) AS filled FROM predictions
UNION ALL SELECT 'protocol', 'NOT_AVAILABLE', NULL UNION ALL SELECT 'scenario', 'EXPORTED', count(client) FROM predictions
UNION ALL SELECT 'split', 'EXPORTED', count(split) FROM predictions
UNION ALL SELECT 'true_label', 'EXPORTED', count(*) FILTER (true_idx <> 2) FROM predictions
UNION ALL SELECT 'predicted_label', 'EXPORTED', count(pred_idx) FROM predictions
UNION ALL SELECT 'held_out', 'DERIVED_FROM_METADATA', NULL UNION ALL SELECT 'class_present_in_train', 'DERIVED_FROM_CLASS_SUPPORT', NULL
UNION ALL SELECT 'probabilities_or_logits', 'PROBABILITIES_EXPORTED', NULL
UNION ALL SELECT 'entropy', 'EXPORTED', count(*) FILTER (seq % 3 > 0) FROM predictions"""


def _personalised(spark, sf_dir):
    """Each client's edges under its own head, heads shared by pairs of clients."""
    names = tuple(SCORE_HEADS)
    heads = {c: SCORE_HEADS[names[i % len(names)]] for i, c in enumerate(views.CLIENTS)}
    rows = neighbors.score_own_head(representation(spark, sf_dir), heads, REPR_WIDTH)
    mine = rows.withColumn("true_idx", views.edge_label_index(F.col("detailed_label")))
    mine = mine.withColumnRenamed(GRAPH_BY[0], "client")
    return round_all(runs.personalised_report(mine, len(EDGE_CLASSES)), 4)


_EK = len(EDGE_CLASSES)
_PERSONALISED_SQL = f"""{scored_sql(tuple(SCORE_HEADS))}, own AS (SELECT pr.scenario AS client, CAST(list_position({list(EDGE_CLASSES)!r}, detailed_label) - 1 AS INTEGER) AS true_idx,
  CAST(list_position(probabilities, list_max(probabilities)) - 1 AS INTEGER) AS pred_idx, probabilities FROM pr
  WHERE head = {list(SCORE_HEADS)!r}[CAST(substr(pr.scenario, 8) AS INTEGER) % {len(SCORE_HEADS)} + 1]),
bo AS (SELECT * FROM own UNION ALL SELECT * REPLACE ('ALL' AS client) FROM own),
{confusion_sql('bo', ['client'], classes=_EK)}, {per_class_sql('cm', ['client'])}, o AS ({overall_sql('pc', ['client']).replace(', 6)', ', 4)')}),
l AS (SELECT client, {rounded_sql('avg(-ln(greatest(probabilities[true_idx + 1], 1e-12)))', 4)} AS loss FROM bo GROUP BY client)
SELECT * FROM o JOIN l USING (client)"""


QUERIES = {
    "read_round_logs": (_round_logs, f"{ROUNDS} SELECT * FROM rounds"),
    "round_contiguity": (
        _contiguity,
        f"{ROUNDS} SELECT run_id, count(*) AS rounds, CAST(right(run_id, 1) AS INTEGER) % 2 = 0 AS contiguous FROM rounds GROUP BY run_id",
    ),
    "flatten_history": (
        _history, f"{ROUNDS} SELECT run_id, round AS epoch, round, loss, macro_f1 FROM rounds",
    ),
    "select_winner": (_winner, _WINNER_SQL),
    "pending_configs": (
        _pending, f"{RESULTS} SELECT DISTINCT protocol, model, mode FROM results WHERE model = 'gat' AND protocol = 'loso'",
    ),
    "select_candidate": (_candidate, _CANDIDATE_SQL),
    "compare_runs": (_compare, _COMPARE_SQL),
    "best_round": (lambda spark, sf_dir: runs.best_round(rounds(spark, sf_dir)), f"{ROUNDS} {_BEST}"),
    "seed_aggregate": (_seeds, _SEEDS_SQL),
    "mean_row": (_mean_row, _MEAN_SQL),
    "hardest_scenario": (
        _hardest,
        f"{SCENARIO_ROWS} SELECT protocol, arg_min(scenario, (macro_f1, scenario)) AS scenario, {rounded_sql('min(macro_f1)', 6)} AS macro_f1 FROM sr GROUP BY protocol",
    ),
    "baseline_vs_current": (_baseline, _BASELINE_SQL),
    "class_support_table": (_support_table, _SUPPORT_TABLE_SQL),
    "per_class_f1_matrix": (
        _f1_matrix,
        f"{CLIENT_CLASSES} SELECT client AS run_id, {list(CLASSES)!r}[class_idx + 1] AS class_name, {rounded_sql('f1', 6)} AS f1 FROM pc",
    ),
    "learning_curve": (_curve, _CURVE_SQL),
    "unseen_classes_per_fold": (_unseen, _UNSEEN_SQL),
    "fold_records": (_folds, _FOLDS_SQL),
    "policy_by_seed": (_policies, _POLICY_SQL),
    "analysable_predictions": (_analysable, _ANALYSABLE_SQL),
    "routed_report": (_routed, _ROUTED_SQL),
    "personalised_report": (_personalised, _PERSONALISED_SQL),
    "prediction_audit": (_audit, _AUDIT_SQL),
}
