"""Metrics over the prediction view."""

from pyspark.sql import functions as F

from ..operators import metrics
from . import views
from .views import CLASSES, PREDICTIONS, rounded, rounded_sql

K = len(CLASSES)
BY = ["split"]
BASE = f"WITH {PREDICTIONS}"
THRESHOLDS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.975, 0.99)
ABSENT_CLASS = 3


def confusion_sql(source, by, name="cm", classes=K):
    """Dense confusion counts of a prediction relation."""
    keys = "".join(f"{b}, " for b in by)
    on = " AND ".join([f"c.{b} = f.{b}" for b in by] + ["c.true_idx = f.true_idx", "c.pred_idx = f.pred_idx"])
    groups = f"(SELECT DISTINCT {', '.join(by)} FROM {source})" if by else "(SELECT 1 AS one)"
    return f"""{name}_c AS (SELECT {keys}true_idx, pred_idx, count(*) AS n FROM {source} GROUP BY ALL),
{name}_f AS (SELECT * FROM {groups} g, (SELECT unnest(range({classes})) AS true_idx) a, (SELECT unnest(range({classes})) AS pred_idx) b),
{name} AS (SELECT {"".join(f"f.{b}, " for b in by)}f.true_idx, f.pred_idx, coalesce(c.n, 0) AS n FROM {name}_f f LEFT JOIN {name}_c c ON {on})"""


def per_class_sql(matrix, by, name="pc"):
    keys = "".join(f"{b}, " for b in by)
    using = ", ".join([*by, "class_idx"])
    return f"""{name}_t AS (SELECT {keys}true_idx AS class_idx, sum(n) AS support, sum(n) FILTER (true_idx = pred_idx) AS tp FROM {matrix} GROUP BY ALL),
{name}_p AS (SELECT {keys}pred_idx AS class_idx, sum(n) AS predicted FROM {matrix} GROUP BY ALL),
{name}_r AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall FROM {name}_t JOIN {name}_p USING ({using})),
{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM {name}_r)"""


def overall_sql(per_class, by):
    keys = "".join(f"{b}, " for b in by)
    return f"""SELECT {keys}sum(support) AS num_examples, {rounded_sql('CAST(sum(tp) AS DOUBLE) / sum(support)', 6)} AS accuracy,
  {rounded_sql('avg(f1)', 6)} AS macro_f1, {rounded_sql('sum(f1 * support) / sum(support)', 6)} AS weighted_f1 FROM {per_class} GROUP BY ALL"""


def round_all(df, digits=6):
    return df.select(
        *[rounded(F.col(n), digits).alias(n) if kind in ("double", "float") else n for n, kind in df.dtypes]
    )


MATRIX = f"{BASE},\n{confusion_sql('predictions', BY)}"
CLASSED = f"{MATRIX},\n{per_class_sql('cm', BY)}"


def _confusion(spark, sf_dir):
    return metrics.confusion(views.predictions(spark, sf_dir), K, BY)


def _client_matrices(spark, sf_dir):
    return metrics.confusion(views.predictions(spark, sf_dir), K, ["client"])


def _merged(spark, sf_dir):
    return metrics.merge_confusions(_client_matrices(spark, sf_dir))


def _confusion_problems(spark, sf_dir):
    """Matrices checked against weights that are off for one client."""
    weights = views.predictions(spark, sf_dir).groupBy("client").agg(
        (F.count(F.lit(1)) + F.when(F.col("client") == "sensor-2", 1).otherwise(0)).alias("num_examples")
    )
    return metrics.confusion_problems(_client_matrices(spark, sf_dir), weights, K)


def _per_class(null_when_unsupported):
    def run(spark, sf_dir):
        # The wider class space holds a class that never occurs.
        classes = K + 1 if null_when_unsupported else K
        matrix = metrics.confusion(views.predictions(spark, sf_dir), classes, BY)
        result = metrics.per_class_metrics(matrix, BY, null_when_unsupported)
        return round_all(result.select(*BY, "class_idx", "support", "precision", "recall", "f1"))

    return run


_PER_CLASS = f"split, class_idx, support, {rounded_sql('precision', 6)} AS precision, {rounded_sql('recall', 6)} AS recall, {rounded_sql('f1', 6)} AS f1"
_SUPPORTED = f"""{BASE}, {confusion_sql('predictions', BY, classes=K + 1)}, {per_class_sql('cm', BY)} SELECT split, class_idx, support, """ + ", ".join(
    f"CASE WHEN support > 0 THEN {rounded_sql(c, 6)} END AS {c}" for c in ("precision", "recall", "f1")
) + " FROM pc"


def _classification(spark, sf_dir):
    return round_all(metrics.classification_metrics(views.predictions(spark, sf_dir), K, BY))


def _fixed_macro(spark, sf_dir):
    overall = metrics.classification_metrics(views.predictions(spark, sf_dir), K + 1, ["client"])
    return round_all(overall.select("client", "macro_f1"))


_FIXED_SQL = f"""{BASE}, {confusion_sql('predictions', ['client'], classes=K + 1)}, {per_class_sql('cm', ['client'])}
SELECT client, {rounded_sql('avg(f1)', 6)} AS macro_f1 FROM pc GROUP BY client"""


def _train_support(rows):
    """Support of the train rows; one class never occurs among them."""
    return rows.where((F.col("split") == "train") & (F.col("true_idx") != ABSENT_CLASS))


def _seen_macro(spark, sf_dir):
    rows = views.predictions(spark, sf_dir)
    support = _train_support(rows).groupBy(F.col("true_idx").alias("class_idx")).agg(
        F.count(F.lit(1)).alias("train_support")
    )
    return round_all(metrics.seen_class_macro_f1(metrics.confusion(rows, K, ["client"]), support, ["client"]))


_SEEN_SQL = f"""{BASE}, {confusion_sql('predictions', ['client'])}, {per_class_sql('cm', ['client'])}
SELECT client, {rounded_sql('avg(f1)', 6)} AS seen_class_macro_f1 FROM pc WHERE support > 0 AND class_idx IN
  (SELECT true_idx FROM predictions WHERE split = 'train' AND true_idx <> {ABSENT_CLASS}) GROUP BY client"""


def _binary(spark, sf_dir):
    return round_all(metrics.binary_metrics(views.predictions(spark, sf_dir), 0, BY))


_BINARY_SQL = f"""{BASE}, s AS (SELECT split, count(*) AS n, count(*) FILTER ((true_idx <> 0) = (pred_idx <> 0)) AS same,
  CAST(count(*) FILTER (true_idx <> 0 AND pred_idx <> 0) AS DOUBLE) AS tp, count(*) FILTER (true_idx <> 0) AS truth,
  count(*) FILTER (pred_idx <> 0) AS called FROM predictions GROUP BY split)
SELECT split, {rounded_sql('CAST(same AS DOUBLE) / n', 6)} AS accuracy, {rounded_sql('tp / called', 6)} AS malicious_precision,
  {rounded_sql('tp / truth', 6)} AS malicious_recall, {rounded_sql('2 * tp / (called + truth)', 6)} AS malicious_f1 FROM s"""

ENTROPY = """-list_sum(list_transform(probabilities, lambda p: p * ln(least(greatest(p, 1e-12), 1.0))))"""


def _probabilities(spark, sf_dir):
    """Some rows hold probabilities that do not sum to 1."""
    rows = views.predictions(spark, sf_dir).select(
        "seq",
        F.when(F.col("seq") % 17 == 0, F.transform("probabilities", lambda p: p * 1.1))
        .otherwise(F.col("probabilities")).alias("probabilities"),
    )
    result = metrics.probabilities_and_entropy(rows)
    return result.select(
        "seq", rounded(F.col("entropy"), 6).alias("entropy"), rounded(F.col("probabilities")[0], 6).alias("p0"),
        F.col("score_error").isNotNull().alias("bad"),
    )


_PROBABILITIES_SQL = f"""{BASE} SELECT seq, CASE WHEN seq % 17 <> 0 THEN {rounded_sql(ENTROPY, 6)} END AS entropy,
  CASE WHEN seq % 17 <> 0 THEN {rounded_sql('probabilities[1]', 6)} END AS p0, seq % 17 = 0 AS bad FROM predictions"""


def _logits(spark, sf_dir):
    rows = views.predictions(spark, sf_dir).select(
        "seq", F.transform("probabilities", lambda p: F.log(p) + 3.0).alias("logits")
    )
    result = metrics.probabilities_and_entropy(rows)
    return result.select("seq", rounded(F.col("entropy"), 6).alias("entropy"), "entropy_source")


def _with_entropy(spark, sf_dir):
    """Predictions with a rounded entropy and the absence flag."""
    rows = views.predictions(spark, sf_dir)
    scored = metrics.probabilities_and_entropy(rows).withColumn("entropy", F.round("entropy", 9))
    return metrics.with_train_support(scored, _train_support(rows))


SCORED = f"""{BASE}, ent AS (SELECT *, round({ENTROPY}, 9) AS entropy, true_idx = {ABSENT_CLASS} AS absent FROM predictions)"""


def ranking_sql(source, by, score, target):
    """Exact AUROC and average precision from per-score counts."""
    keys = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""sc AS (SELECT {keys}{score} AS s, CAST(count(*) FILTER ({target} = 1) AS DOUBLE) AS pos,
  CAST(count(*) FILTER ({target} = 0) AS DOUBLE) AS neg FROM {source} GROUP BY ALL),
cu AS (SELECT *, sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below,
  sum(pos) OVER ({part} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER ({part} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM sc),
rk AS (SELECT {keys}CAST(sum(pos) AS BIGINT) AS positive_count, CAST(sum(neg) AS BIGINT) AS negative_count,
  {rounded_sql('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))', 6)} AS auroc,
  {rounded_sql('sum(pos * tp / (tp + fp)) / sum(pos)', 6)} AS auprc FROM cu GROUP BY ALL)"""


def _ranking_labels(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").withColumn(
        "score", (F.col("quality") * 2 + F.col("doc_id") % 7).cast("double")
    )
    return round_all(metrics.ranking_scores(labels, [], "score", "toxic"))


def _ranking_confidence(spark, sf_dir):
    rows = views.predictions(spark, sf_dir).withColumn(
        "correct", (F.col("true_idx") == F.col("pred_idx")).cast("int")
    ).withColumn("score", F.col("confidence") + F.col("correct") * 0.1)
    return round_all(metrics.ranking_scores(rows.withColumn("score", F.round("score", 6)), ["client"], "score", "correct"))


_QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe_sql(source, by, value, extra=()):
    columns = [f"count(*) AS count", f"{rounded_sql(f'avg({value})', 6)} AS mean", f"{rounded_sql(f'stddev_pop({value})', 6)} AS std",
               f"{rounded_sql(f'min({value})', 6)} AS min", f"{rounded_sql(f'max({value})', 6)} AS max"]
    for name, q in {**_QUANTILES, **dict(extra)}.items():
        columns.append(f"{rounded_sql(f'quantile_cont({value}, {q})', 6)} AS {name}")
    return f"SELECT {by}, {', '.join(columns)} FROM {source} GROUP BY ALL"


def _member_sql(five):
    groups = [
        ("known_correct", "NOT absent AND true_idx = pred_idx"), ("known_incorrect", "NOT absent AND true_idx <> pred_idx"),
        ("absent_from_train", "absent"),
    ] + ([("benign", "true_idx = 0"), ("malicious", "true_idx <> 0")] if five else [])
    return "mem AS (" + " UNION ALL ".join(
        f"SELECT *, '{name}' AS \"group\" FROM ent WHERE {test}" for name, test in groups
    ) + ")"


def _entropy_groups(five):
    def run(spark, sf_dir):
        return round_all(metrics.entropy_groups(_with_entropy(spark, sf_dir), five))

    extra = () if five else {"q05": 0.05, "q95": 0.95}.items()
    return run, f"{SCORED}, {_member_sql(five)} " + describe_sql("mem", '"group"', "entropy", extra)


def _entropy_detection(spark, sf_dir):
    return round_all(metrics.entropy_detection(_with_entropy(spark, sf_dir)))


_PAIRED = " UNION ALL ".join(
    f"SELECT '{name}' AS comparison, entropy, CASE WHEN \"group\" = '{positive}' THEN 1 ELSE 0 END AS target FROM mem WHERE \"group\" IN ('{positive}', '{negative}')"
    for name, positive, negative in metrics.PAIRINGS
)
_DETECTION_SQL = f"""{SCORED}, {_member_sql(True)}, paired AS ({_PAIRED}), {ranking_sql('paired', ['comparison'], 'entropy', 'target')}
SELECT *, 'AVAILABLE' AS status, '' AS reason FROM rk"""


def _thresholds(spark, sf_dir):
    return round_all(metrics.threshold_tradeoff(views.predictions(spark, sf_dir), THRESHOLDS, 0, BY))


_ALERT = "pred_idx <> 0 AND confidence >= t"
_THRESHOLD_SQL = f"""{BASE}, t AS (SELECT unnest({[float(t) for t in THRESHOLDS]!r}) AS t0), x AS (SELECT p.*, CAST(t0 AS DOUBLE) AS t FROM predictions p, t),
s AS (SELECT split, t, CAST(count(*) FILTER ({_ALERT}) AS DOUBLE) AS a, CAST(count(*) FILTER (true_idx = 0) AS DOUBLE) AS b,
  CAST(count(*) FILTER ({_ALERT} AND true_idx = 0) AS DOUBLE) AS f, CAST(count(*) FILTER (true_idx <> 0) AS DOUBLE) AS m,
  CAST(count(*) FILTER ({_ALERT} AND true_idx <> 0) AS DOUBLE) AS d,
  CAST(count(*) FILTER ({_ALERT} AND true_idx <> 0 AND true_idx = pred_idx) AS DOUBLE) AS c FROM x GROUP BY ALL)
SELECT split, {rounded_sql('t', 6)} AS confidence_threshold, CAST(a AS BIGINT) AS alert_count, CAST(b AS BIGINT) AS benign_support,
  CAST(f AS BIGINT) AS benign_false_alerts, {rounded_sql('f / b', 6)} AS benign_false_alert_rate, CAST(m AS BIGINT) AS malicious_support,
  CAST(d AS BIGINT) AS malicious_alerts, {rounded_sql('d / m', 6)} AS malicious_alert_recall, CAST(c AS BIGINT) AS correct_class_alerts,
  {rounded_sql('c / m', 6)} AS correct_class_alert_recall, {rounded_sql('d / nullif(a, 0)', 6)} AS alert_precision_malicious FROM s"""


def _agreement(spark, sf_dir):
    rows = views.predictions(spark, sf_dir)
    return round_all(
        metrics.adjacent_agreement(rows, "client", ["seq"], by=BY)
    )


_AGREEMENT_SQL = f"""{BASE}, l AS (SELECT split, client, pred_idx, lag(pred_idx) OVER (PARTITION BY split, client ORDER BY seq) AS p FROM predictions),
c AS (SELECT split, client, avg(CAST(pred_idx = p AS DOUBLE)) AS share FROM l WHERE p IS NOT NULL GROUP BY ALL)
SELECT split, {rounded_sql('avg(share)', 6)} AS adjacent_agreement FROM c GROUP BY split"""


def _summary(spark, sf_dir):
    return round_all(metrics.numeric_summary(_with_entropy(spark, sf_dir), ["client"], "entropy"))


_SUMMARY_SQL = f"""{SCORED}, o AS (SELECT client, entropy, row_number() OVER (PARTITION BY client ORDER BY entropy) - 1 AS r,
  count(*) OVER (PARTITION BY client) AS n FROM ent)
SELECT client, {rounded_sql('min(entropy)', 6)} AS min, {rounded_sql('avg(entropy)', 6)} AS mean,
  {rounded_sql('max(entropy) FILTER (r = round_even((n - 1) * 0.5, 0))', 6)} AS p50,
  {rounded_sql('max(entropy) FILTER (r = round_even((n - 1) * 0.95, 0))', 6)} AS p95, {rounded_sql('max(entropy)', 6)} AS max
FROM o GROUP BY client"""

HEADS = ("head-a", "head-b", "head-c")


def head_predictions(spark, sf_dir):
    """Every prediction under three heads that err on different classes."""
    rows = views.predictions(spark, sf_dir).select("seq", "split", "client", "true_idx")
    each = F.posexplode(F.array(*[F.lit(h) for h in HEADS])).alias("h", "head")
    s, t, h = F.col("seq"), F.col("true_idx"), F.col("h")
    wrong = (s * (h + 1) + t) % (3 + (h + t) % 4) == 0
    return rows.select("*", each).withColumn(
        "pred_idx", F.when(wrong, (t + 1 + h) % K).otherwise(t).cast("int")
    )


HEADED = f"""{BASE}, hd AS (SELECT seq, split, client, true_idx, h, {list(HEADS)!r}[h + 1] AS head
  FROM predictions, (SELECT unnest(range(3)) AS h)),
heads AS (SELECT *, CAST(CASE WHEN (seq * (h + 1) + true_idx) % (3 + (h + true_idx) % 4) = 0 THEN (true_idx + 1 + h) % {K}
  ELSE true_idx END AS INTEGER) AS pred_idx FROM hd),
hv AS (SELECT * FROM heads WHERE split = 'validation'), ht AS (SELECT * FROM heads WHERE split = 'test'),
{confusion_sql('hv', ['head'])}, {per_class_sql('cm', ['head'])},
best AS (SELECT class_idx, max_by(head, (f1, head)) AS head FROM pc WHERE support > 0 GROUP BY class_idx)"""


def _cross(spark, sf_dir):
    rows = head_predictions(spark, sf_dir).where(F.col("split") == "validation")
    return metrics.cross_head_f1(rows, K)


def _oracle(spark, sf_dir):
    rows = head_predictions(spark, sf_dir).where(F.col("split") == "test")
    return metrics.oracle_evaluate(rows, metrics.oracle_mapping(_cross(spark, sf_dir)), K)


_ORACLE_SQL = f"""{HEADED}, chosen AS (SELECT ht.* FROM ht JOIN best ON best.class_idx = ht.true_idx AND best.head = ht.head),
{confusion_sql('chosen', [], 'oc')} SELECT * FROM oc"""


def _normalised(spark, sf_dir):
    return round_all(metrics.row_normalised(_confusion(spark, sf_dir), BY))


_NORMALISED_SQL = f"""{MATRIX} SELECT split, true_idx, pred_idx, {rounded_sql('CASE WHEN sum(n) OVER w > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER w ELSE 0 END', 6)} AS share
FROM cm WINDOW w AS (PARTITION BY split, true_idx)"""


def _loss(spark, sf_dir):
    losses = views.predictions(spark, sf_dir).groupBy("split", "client").agg(
        F.avg(-F.log("confidence")).alias("loss"), F.count(F.lit(1)).alias("num_examples")
    )
    return round_all(metrics.weighted_loss(losses, BY))


def _export(spark, sf_dir):
    rows = views.predictions(spark, sf_dir)
    exported = metrics.prediction_export(rows.drop("detailed_label"), _train_support(rows), CLASSES)
    return exported.select(
        "seq", "true_label", "predicted_label", "true_class_train_support", "true_class_absent_from_train",
        rounded(F.col("entropy"), 6).alias("entropy"),
        rounded(F.col("probability")["click"], 6).alias("p_click"),
    )


_EXPORT_SQL = f"""{BASE}, su AS (SELECT true_idx, count(*) AS n FROM predictions WHERE split = 'train' AND true_idx <> {ABSENT_CLASS} GROUP BY ALL)
SELECT seq, {list(CLASSES)!r}[true_idx + 1] AS true_label, {list(CLASSES)!r}[pred_idx + 1] AS predicted_label,
  coalesce(n, 0) AS true_class_train_support, n IS NULL AS true_class_absent_from_train,
  {rounded_sql(ENTROPY, 6)} AS entropy, {rounded_sql('probabilities[2]', 6)} AS p_click FROM predictions LEFT JOIN su USING (true_idx)"""


QUERIES = {
    "confusion_matrix": (_confusion, f"{MATRIX} SELECT * FROM cm"),
    "merge_confusions": (_merged, f"{BASE}, {confusion_sql('predictions', [])} SELECT * FROM cm"),
    "confusion_problems": (
        _confusion_problems,
        f"{BASE} SELECT client, {K * K} AS cells, count(*) AS total, count(*) + 1 AS num_examples FROM predictions WHERE client = 'sensor-2' GROUP BY client",
    ),
    "per_class_metrics": (_per_class(False), f"{CLASSED} SELECT {_PER_CLASS} FROM pc"),
    "per_class_metrics_supported": (_per_class(True), _SUPPORTED),
    "classification_metrics": (_classification, f"{CLASSED} {overall_sql('pc', BY)}"),
    "fixed_class_macro_f1": (_fixed_macro, _FIXED_SQL),
    "seen_class_macro_f1": (_seen_macro, _SEEN_SQL),
    "binary_metrics": (_binary, _BINARY_SQL),
    "probabilities_and_entropy": (_probabilities, _PROBABILITIES_SQL),
    "softmax_and_entropy": (
        _logits, f"{BASE} SELECT seq, {rounded_sql(ENTROPY, 6)} AS entropy, 'logits' AS entropy_source FROM predictions",
    ),
    "auroc_auprc_labels": (
        _ranking_labels,
        f"WITH l AS (SELECT *, CAST(quality * 2 + doc_id % 7 AS DOUBLE) AS score FROM labels), {ranking_sql('l', [], 'score', 'toxic')} SELECT * FROM rk",
    ),
    "auroc_auprc_confidence": (
        _ranking_confidence,
        f"""{BASE}, c AS (SELECT *, CAST(true_idx = pred_idx AS INTEGER) AS correct,
  round(confidence + CAST(true_idx = pred_idx AS INTEGER) * CAST(0.1 AS DOUBLE), 6) AS score FROM predictions),
{ranking_sql('c', ['client'], 'score', 'correct')} SELECT * FROM rk""",
    ),
    "entropy_groups_three": _entropy_groups(False),
    "entropy_groups_five": _entropy_groups(True),
    "entropy_detection": (_entropy_detection, _DETECTION_SQL),
    "threshold_tradeoff": (_thresholds, _THRESHOLD_SQL),
    "adjacent_agreement": (_agreement, _AGREEMENT_SQL),
    "numeric_summary": (_summary, _SUMMARY_SQL),
    "cross_head_f1": (
        lambda spark, sf_dir: round_all(_cross(spark, sf_dir)),
        f"{HEADED} SELECT head, class_idx, support, CASE WHEN support > 0 THEN {rounded_sql('f1', 6)} END AS f1 FROM pc",
    ),
    "oracle_mapping": (
        lambda spark, sf_dir: metrics.oracle_mapping(_cross(spark, sf_dir)), f"{HEADED} SELECT * FROM best",
    ),
    "oracle_evaluate": (_oracle, _ORACLE_SQL),
    "row_normalised_confusion": (_normalised, _NORMALISED_SQL),
    "weighted_loss": (
        _loss, f"{BASE} SELECT split, {rounded_sql('avg(-ln(confidence))', 6)} AS loss FROM predictions GROUP BY split",
    ),
    "prediction_export": (_export, _EXPORT_SQL),
}
