"""Class balance, exploration and verification over flow and edge views."""

from pyspark.sql import functions as F

from ..operators import balance
from . import views
from .flow_queries import CLEANED, LABELLED
from .metric_queries import round_all
from .split_queries import SPLIT_LABELLED, split_labelled
from .views import CLASSES, EDGE_FEATURES, RAW_EDGES, SENSORS, rounded_sql

TAXONOMY = (*CLASSES, "unseen")
K = len(TAXONOMY)

SCOPED = f"""{SPLIT_LABELLED},
rolled AS (SELECT coalesce(scenario, 'global') AS scope, coalesce(split, 'all') AS split, detailed_label, count(*) AS n
  FROM split_labelled GROUP BY GROUPING SETS ((scenario, split, detailed_label), (scenario, detailed_label), (split, detailed_label), (detailed_label))),
frame AS (SELECT scope, s.split, c.detailed_label FROM (SELECT DISTINCT scope FROM rolled) a,
  (SELECT unnest(['all', 'train', 'validation', 'test']) AS split) s, (SELECT unnest({list(TAXONOMY)!r}) AS detailed_label) c),
scoped AS (SELECT f.scope, f.split, f.detailed_label, coalesce(n, 0) AS n FROM frame f LEFT JOIN rolled r
  ON r.scope = f.scope AND r.split = f.split AND r.detailed_label = f.detailed_label),
shares AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER w ELSE 0 END AS share FROM scoped
  WINDOW w AS (PARTITION BY scope, split)),
every AS (SELECT * FROM shares WHERE split = 'all'),
facts AS (SELECT detailed_label, sum(n) FILTER (scope = 'global') AS global_support,
  count(*) FILTER (scope <> 'global' AND n > 0) AS clients_with_class FROM every GROUP BY ALL)"""


def scoped(spark, sf_dir):
    return balance.scoped_counts(split_labelled(spark, sf_dir), TAXONOMY)


def _every(spark, sf_dir):
    return scoped(spark, sf_dir).where(F.col("split") == "all").drop("split")


def _distribution(spark, sf_dir):
    return round_all(balance.class_distribution(scoped(spark, sf_dir), ["scope", "split"]))


def _entropy(spark, sf_dir):
    return round_all(balance.entropy_bits(_every(spark, sf_dir), ["scope"], K))


_H = "coalesce(-sum(share * log2(share)) FILTER (share > 0), 0)"
_ENTROPY_SQL = f"""{SCOPED}, h AS (SELECT scope, {_H} AS h FROM every GROUP BY scope)
SELECT scope, {rounded_sql('h', 6)} AS entropy_bits, {rounded_sql(f'h / log2({K})', 6)} AS normalized_entropy,
  {rounded_sql('pow(2, h)', 6)} AS effective_classes FROM h"""


def _js(spark, sf_dir):
    return round_all(balance.js_divergence_from_union(_every(spark, sf_dir)))


JS = """js AS (SELECT e.scope, CASE WHEN e.scope = 'global' THEN 0 ELSE
    0.5::DOUBLE * sum(CASE WHEN e.share > 0 THEN e.share * log2(e.share / ((e.share + u.share) / 2)) ELSE 0 END)
    + 0.5::DOUBLE * sum(CASE WHEN u.share > 0 THEN u.share * log2(u.share / ((e.share + u.share) / 2)) ELSE 0 END) END AS js
  FROM every e JOIN every u ON u.scope = 'global' AND u.detailed_label = e.detailed_label GROUP BY e.scope)"""


def _summary(spark, sf_dir):
    return round_all(balance.balance_summary(scoped(spark, sf_dir), K))


_SUMMARY_SQL = f"""{SCOPED}, {JS}, h AS (SELECT scope, {_H} AS h FROM every GROUP BY scope),
t AS (SELECT scope, sum(n) FILTER (split = 'train') AS train, sum(n) FILTER (split = 'validation') AS validation,
  sum(n) FILTER (split = 'test') AS test FROM scoped GROUP BY scope),
x AS (SELECT scope, sum(n) AS total, count(*) FILTER (n > 0) AS classes_present, count(*) FILTER (n = 0) AS zero_support_classes,
  min(n) FILTER (n > 0) AS minority_support, max(n) AS majority_support FROM every GROUP BY scope)
SELECT scope, train, validation, test, total, classes_present, zero_support_classes, minority_support, majority_support,
  {rounded_sql('CAST(majority_support AS DOUBLE) / minority_support', 6)} AS imbalance_ratio, {rounded_sql('h', 6)} AS entropy_bits,
  {rounded_sql(f'h / log2({K})', 6)} AS normalized_entropy, {rounded_sql('pow(2, h)', 6)} AS effective_classes,
  {rounded_sql('js', 6)} AS js_from_union_bits FROM t JOIN x USING (scope) JOIN h USING (scope) JOIN js USING (scope)"""


def _support(spark, sf_dir):
    return round_all(balance.class_support_by_client(scoped(spark, sf_dir)))


_SUPPORT_SQL = f"""{SCOPED} SELECT scope, split, detailed_label, n AS support, {rounded_sql('share', 6)} AS proportion, global_support,
  clients_with_class, n = 0 AS zero_support, clients_with_class = 1 AS private_class, global_support < 30 AS ultra_rare_class,
  n = 0 OR clients_with_class = 1 OR global_support < 30 AS severe_trigger FROM shares JOIN facts USING (detailed_label)"""


def _severe(spark, sf_dir):
    return balance.severe_classes(scoped(spark, sf_dir))


_SEVERE_SQL = f"""{SCOPED} SELECT detailed_label, global_support, clients_with_class, n AS validation_support FROM facts
  JOIN scoped USING (detailed_label) WHERE scope = 'global' AND split = 'validation'
  AND (clients_with_class = 1 OR global_support < 30 OR n = 0)"""


def _features(spark, sf_dir):
    """Edge features, one of them constant and one a missing flag."""
    rows = views.raw_edges(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn(
        "disc_missing", (F.col("f_disc") == 0).cast("int")
    )
    return round_all(balance.feature_distribution(rows, [*EDGE_FEATURES, "one", "disc_missing"]))


def _feature_sql(name, expression):
    rate = f"{rounded_sql(f'avg(x)', 6)}" if name.endswith("_missing") else "NULL::DOUBLE"
    return f"""SELECT coalesce(scenario, 'global') AS scope, '{name}' AS feature, count(*) AS rows, 0 AS nonfinite,
  {rounded_sql('avg(x)', 6)} AS mean, {rounded_sql('stddev_pop(x)', 6)} AS std, {rounded_sql('min(x)', 6)} AS min, {rounded_sql('max(x)', 6)} AS max,
  {rounded_sql('CAST(count(*) FILTER (x = 0) AS DOUBLE) / count(*)', 6)} AS zero_rate, stddev_pop(x) <= 1e-8 AS near_constant, {rate} AS missing_rate
FROM (SELECT scenario, CAST({expression} AS DOUBLE) AS x FROM raw_edges) GROUP BY GROUPING SETS ((scenario), ())"""


_FEATURES_SQL = f"WITH {RAW_EDGES} " + " UNION ALL ".join(
    _feature_sql(name, expression)
    for name, expression in [*[(f, f) for f in EDGE_FEATURES], ("one", "1"), ("disc_missing", "f_disc = 0")]
)


def _labels(spark, sf_dir):
    return round_all(balance.label_distribution(views.labelled_flows(spark, sf_dir)))


_LABELS_SQL = f"""{LABELLED}, c AS (SELECT scenario, detailed_label, count(*) AS n FROM labelled_flows GROUP BY ALL)
SELECT scenario, detailed_label, n, {rounded_sql('100 * CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY scenario)', 6)} AS percent FROM c"""


def _presence(spark, sf_dir):
    return balance.presence_matrix(views.labelled_flows(spark, sf_dir), SENSORS)


_PRESENT = " + ".join(f"CAST(count(*) FILTER (scenario = '{s}') > 0 AS INTEGER)" for s in SENSORS)
_PRESENCE_SQL = f"""{LABELLED} SELECT detailed_label, {', '.join(f"count(*) FILTER (scenario = '{s}') AS \"{s}\"" for s in SENSORS)},
  count(*) AS total, ({_PRESENT}) = 1 AS private, count(*) < 1000 AS rare FROM labelled_flows GROUP BY detailed_label"""


def _cap(spark, sf_dir):
    return round_all(balance.suggest_cap(views.labelled_flows(spark, sf_dir)))


_CAP_SQL = f"""{LABELLED}, c AS (SELECT scenario, detailed_label, count(*) AS n FROM labelled_flows GROUP BY ALL),
s AS (SELECT scenario, sum(n) AS total, count(*) AS classes, max(n) AS most, min(n) AS least_n, median(n) AS med FROM c GROUP BY scenario)
SELECT scenario, total, classes, {rounded_sql('CAST(most AS DOUBLE) / least_n', 6)} AS ratio, CASE WHEN total >= 1000 THEN
  greatest(greatest(CAST(floor(CASE WHEN most / CAST(least_n AS DOUBLE) <= 100 THEN least(med * 5, most) ELSE greatest(med, 5000) END) AS BIGINT), 1000),
    CASE WHEN classes <= 2 THEN 10000 ELSE 0 END) END AS suggested_cap FROM s"""


def _verify(spark, sf_dir):
    """The clean view against a taxonomy that lacks one of its labels."""
    flows = views.clean_flows(spark, sf_dir).select("scenario", "orig_h", "resp_h", "detailed_label")
    rows = balance.verify_dataset(flows, (*SENSORS, "sensor-9"), ("Benign", "click", "error", "purchase", "other"))
    return rows.select(
        *[c for c in rows.columns if c not in ("label_counts", "missing_labels", "unexpected_labels")],
        F.concat_ws(",", "missing_labels").alias("missing_labels"),
        F.concat_ws(",", "unexpected_labels").alias("unexpected_labels"),
        F.coalesce(F.col("label_counts")["Benign"], F.lit(0)).alias("benign_rows"),
    )


_VERIFY_SQL = f"""{CLEANED}, need AS (SELECT unnest({[*SENSORS, 'sensor-9']!r}) AS scenario),
tax AS (SELECT unnest(['Benign', 'click', 'error', 'other', 'purchase']) AS label),
obs AS (SELECT DISTINCT scenario, detailed_label AS label FROM clean_flows),
mis AS (SELECT scenario, string_agg(label, ',' ORDER BY label) AS m FROM need, tax WHERE (scenario, label) NOT IN (SELECT (scenario, label) FROM obs) GROUP BY scenario),
une AS (SELECT scenario, string_agg(label, ',' ORDER BY label) AS u FROM obs WHERE label NOT IN (SELECT label FROM tax) GROUP BY scenario),
st AS (SELECT scenario, count(*) AS n, count(DISTINCT orig_h) AS s, count(DISTINCT resp_h) AS d,
  count(*) FILTER (detailed_label = 'Benign') AS b FROM clean_flows GROUP BY scenario)
SELECT scenario, coalesce(n, 0) AS raw_rows, coalesce(n, 0) AS clean_rows, 0 AS parse_error_rows, coalesce(s, 0) AS unique_sources,
  coalesce(d, 0) AS unique_destinations, 'ERROR' AS status, coalesce(m, '') AS missing_labels, coalesce(u, '') AS unexpected_labels,
  coalesce(b, 0) AS benign_rows FROM need LEFT JOIN st USING (scenario) LEFT JOIN mis USING (scenario) LEFT JOIN une USING (scenario)"""


def _statuses(spark, sf_dir):
    """Scenarios that are whole, that lack a label, that have one too many, that have bad lines, and one without rows."""
    label = F.col("detailed_label")
    flows = views.clean_flows(spark, sf_dir).select("scenario", "orig_h", "resp_h", "detailed_label")
    known = label.isin("Benign", "click", "error") | (F.col("scenario") == SENSORS[2])
    rows = flows.where(known & ((label != "error") | (F.col("scenario") != SENSORS[1])))
    bad = flows.groupBy("scenario").agg(F.count_if(F.col("scenario") == SENSORS[4]).alias("parse_error_rows"))
    found = balance.verify_dataset(rows, (*SENSORS, "sensor-9"), ("Benign", "click", "error"), bad_rows=bad)
    return found.select(
        "scenario", "raw_rows", "clean_rows", "parse_error_rows", "status",
        F.concat_ws(",", "missing_labels").alias("missing_labels"), F.concat_ws(",", "unexpected_labels").alias("unexpected_labels"),
    )


_STATUSES_SQL = f"""{CLEANED}, need AS (SELECT unnest({[*SENSORS, 'sensor-9']!r}) AS scenario),
tax AS (SELECT unnest(['Benign', 'click', 'error']) AS label),
v AS (SELECT scenario, detailed_label AS label FROM clean_flows WHERE (detailed_label IN (SELECT label FROM tax) OR scenario = '{SENSORS[2]}')
  AND (detailed_label <> 'error' OR scenario <> '{SENSORS[1]}')),
c AS (SELECT scenario, count(*) AS n FROM v GROUP BY scenario),
e AS (SELECT scenario, count(*) FILTER (scenario = '{SENSORS[4]}') AS bad FROM clean_flows GROUP BY scenario),
mis AS (SELECT scenario, string_agg(label, ',' ORDER BY label) AS m FROM need, tax WHERE (scenario, label) NOT IN (SELECT (scenario, label) FROM v) GROUP BY scenario),
une AS (SELECT scenario, string_agg(label, ',' ORDER BY label) AS u FROM (SELECT DISTINCT * FROM v) WHERE label NOT IN (SELECT label FROM tax) GROUP BY scenario)
SELECT scenario, coalesce(n, 0) + coalesce(bad, 0) AS raw_rows, coalesce(n, 0) AS clean_rows, coalesce(bad, 0) AS parse_error_rows,
  CASE WHEN u IS NOT NULL OR bad > 0 OR n IS NULL THEN 'ERROR' WHEN m IS NOT NULL THEN 'WARNING' ELSE 'OK' END AS status,
  coalesce(m, '') AS missing_labels, coalesce(u, '') AS unexpected_labels
FROM need LEFT JOIN c USING (scenario) LEFT JOIN e USING (scenario) LEFT JOIN mis USING (scenario) LEFT JOIN une USING (scenario)"""


QUERIES = {
    "class_distribution": (
        _distribution, f"{SCOPED} SELECT scope, split, detailed_label, n, {rounded_sql('share', 6)} AS share FROM shares",
    ),
    "entropy_bits": (_entropy, _ENTROPY_SQL),
    "js_divergence_from_union": (_js, f"{SCOPED}, {JS} SELECT scope, {rounded_sql('js', 6)} AS js_from_union_bits FROM js"),
    "balance_summary": (_summary, _SUMMARY_SQL),
    "class_support_by_client": (_support, _SUPPORT_SQL),
    "severe_classes": (_severe, _SEVERE_SQL),
    "feature_distribution": (_features, _FEATURES_SQL),
    "label_distribution": (_labels, _LABELS_SQL),
    "presence_matrix": (_presence, _PRESENCE_SQL),
    "suggest_cap": (_cap, _CAP_SQL),
    "verify_dataset": (_verify, _VERIFY_SQL),
    "verify_dataset_statuses": (_statuses, _STATUSES_SQL),
}
