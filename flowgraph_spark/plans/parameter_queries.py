"""Parameter averaging over the parameter view."""

from pyspark.sql import functions as F

from ..operators import params as ops
from . import views
from .views import PARAM_ROW_WIDTH, PARAMETERS, rounded, rounded_sql

BASE = f"WITH {PARAMETERS}"
VALUE = rounded_sql("value", 6) + " AS value"


def _inputs(spark, sf_dir):
    return (
        views.parameters(spark, sf_dir), views.client_weights(spark, sf_dir),
        views.class_support(spark, sf_dir),
    )


def _state(df):
    return df.withColumn("value", rounded(F.col("value"), 6))


def _average(mode):
    return lambda spark, sf_dir: _state(ops.aggregate(mode, *_inputs(spark, sf_dir)))


AVERAGES = f"""sample AS (SELECT param, pos, row, sum(value * num_examples) / sum(num_examples) AS value
  FROM parameters JOIN client_weights USING (client) GROUP BY ALL),
support_head AS (SELECT * FROM sample WHERE param = 'encoder.weight' UNION ALL
  SELECT param, pos, row, sum(value * support) / sum(support) AS value FROM parameters p
  JOIN class_support s ON s.client = p.client AND s.class_idx = p.row WHERE param <> 'encoder.weight' GROUP BY ALL),
totals AS (SELECT class_idx, sum(support) AS total FROM class_support GROUP BY ALL),
raw AS (SELECT client, sum(support / CAST(total AS DOUBLE)) / (SELECT count(*) FROM totals) AS raw
  FROM class_support JOIN totals USING (class_idx) GROUP BY client),
balanced_weights AS (SELECT client, raw / (SELECT sum(raw) FROM raw) AS weight FROM raw),
class_balanced AS (SELECT param, pos, row, sum(value * weight) / sum(weight) AS value
  FROM parameters JOIN balanced_weights USING (client) GROUP BY ALL),
class_balanced_head AS (SELECT * FROM class_balanced WHERE param = 'encoder.weight' UNION ALL
  SELECT * FROM support_head WHERE param <> 'encoder.weight')"""
AVERAGED = f"{BASE},\n{AVERAGES}"


def _sql(mode):
    return f"{AVERAGED} SELECT param, pos, row, {VALUE} FROM {mode}"


def _problems(spark, sf_dir):
    """A client without a bias, clients without examples, and values that are not finite."""
    params, weights, _ = _inputs(spark, sf_dir)
    broken = params.where(~((F.col("client") == "c0") & (F.col("param") == "head.bias"))).withColumn(
        "value", F.when(F.col("pos") % 7 == 3, float("nan")).when(F.col("pos") % 7 == 4, float("inf")).when(F.col("pos") % 7 != 5, F.col("value"))
    )
    empty = weights.withColumn("num_examples", F.when(F.col("client").isin("c1", "c2"), 0).otherwise(F.col("num_examples")))
    return ops.state_problems(broken, empty)


def _complex(spark, sf_dir):
    params, weights, _ = _inputs(spark, sf_dir)
    rows = params.select("client", "param", "pos", "row", F.col("value").alias("re"), (F.col("value") * F.col("pos")).alias("im"))
    averaged = ops.weighted_average_complex(rows, weights)
    return averaged.withColumn("re", rounded(F.col("re"), 6)).withColumn("im", rounded(F.col("im"), 6))


def _client_weights(spark, sf_dir):
    rows = ops.class_balanced_client_weights(views.class_support(spark, sf_dir))
    return rows.withColumn("weight", rounded(F.col("weight"), 6))


def _personalised(spark, sf_dir):
    params, weights, _ = _inputs(spark, sf_dir)
    shared, private = ops.split_personalised(params, ["head."])
    return _state(ops.merge_personalised(ops.weighted_average(shared, weights), private))


_PERSONALISED_SQL = f"""{AVERAGED}, merged AS (SELECT client, param, pos, row, value FROM parameters WHERE param LIKE 'head.%'
  UNION ALL SELECT client, param, pos, row, value FROM client_weights, sample WHERE param NOT LIKE 'head.%')
SELECT client, param, pos, row, {VALUE} FROM merged"""


def _before_after(spark, sf_dir):
    """The unweighted mean stands for the state before the round."""
    params, weights, _ = _inputs(spark, sf_dir)
    before = params.groupBy("param", "pos").agg(F.avg("value").alias("value"))
    after = ops.weighted_average(params, weights).drop("row")
    return params, before, after, weights


def _diagnostics(spark, sf_dir):
    rows = ops.update_diagnostics(*_before_after(spark, sf_dir))
    return rows.select(
        "client", "num_examples",
        *[rounded(F.col(c), 5).alias(c) for c in rows.columns if c not in ("client", "num_examples")],
    )


BEFORE = f"""{AVERAGED}, before AS (SELECT param, pos, avg(value) AS b FROM parameters GROUP BY ALL),
joined AS (SELECT p.*, b, s.value AS a FROM parameters p JOIN before USING (param, pos)
  JOIN sample s ON s.param = p.param AND s.pos = p.pos)"""

_DIAGNOSTICS_SQL = f"""{BEFORE}, sums AS (SELECT client, sum((value - b) ** 2) AS delta2, sum(b * b) AS ref2,
  sum((value - a) ** 2) AS dist2, sum((value - b) * (a - b)) AS dot, sum((a - b) ** 2) AS agg2 FROM joined GROUP BY client)
SELECT client, num_examples, {rounded_sql("num_examples / CAST((SELECT sum(num_examples) FROM client_weights) AS DOUBLE)", 5)} AS sample_weight,
  {rounded_sql("sqrt(delta2)", 5)} AS update_l2, {rounded_sql("sqrt(delta2) / sqrt(ref2)", 5)} AS relative_update_l2,
  {rounded_sql("sqrt(dist2)", 5)} AS distance_to_aggregate_l2,
  {rounded_sql("dot / (sqrt(delta2) * sqrt(agg2))", 5)} AS cosine_to_aggregate FROM sums JOIN client_weights USING (client)"""


def _row_updates(spark, sf_dir):
    params, before, _, _ = _before_after(spark, sf_dir)
    return ops.output_row_update_l2(params, before).withColumn("update_l2", rounded(F.col("update_l2"), 5))


def _project(spark, sf_dir):
    params = views.parameters(spark, sf_dir)
    return _state(ops.project_classes(params, 3, {"head.weight": PARAM_ROW_WIDTH, "head.bias": 1}))


_PROJECT_SQL = f"""{BASE} SELECT client, param, CAST(pos - CASE WHEN row > 3 AND param = 'head.weight' THEN 6
    WHEN row > 3 THEN 1 ELSE 0 END AS INTEGER) AS pos, CAST(CASE WHEN row > 3 THEN row - 1 ELSE row END AS INTEGER) AS row,
  {VALUE} FROM parameters WHERE row IS NULL OR row <> 3"""


def _scalars(spark, sf_dir):
    """One metric per place of the vectors; every ninth is not reported by client 0."""
    vectors = views.table(spark, sf_dir, "embeddings").select(
        "label", F.concat(F.lit("c"), F.col("label").cast("string")).alias("client"), F.posexplode("embedding").alias("place", "x")
    )
    named = vectors.where((F.col("label") > 0) | (F.col("place") % 9 != 0))
    metrics = named.groupBy("client", F.format_string("m%02d", "place").alias("metric")).agg(F.avg(F.col("x").cast("double")).alias("value"))
    return _state(ops.weighted_scalar_metrics(metrics, views.client_weights(spark, sf_dir)))


_SCALARS_SQL = f"""SELECT printf('m%02d', k - 1) AS metric, {rounded_sql('avg(CAST(embedding[k] AS DOUBLE))', 6)} AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS k) WHERE (k - 1) % 9 <> 0 GROUP BY k"""


def _payload(spark, sf_dir):
    return ops.payload_bytes(views.parameters(spark, sf_dir))


QUERIES = {
    "weighted_average": (_average("sample"), _sql("sample")),
    "weighted_average_complex": (
        _complex,
        f"""{BASE} SELECT param, pos, row, {rounded_sql('sum(value * num_examples) / sum(num_examples)', 6)} AS re,
  {rounded_sql('sum(value * pos * num_examples) / sum(num_examples)', 6)} AS im
FROM parameters JOIN client_weights USING (client) GROUP BY ALL""",
    ),
    "parameter_state_problems": (
        _problems, f"""{BASE} SELECT (SELECT count(*) FROM client_weights WHERE client IN ('c1', 'c2')) AS bad_weights,
  count(DISTINCT pos) FILTER (param = 'head.bias') AS bad_keys,
  count(*) FILTER (pos % 7 IN (3, 4, 5) AND NOT (client = 'c0' AND param = 'head.bias')) AS bad_values FROM parameters""",
    ),
    "class_support_head_average": (_average("support_head"), _sql("support_head")),
    "class_balanced_client_weights": (
        _client_weights, f"{AVERAGED} SELECT client, {rounded_sql('weight', 6)} AS weight FROM balanced_weights",
    ),
    "class_balanced_average": (_average("class_balanced"), _sql("class_balanced")),
    "class_balanced_head_average": (_average("class_balanced_head"), _sql("class_balanced_head")),
    "personalised_state": (_personalised, _PERSONALISED_SQL),
    "update_diagnostics": (_diagnostics, _DIAGNOSTICS_SQL),
    "output_row_update_l2": (
        _row_updates,
        f"{BEFORE} SELECT client, row, {rounded_sql('sqrt(sum((value - b) ** 2))', 5)} AS update_l2 FROM joined WHERE param <> 'encoder.weight' GROUP BY ALL",
    ),
    "project_classes": (_project, _PROJECT_SQL),
    "weighted_scalar_metrics": (_scalars, _SCALARS_SQL),
    "payload_bytes": (
        _payload,
        f"{BASE} SELECT count(*) * 4 AS upload_bytes, count(*) * 4 AS download_bytes, count(DISTINCT client) AS participants FROM parameters",
    ),
}
