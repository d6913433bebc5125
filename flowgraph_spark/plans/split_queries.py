"""Sampling, splitting and repartitioning over the flow and edge views."""

from pyspark.sql import functions as F

from ..operators import repartition, sampling, splitting
from ..session import cut_lineage
from . import views
from .feature_queries import LOSO
from .flow_queries import LABELLED
from .views import CLASSES, CLIENTS, SPLIT_EDGES, split_rule_sql

SPLIT_LABELLED = LABELLED + ",\n" + split_rule_sql(
    "labelled_flows", ["scenario", "detailed_label"], "seq", "split_labelled"
)
EDGES = f"WITH {SPLIT_EDGES}"
CAP = 100

_DIGEST_PIECES = ", ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)) AS VARCHAR) AS p{i}" for i in range(4)
)


def _digest_sql(source, by, identity):
    keys = f"{', '.join(by)}, " if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""h AS (SELECT {keys} sha256({identity}) AS h FROM {source}),
p AS (SELECT {keys} count(*) AS n_rows, {_DIGEST_PIECES} FROM h {group})
SELECT {keys} n_rows, sha256(n_rows || ':' || p0 || ':' || p1 || ':' || p2 || ':' || p3) AS digest FROM p"""


def split_labelled(spark, sf_dir):
    return splitting.split_per_class(
        views.labelled_flows(spark, sf_dir), ["scenario", "detailed_label"], "seq"
    )


def _sample(spark, sf_dir):
    flows = views.labelled_flows(spark, sf_dir)
    return sampling.sample_bottom_k(flows, ["scenario", "detailed_label"], "seq", CAP, 7)


_SAMPLE_SQL = f"""{LABELLED} SELECT * FROM labelled_flows
QUALIFY row_number() OVER (PARTITION BY scenario, detailed_label ORDER BY sha256('7:' || seq)) <= {CAP}"""


def _first_come(spark, sf_dir):
    flows = views.labelled_flows(spark, sf_dir)
    return sampling.cap_first_come(flows, ["scenario", "detailed_label"], "seq", CAP)


_FIRST_SQL = f"""{LABELLED} SELECT * FROM labelled_flows
QUALIFY row_number() OVER (PARTITION BY scenario, detailed_label ORDER BY seq) <= {CAP}"""


def _undersample(spark, sf_dir):
    return sampling.undersample(views.labelled_flows(spark, sf_dir), "seq", 7)


UNDERSAMPLED = f"""{LABELLED}, counts AS (SELECT detailed_label, count(*) AS n FROM labelled_flows GROUP BY ALL),
target AS (SELECT min(n) AS t FROM (SELECT n FROM counts ORDER BY n DESC LIMIT 2)),
undersampled AS (SELECT * FROM labelled_flows QUALIFY
  row_number() OVER (PARTITION BY detailed_label ORDER BY sha256('7:' || seq)) <= (SELECT t FROM target))"""


def _impact(spark, sf_dir):
    flows = views.labelled_flows(spark, sf_dir)
    return sampling.undersample_impact(flows, sampling.undersample(flows, "seq", 7, min_keep=50))


_IMPACT_SQL = f"""{LABELLED}, u AS (SELECT * FROM labelled_flows QUALIFY
  row_number() OVER (PARTITION BY detailed_label ORDER BY sha256('7:' || seq)) <= least(50, (
    SELECT min(n) FROM (SELECT count(*) AS n FROM labelled_flows GROUP BY detailed_label ORDER BY n DESC LIMIT 2)))),
b AS (SELECT orig_h AS node FROM labelled_flows UNION SELECT resp_h FROM labelled_flows),
a AS (SELECT orig_h AS node FROM u UNION SELECT resp_h FROM u)
SELECT (SELECT count(*) FROM labelled_flows) AS edges_before, (SELECT count(*) FROM u) AS edges_after,
  (SELECT count(*) FROM b) AS nodes_before, (SELECT count(*) FROM a) AS nodes_after,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS isolated_nodes"""


def _weights(by, taxonomy, train_only):
    def run(spark, sf_dir):
        flows = split_labelled(spark, sf_dir) if train_only else views.labelled_flows(spark, sf_dir)
        rows = flows.where(F.col("split") == "train") if train_only else flows
        return sampling.class_weights(rows, by=by, taxonomy=taxonomy).withColumn(
            "weight", F.round("weight", 6)
        )

    return run


_EXTRA = (*CLASSES, "unseen")


def _weights_sql(by, train_only):
    source = "(SELECT * FROM split_labelled WHERE split = 'train')" if train_only else "labelled_flows"
    base = SPLIT_LABELLED if train_only else LABELLED
    keys = "".join(f"{b}, " for b in by)
    join = " AND ".join([f"t.{b} = c.{b}" for b in by]) or "TRUE"
    return f"""{base}, c AS (SELECT {keys}detailed_label, count(*) AS n FROM {source} GROUP BY ALL),
t AS (SELECT {keys}sum(n) AS total, count(*) AS k FROM c GROUP BY ALL)
SELECT {"".join(f"c.{b}, " for b in by)}detailed_label, n AS support, round(total / CAST(k * n AS DOUBLE), 6) AS weight
FROM c JOIN t ON {join}"""


_TAXONOMY_WEIGHTS_SQL = f"""{SPLIT_LABELLED}, c AS (SELECT detailed_label, count(*) AS n FROM split_labelled
  WHERE split = 'train' GROUP BY ALL), x AS (SELECT unnest({list(_EXTRA)!r}) AS detailed_label)
SELECT x.detailed_label, coalesce(n, 0) AS support, CASE WHEN n > 0 THEN round((SELECT sum(n) FROM c)
  / CAST((SELECT count(*) FROM c) * n AS DOUBLE), 6) ELSE 0 END AS weight FROM x LEFT JOIN c USING (detailed_label)"""


def _variants(spark, sf_dir):
    """Row counts per class in each imbalance variant, weights beside them."""
    variants = sampling.imbalance_variants(views.labelled_flows(spark, sf_dir), "seq", 7)
    full = sampling.class_counts(variants["full"], ["detailed_label"]).withColumnRenamed("n", "n_full")
    under = sampling.class_counts(variants["undersampled"], ["detailed_label"]).withColumnRenamed("n", "n_undersampled")
    weights = variants["weights"].select("detailed_label", F.round("weight", 6).alias("weight"))
    return full.join(under, "detailed_label").join(weights, "detailed_label")


_VARIANTS_SQL = f"""{UNDERSAMPLED}, u AS (SELECT detailed_label, count(*) AS n FROM undersampled GROUP BY ALL)
SELECT detailed_label, counts.n AS n_full, u.n AS n_undersampled,
  round((SELECT sum(n) FROM counts) / CAST((SELECT count(*) FROM counts) * counts.n AS DOUBLE), 6) AS weight
FROM counts JOIN u USING (detailed_label)"""


def _train_validation(spark, sf_dir):
    return splitting.train_validation_split(
        views.labelled_flows(spark, sf_dir), "detailed_label", "seq"
    ).select("seq", "split")


_TRAIN_VALIDATION_SQL = f"""{LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY detailed_label ORDER BY sha256('42:' || seq)) AS rk,
  count(*) OVER (PARTITION BY detailed_label) AS n FROM labelled_flows)
SELECT seq, CASE WHEN rk <= n - CASE WHEN n = 1 THEN 0 ELSE greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) END
  THEN 'train' ELSE 'validation' END AS split FROM r"""


def _plan_checks(spark, sf_dir):
    flows = views.labelled_flows(spark, sf_dir)
    return splitting.split_plan_checks(split_labelled(spark, sf_dir), ["scenario"], "seq", flows)


_PLAN_SQL = f"""{SPLIT_LABELLED} SELECT scenario, count(*) FILTER (split = 'train') AS n_train,
  count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'test') AS n_test,
  count(*) - count(DISTINCT seq) AS duplicate_ids, count(*) - count(DISTINCT (seq, split)) AS overlapping_ids,
  0 AS coverage_errors FROM split_labelled GROUP BY scenario"""


def _digest(spark, sf_dir):
    return splitting.split_digest(split_labelled(spark, sf_dir), ["scenario"], "seq")


def _loso(spark, sf_dir):
    flows = views.clean_flows(spark, sf_dir).select("seq", "scenario", "detailed_label")
    rows = splitting.loso_folds(flows, views.SENSORS, "detailed_label", "seq")
    return rows.groupBy("fold", "scenario", "detailed_label", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("sum_seq")
    )


def _train_only(spark, sf_dir):
    rows = splitting.undersample_train_only(split_labelled(spark, sf_dir), "seq", 7)
    return rows.select("seq", "split")


_TRAIN_ONLY_SQL = f"""{SPLIT_LABELLED}, tr AS (SELECT * FROM split_labelled WHERE split = 'train'),
target AS (SELECT min(n) AS t FROM (SELECT count(*) AS n FROM tr GROUP BY detailed_label ORDER BY n DESC LIMIT 2))
SELECT seq, split FROM split_labelled WHERE split <> 'train' UNION ALL SELECT seq, split FROM (SELECT * FROM tr QUALIFY
  row_number() OVER (PARTITION BY detailed_label ORDER BY sha256('7:' || seq)) <= (SELECT t FROM target))"""


def _support(spark, sf_dir):
    return splitting.support_by_split(split_labelled(spark, sf_dir), CLASSES, by=["scenario"])


_SUPPORT_SQL = f"""{SPLIT_LABELLED}, x AS (SELECT DISTINCT scenario, unnest({list(CLASSES)!r}) AS detailed_label FROM split_labelled)
SELECT scenario, detailed_label, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test
FROM x LEFT JOIN split_labelled USING (scenario, detailed_label) GROUP BY ALL"""


def _heldout(spark, sf_dir):
    return splitting.heldout_rows(split_labelled(spark, sf_dir), "signup")


def iid_edges(spark, sf_dir):
    # Train rows and held-out rows read the split; it is written once.
    kept = cut_lineage(repartition.drop_and_remap_class(views.split_edges(spark, sf_dir), 3))
    return repartition.repartition_iid(kept, CLIENTS, "edge_key", 11)


IID = f"""{EDGES}, kept AS (SELECT * REPLACE (CASE WHEN label_idx > 3 THEN label_idx - 1 ELSE label_idx END AS label_idx)
  FROM split_edges WHERE label_idx <> 3),
iid AS (SELECT *, CASE WHEN split = 'train' THEN 'client-' || (ntile(6) OVER (PARTITION BY split, label_idx
    ORDER BY sha256('11:' || edge_key)) - 1) ELSE scenario END AS destination FROM kept)"""


def _iid(spark, sf_dir):
    return iid_edges(spark, sf_dir).select("edge_key", "scenario", "split", "label_idx", "destination")


def _drop_class(spark, sf_dir):
    edges = views.raw_edges(spark, sf_dir).withColumn(
        "label_idx", views.edge_label_index(F.col("detailed_label"))
    )
    dropped = repartition.drop_and_remap_class(edges, 3)
    return dropped.groupBy("detailed_label", "label_idx").agg(F.count(F.lit(1)).alias("n"))


_DROP_SQL = f"""{EDGES} SELECT detailed_label, CASE WHEN label_idx > 3 THEN label_idx - 1 ELSE label_idx END AS label_idx,
  count(*) AS n FROM indexed_edges WHERE label_idx <> 3 GROUP BY ALL"""


def _provenance(spark, sf_dir):
    source = views.raw_edges(spark, sf_dir).where(F.col("detailed_label") != "NO")
    return repartition.validate_provenance(source, iid_edges(spark, sf_dir), ["scenario", "edge_key"])


def _provenance_digest(spark, sf_dir):
    return repartition.provenance_digest(iid_edges(spark, sf_dir), "scenario", "edge_key", "destination")


def _edge_split(spark, sf_dir):
    return views.split_edges(spark, sf_dir).select("edge_key", "split")


QUERIES = {
    "sample_bottom_k": (_sample, _SAMPLE_SQL),
    "cap_first_come": (_first_come, _FIRST_SQL),
    "undersample": (_undersample, f"{UNDERSAMPLED} SELECT * FROM undersampled"),
    "undersample_impact": (_impact, _IMPACT_SQL),
    "class_weights_present": (_weights((), None, False), _weights_sql((), False)),
    "class_weights_taxonomy": (_weights((), _EXTRA, True), _TAXONOMY_WEIGHTS_SQL),
    "class_weights_global_train": (_weights((), None, True), _weights_sql((), True)),
    "class_weights_per_client": (_weights(("scenario",), None, True), _weights_sql(("scenario",), True)),
    "imbalance_variants": (_variants, _VARIANTS_SQL),
    "split_per_class": (
        lambda spark, sf_dir: split_labelled(spark, sf_dir).select("seq", "split"),
        f"{SPLIT_LABELLED} SELECT seq, split FROM split_labelled",
    ),
    "split_edges_per_class": (_edge_split, f"{EDGES} SELECT edge_key, split FROM split_edges"),
    "split_train_validation": (_train_validation, _TRAIN_VALIDATION_SQL),
    "split_plan_checks": (_plan_checks, _PLAN_SQL),
    "split_digest": (_digest, f"{SPLIT_LABELLED}, {_digest_sql('split_labelled', ['scenario', 'split'], 'CAST(seq AS VARCHAR)')}"),
    "loso_folds": (
        _loso,
        f"{LOSO} SELECT fold, scenario, detailed_label, role, count(*) AS n, sum(seq) AS sum_seq FROM loso GROUP BY ALL",
    ),
    "undersample_train_only": (_train_only, _TRAIN_ONLY_SQL),
    "support_by_split": (_support, _SUPPORT_SQL),
    "heldout_rows": (
        _heldout,
        f"{SPLIT_LABELLED} SELECT * FROM split_labelled WHERE split <> 'train' AND detailed_label <> 'signup'",
    ),
    "repartition_iid": (_iid, f"{IID} SELECT edge_key, scenario, split, label_idx, destination FROM iid"),
    "drop_and_remap_class": (_drop_class, _DROP_SQL),
    "validate_provenance": (
        _provenance,
        f"{IID} SELECT count(*) - count(DISTINCT edge_key) AS duplicated, 0 AS lost, 0 AS added FROM iid",
    ),
    "provenance_digest": (
        _provenance_digest,
        f"{IID}, {_digest_sql('iid', [], 'scenario || chr(1) || edge_key || chr(1) || destination')}",
    ),
}
