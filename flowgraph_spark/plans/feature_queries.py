"""Feature engineering over the clean flow view: fit on train, apply to all."""

import uuid

from pyspark.sql import functions as F

from ..functions import flows as fx
from ..operators import features
from ..operators.splitting import loso_folds, split_per_class
from ..schema import HISTORY_FLAGS, SCALED_COLUMNS
from ..session import checkpoint_dir, cut_lineage
from . import views
from .flow_queries import CLEANED, LABELLED
from .views import split_rule_sql

PROTOS = ("tcp", "udp")
STATES = ("REJ", "S0", "S1", "SF")
SERVICES = ("click", "error", "purchase", "signup", "view")
FLAGS = ("orig_bytes_missing", "resp_bytes_missing")

SPLIT = CLEANED + ",\n" + split_rule_sql(
    "clean_flows", ["scenario", "detailed_label"], "seq", "split_flows"
)


def split_flows(spark, sf_dir):
    return split_per_class(
        views.clean_flows(spark, sf_dir), ["scenario", "detailed_label"], "seq"
    )


def _train(spark, sf_dir):
    return split_flows(spark, sf_dir).where(F.col("split") == "train")


def _ports(spark, sf_dir):
    flows = views.clean_flows(spark, sf_dir)
    return flows.select(
        "seq",
        fx.resp_port_bucket(F.col("resp_p")).alias("resp_port"),
        *features.one_hot(fx.resp_port_bucket(F.col("resp_p")), ("well_known", "registered", "dynamic"), "resp_port"),
        fx.is_wellknown_port(F.col("orig_p")).alias("orig_port_is_wellknown"),
    )


_PORTS_SQL = f"""{CLEANED}, p AS (SELECT *, CASE WHEN resp_p < 1024 THEN 'well_known'
  WHEN resp_p < 49152 THEN 'registered' ELSE 'dynamic' END AS resp_port FROM clean_flows)
SELECT seq, resp_port, CAST(resp_port = 'well_known' AS TINYINT) AS resp_port_well_known,
  CAST(resp_port = 'registered' AS TINYINT) AS resp_port_registered,
  CAST(resp_port = 'dynamic' AS TINYINT) AS resp_port_dynamic,
  CAST(orig_p >= 0 AND orig_p < 1024 AS TINYINT) AS orig_port_is_wellknown FROM p"""


def _vocab(column):
    def run(spark, sf_dir):
        return features.vocabulary(_train(spark, sf_dir), column, by=["scenario"])

    return run, (
        f"{SPLIT} SELECT DISTINCT scenario, {column} FROM split_flows WHERE split = 'train' AND {column} IS NOT NULL"
    )


def _frequent(spark, sf_dir):
    rows = features.frequent_values(_train(spark, sf_dir))
    return rows.withColumn("share", F.round("share", 6))


_FREQUENT_SQL = f"""{SPLIT}, t AS (SELECT * FROM split_flows WHERE split = 'train')
SELECT service, round(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) AS share FROM t
GROUP BY service HAVING count(*) >= 0.01 * (SELECT count(*) FROM t) AND service NOT IN ('unknown', '')"""


def _history(spark, sf_dir):
    flows = views.clean_flows(spark, sf_dir)
    return flows.select(
        "seq", *[n.alias(fx.history_column(flag)) for flag, n in fx.history_counts(F.col("history"))]
    )


def history_sql(flag):
    text = "coalesce(history, '')"
    return f"length({text}) - length(replace({text}, '{flag}', '')) AS {fx.history_column(flag)}"


_HISTORY_SQL = f"{CLEANED} SELECT seq, {', '.join(history_sql(f) for f in HISTORY_FLAGS)} FROM clean_flows"


def _moments(spark, sf_dir):
    rows = features.scaler_moments(_train(spark, sf_dir), by=["scenario"])
    return rows.select(
        "scenario", "column_name", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")
    )


def _moment_sql(column, source, by, where):
    logged = f"ln(1 + {column})"
    return (
        f"SELECT {by}'{column}' AS column_name, round(avg({logged}), 6) AS mean, "
        f"round(CASE WHEN max({logged}) = min({logged}) THEN 1 ELSE stddev_pop({logged}) END, 6) AS scale "
        f"FROM {source} WHERE {where} GROUP BY ALL"
    )


_MOMENTS_SQL = f"{SPLIT} " + " UNION ALL ".join(
    _moment_sql(c, "split_flows", "scenario, ", "split = 'train'") for c in SCALED_COLUMNS
)


def _shared(spark, sf_dir):
    """One fit over all scenarios, as its table."""
    flows = cut_lineage(split_flows(spark, sf_dir))
    fit = features.fit_shared([flows])
    table = features.fitted_table(spark, fit)
    return table.withColumn("mean", F.round("mean", 5)).withColumn("scale", F.round("scale", 5))


def _saved(spark, sf_dir):
    """The fit written to the shared folder, read back, as its table."""
    fit = features.fit_shared([cut_lineage(split_flows(spark, sf_dir))])
    folder = f"{checkpoint_dir(spark)}/fit-{uuid.uuid4().hex}"
    features.save_features(spark, fit, folder)
    table = features.fitted_table(spark, features.load_features(spark, folder))
    return table.withColumn("mean", F.round("mean", 5)).withColumn("scale", F.round("scale", 5))


def _ranked_values(kind, column, extra=""):
    return (
        f"SELECT '{kind}' AS kind, row_number() OVER (ORDER BY {column}) - 1 AS position, {column} AS name, "
        f"NULL::DOUBLE AS mean, NULL::DOUBLE AS scale FROM t WHERE {column} IS NOT NULL GROUP BY {column} {extra}"
    )


_SHARED_SQL = (
    f"{SPLIT}, t AS (SELECT * FROM split_flows WHERE split = 'train') "
    + " UNION ALL ".join(
        [
            _ranked_values("proto", "proto"),
            _ranked_values("conn_state", "conn_state"),
            _ranked_values(
                "service", "service",
                "HAVING count(*) >= 0.01 * (SELECT count(*) FROM t) AND service NOT IN ('unknown', '')",
            ),
        ]
        + [
            f"SELECT 'scaler' AS kind, {i} AS position, '{c}' AS name, round(avg(ln(1 + {c})), 5) AS mean, "
            f"round(CASE WHEN max({c}) = min({c}) THEN 1 ELSE stddev_pop(ln(1 + {c})) END, 5) AS scale FROM t"
            for i, c in enumerate(SCALED_COLUMNS)
        ]
        + [
            f"SELECT 'flags' AS kind, {i} AS position, '{c}' AS name, NULL::DOUBLE AS mean, NULL::DOUBLE AS scale "
            f"FROM t HAVING max({c}) = 1"
            for i, c in enumerate(FLAGS)
        ]
    )
)


def _flags(spark, sf_dir):
    return features.used_flags(_train(spark, sf_dir), by=["scenario"])


_FLAGS_SQL = f"{SPLIT} " + " UNION ALL ".join(
    f"SELECT scenario, '{c}_missing' AS flag FROM split_flows WHERE split = 'train' GROUP BY scenario HAVING max({c}_missing) = 1"
    for c in (*SCALED_COLUMNS, "ts", "orig_p", "resp_p")
)


def _assemble(spark, sf_dir):
    # The fit and the transform read the split; it is written once.
    flows = cut_lineage(split_flows(spark, sf_dir))
    fit = features.fit_features(flows.where(F.col("split") == "train"))
    rows = features.transform(flows, fit, keep=["seq", "split"])
    return rows.select(
        *[
            F.round(F.col(c).cast("double"), 3).alias(c) if c.endswith("_scaled") or c == "ts" else c
            for c in rows.columns
        ]
    )


def seen_sql(column, value, prefix):
    return f"CAST(coalesce({column} = '{value}', FALSE) AS TINYINT) AS \"{prefix}_{value}\""


_ASSEMBLE_SQL = (
    f"{SPLIT}, t AS (SELECT * FROM split_flows WHERE split = 'train'), m AS (SELECT "
    + ", ".join(
        f"avg(ln(1 + {c})) AS {c}_mean, CASE WHEN max({c}) = min({c}) THEN 1 ELSE stddev_pop(ln(1 + {c})) END AS {c}_std"
        for c in SCALED_COLUMNS
    )
    + " FROM t) SELECT seq, split, orig_h, resp_h, round(ts, 3) AS ts, label, detailed_label, "
    + "CAST(resp_p < 1024 AS TINYINT) AS resp_port_well_known, "
    + "CAST(resp_p >= 1024 AND resp_p < 49152 AS TINYINT) AS resp_port_registered, "
    + "CAST(resp_p >= 49152 AS TINYINT) AS resp_port_dynamic, "
    + "CAST(orig_p >= 0 AND orig_p < 1024 AS TINYINT) AS orig_port_is_wellknown, "
    + ", ".join(
        [seen_sql("proto", v, "proto") for v in PROTOS]
        + [seen_sql("service", v, "service") for v in SERVICES]
        + [f"CAST(service NOT IN {SERVICES!r} AS TINYINT) AS service_other"]
        + [seen_sql("conn_state", v, "conn_state") for v in STATES]
        + [history_sql(f) for f in HISTORY_FLAGS]
        + [f"round(CAST(CAST((ln(1 + {c}) - {c}_mean) / {c}_std AS FLOAT) AS DOUBLE), 3) AS {c}_scaled" for c in SCALED_COLUMNS]
        + list(FLAGS)
    )
    + " FROM split_flows, m"
)


#: Categories with far more than 1,000 values together; addresses and ports of test rows may be unseen.
CATEGORIES = ("proto", "conn_state", "orig_h", "resp_p")
SPARSE_FIT = features.FittedFeatures((), (), (), tuple((c, 1.0, 2.0) for c in SCALED_COLUMNS), FLAGS)


def _sparse(spark, sf_dir):
    flows = cut_lineage(split_flows(spark, sf_dir))
    index = features.category_index(flows.where(F.col("split") == "train"), CATEGORIES)
    rows = features.transform_sparse(flows, SPARSE_FIT, index, CATEGORIES, keep=["seq", "split"])
    return rows.select(
        "seq", "split", "features.size", F.concat_ws(",", F.transform("features.indices", lambda i: i.cast("string"))).alias("indices"),
        F.round(F.aggregate("features.values", F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"),
    )


_DENSE = (
    ["CAST(resp_p < 1024 AS INTEGER)", "CAST(resp_p >= 1024 AND resp_p < 49152 AS INTEGER)", "CAST(resp_p >= 49152 AS INTEGER)",
     "CAST(orig_p >= 0 AND orig_p < 1024 AS INTEGER)", "1"]
    + [history_sql(f).rpartition(" AS ")[0] for f in HISTORY_FLAGS]
    + [f"CAST((ln(1 + {c}) - 1) / 2 AS FLOAT)" for c in SCALED_COLUMNS] + list(FLAGS)
)
_SPARSE_SQL = (
    f"{SPLIT}, pairs AS ("
    + " UNION ".join(
        f"SELECT {i} AS no, CAST({c} AS VARCHAR) AS v FROM split_flows WHERE split = 'train' AND {c} IS NOT NULL"
        for i, c in enumerate(CATEGORIES)
    )
    + f"), dim AS (SELECT no, v, row_number() OVER (ORDER BY no, v) - 1 + {len(_DENSE)} AS k FROM pairs), "
    + f"dense AS (SELECT seq, split, {', '.join(CATEGORIES)}, [{', '.join(f'CAST({e} AS DOUBLE)' for e in _DENSE)}] AS x FROM split_flows), "
    + "cells AS (SELECT seq, split, unnest(range(len(x))) AS k, unnest(x) AS x FROM dense"
    + "".join(
        f" UNION ALL SELECT seq, split, k, 1 FROM dense JOIN dim ON no = {i} AND v = CAST({c} AS VARCHAR)" for i, c in enumerate(CATEGORIES)
    )
    + f") SELECT seq, split, (SELECT count(*) FROM dim) + {len(_DENSE)} AS size, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS indices, "
    "round(sum(x), 4) AS total FROM cells WHERE x <> 0 GROUP BY seq, split"
)


def _index_benign_first(spark, sf_dir):
    return features.label_index(views.labelled_flows(spark, sf_dir), "benign_first")


def _index_sorted(spark, sf_dir):
    return features.label_index(views.labelled_flows(spark, sf_dir), "sorted")


def _index_fixed(spark, sf_dir):
    """Rows per index of the fixed taxonomy; an unknown label would fail."""
    flows = views.labelled_flows(spark, sf_dir)
    index = features.label_index(flows, "fixed", taxonomy=views.CLASSES)
    indexed = features.with_label_index(flows, index)
    return indexed.groupBy("detailed_label", "label_idx").agg(F.count(F.lit(1)).alias("n"))


_FIXED_SQL = f"""{LABELLED} SELECT detailed_label, list_position({list(views.CLASSES)!r}, detailed_label) - 1 AS label_idx,
  count(*) AS n FROM labelled_flows GROUP BY ALL"""


def _binary(spark, sf_dir):
    flows = views.labelled_flows(spark, sf_dir)
    return flows.select("seq", fx.binary_label(F.col("detailed_label")).alias("binary_label"))


def _fold_moments(spark, sf_dir):
    """Scaler of every leave-one-out fold in one aggregation."""
    rows = loso_folds(views.clean_flows(spark, sf_dir), views.SENSORS, "detailed_label", "seq")
    fits = features.scaler_moments(rows.where(F.col("role") == "train"), by=["fold"])
    return fits.select("fold", "column_name", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


LOSO = CLEANED + f""",
loso_rows AS (SELECT c.*, fold, fold = scenario AS held_out FROM clean_flows c, (SELECT unnest({list(views.SENSORS)!r}) AS fold)),
loso_ranked AS (SELECT *, row_number() OVER (PARTITION BY fold, detailed_label ORDER BY sha256('42:' || seq)) AS rk,
  count(*) OVER (PARTITION BY fold, detailed_label) AS n FROM loso_rows WHERE NOT held_out),
loso AS (SELECT * EXCLUDE (rk, n, held_out), CASE WHEN rk <= n - CASE WHEN n = 1 THEN 0
    ELSE greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) END THEN 'train' ELSE 'validation' END AS role
  FROM loso_ranked UNION ALL SELECT * EXCLUDE (held_out), 'test' AS role FROM loso_rows WHERE held_out)"""

_FOLD_MOMENTS_SQL = f"{LOSO} " + " UNION ALL ".join(
    _moment_sql(c, "loso", "fold, ", "role = 'train'") for c in SCALED_COLUMNS
)


QUERIES = {
    "port_buckets": (_ports, _PORTS_SQL),
    "fit_vocabulary_proto": _vocab("proto"),
    "fit_vocabulary_conn_state": _vocab("conn_state"),
    "fit_frequent_service": (_frequent, _FREQUENT_SQL),
    "history_flag_counts": (_history, _HISTORY_SQL),
    "fit_log_scaler": (_moments, _MOMENTS_SQL),
    "fit_shared_features": (_shared, _SHARED_SQL),
    "saved_features": (_saved, _SHARED_SQL),
    "used_missing_flags": (_flags, _FLAGS_SQL),
    "assemble_features": (_assemble, _ASSEMBLE_SQL),
    "sparse_features": (_sparse, _SPARSE_SQL),
    "label_index_benign_first": (
        _index_benign_first,
        f"{LABELLED}, l AS (SELECT DISTINCT detailed_label FROM labelled_flows) SELECT detailed_label, row_number() OVER (ORDER BY detailed_label <> 'Benign', detailed_label) - 1 AS label_idx FROM l",
    ),
    "label_index_sorted": (
        _index_sorted,
        f"{LABELLED}, l AS (SELECT DISTINCT detailed_label FROM labelled_flows) SELECT detailed_label, row_number() OVER (ORDER BY detailed_label) - 1 AS label_idx FROM l",
    ),
    "label_index_fixed": (_index_fixed, _FIXED_SQL),
    "binary_label": (
        _binary, f"{LABELLED} SELECT seq, CAST(detailed_label <> 'Benign' AS INTEGER) AS binary_label FROM labelled_flows",
    ),
    "fit_log_scaler_per_fold": (_fold_moments, _FOLD_MOMENTS_SQL),
}
