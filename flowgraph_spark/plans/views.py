"""Flow, edge, prediction and parameter views derived from the given tables.

Each view exists twice: as a DataFrame and as a SQL common table expression
with the same columns, so that every query can be compared with an oracle.
"""

from pyspark.sql import functions as F

# Fixed values of the derived views.
CLASSES = ("Benign", "click", "error", "purchase", "signup")
SENSORS = tuple(f"sensor-{i}" for i in range(6))
EDGE_CLASSES = ("AF", "AO", "NF", "NO", "RF", "RO")
CLIENTS = tuple(f"client-{i}" for i in range(6))
PARAM_CLASSES = 8
PARAM_ROW_WIDTH = 6


# Rounding for comparisons: the shift keeps exact decimal ties from depending on
# how an engine stores them.
TIE_SHIFT = 1e-9


def rounded(column, digits):
    return F.round(column + F.lit(TIE_SHIFT), digits)


def rounded_sql(expression, digits):
    return f"round({expression} + CAST({TIE_SHIFT!r} AS DOUBLE), {digits})"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit_text(column):
    return column.cast("string")


def raw_flows(spark, sf_dir):
    """Connection-log rows as text columns, plus the arrival number ``seq``."""
    events = table(spark, sf_dir, "events")
    i = F.col("event_id")
    # The stored value has no zone; it is read as UTC whatever the session zone is.
    micros = F.expr(
        "unix_micros(cast(convert_timezone('UTC', current_timezone(), ts) as timestamp))"
    )
    seconds = F.concat(
        F.floor(micros / 1000000).cast("string"), F.lit("."),
        F.lpad((micros % 1000000).cast("string"), 6, "0"),
    )
    private = (F.col("event_type") == "purchase") & (F.pmod(F.col("user_id"), F.lit(6)) != 3)
    return events.select(
        i.alias("seq"),
        F.concat(F.lit("sensor-"), _digit_text(F.pmod(F.col("user_id"), F.lit(6)))).alias("scenario"),
        seconds.alias("ts"),
        F.concat(F.lit("C"), _digit_text(i)).alias("uid"),
        F.concat(F.lit("u"), _digit_text(F.col("user_id"))).alias("orig_h"),
        _digit_text(i * 104729 % 65536).alias("orig_p"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("resp_h"),
        _digit_text(i * 7919 % 65536).alias("resp_p"),
        F.when(i % 2 == 0, "tcp").otherwise("udp").alias("proto"),
        F.when(i % 5 == 0, "-").otherwise(F.col("event_type")).alias("service"),
        F.col("value").cast("decimal(14,2)").cast("string").alias("duration"),
        F.when(i % 11 == 0, "-").otherwise(_digit_text(i * 37 % 5000)).alias("orig_bytes"),
        F.when(i % 13 == 0, "(empty)").otherwise(_digit_text(i * 53 % 7000)).alias("resp_bytes"),
        F.when(i % 97 == 0, "-").when(i % 4 == 0, "S0").when(i % 4 == 1, "SF")
        .when(i % 4 == 2, "REJ").otherwise("S1").alias("conn_state"),
        F.lit("-").alias("local_orig"),
        F.lit("-").alias("local_resp"),
        F.lit("0").alias("missed_bytes"),
        F.when(i % 19 == 0, "-").when(i % 3 == 0, "ShADadFf").when(i % 3 == 1, "S")
        .otherwise("DdA").alias("history"),
        _digit_text(i % 50).alias("orig_pkts"),
        _digit_text(i * 41 % 9000).alias("orig_ip_bytes"),
        _digit_text(i % 30).alias("resp_pkts"),
        _digit_text(i * 43 % 8000).alias("resp_ip_bytes"),
        F.lit("(empty)").alias("tunnel_parents"),
        F.when(F.col("event_type") == "view", "Benign").otherwise("Malicious").alias("label"),
        F.when(F.col("event_type") == "view", " - ").when(private, "click")
        .otherwise(F.col("event_type")).alias("detailed_label"),
    )


RAW_FLOWS = """raw_flows AS (
  SELECT event_id AS seq, 'sensor-' || (user_id % 6) AS scenario,
    printf('%.6f', epoch_us(ts) / 1e6) AS ts, 'C' || event_id AS uid,
    'u' || user_id AS orig_h, CAST(event_id * 104729 % 65536 AS VARCHAR) AS orig_p,
    'k' || json_extract_string(props, '$.k') AS resp_h,
    CAST(event_id * 7919 % 65536 AS VARCHAR) AS resp_p,
    CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto,
    CASE WHEN event_id % 5 = 0 THEN '-' ELSE event_type END AS service,
    printf('%.2f', value) AS duration,
    CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(event_id * 37 % 5000 AS VARCHAR) END AS orig_bytes,
    CASE WHEN event_id % 13 = 0 THEN '(empty)' ELSE CAST(event_id * 53 % 7000 AS VARCHAR) END AS resp_bytes,
    CASE WHEN event_id % 97 = 0 THEN '-' WHEN event_id % 4 = 0 THEN 'S0' WHEN event_id % 4 = 1 THEN 'SF'
      WHEN event_id % 4 = 2 THEN 'REJ' ELSE 'S1' END AS conn_state,
    '-' AS local_orig, '-' AS local_resp, '0' AS missed_bytes,
    CASE WHEN event_id % 19 = 0 THEN '-' WHEN event_id % 3 = 0 THEN 'ShADadFf'
      WHEN event_id % 3 = 1 THEN 'S' ELSE 'DdA' END AS history,
    CAST(event_id % 50 AS VARCHAR) AS orig_pkts, CAST(event_id * 41 % 9000 AS VARCHAR) AS orig_ip_bytes,
    CAST(event_id % 30 AS VARCHAR) AS resp_pkts, CAST(event_id * 43 % 8000 AS VARCHAR) AS resp_ip_bytes,
    '(empty)' AS tunnel_parents,
    CASE WHEN event_type = 'view' THEN 'Benign' ELSE 'Malicious' END AS label,
    CASE WHEN event_type = 'view' THEN ' - ' WHEN event_type = 'purchase' AND user_id % 6 <> 3
      THEN 'click' ELSE event_type END AS detailed_label
  FROM events)"""

_NUMBERS = (
    "ts", "duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts",
    "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
)
_PORTS = ("orig_p", "resp_p")
_TEXTS = ("orig_h", "resp_h", "proto", "conn_state", "history", "label")


def _null_token(column):
    return f"CASE WHEN {column} IN ('-', '(empty)') THEN NULL ELSE {column} END"


# Clean flows: label first, tokens to null, lenient casts, fill with flags.
CLEAN_FLOWS = (
    "clean_flows AS (SELECT seq, scenario, "
    + ", ".join(f"{_null_token(c)} AS {c}" for c in _TEXTS)
    + f", coalesce({_null_token('service')}, 'unknown') AS service"
    + ", CASE WHEN trim(detailed_label) IN ('-', '(empty)') THEN 'Benign'"
    + " ELSE trim(detailed_label) END AS detailed_label, "
    + ", ".join(f"coalesce(TRY_CAST({c} AS DOUBLE), 0) AS {c}" for c in _NUMBERS)
    + ", "
    + ", ".join(f"coalesce(TRY_CAST({c} AS BIGINT), 0) AS {c}" for c in _PORTS)
    + ", "
    + ", ".join(
        f"CAST(TRY_CAST({c} AS DOUBLE) IS NULL AS TINYINT) AS {c}_missing"
        for c in (*_NUMBERS, *_PORTS)
    )
    + " FROM raw_flows)"
)


def clean_flows(spark, sf_dir):
    from ..operators.cleaning import clean

    return clean(raw_flows(spark, sf_dir))


def labelled_flows(spark, sf_dir):
    """Narrow flow view for class-based operators: row id, scenario and label."""
    from ..functions.flows import canonical_label

    user, kind = F.col("user_id"), F.col("event_type")
    private = (kind == "purchase") & (F.pmod(user, F.lit(6)) != 3)
    label = F.when(kind == "view", " - ").when(private, "click").otherwise(kind)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("sensor-"), _digit_text(F.pmod(user, F.lit(6)))).alias("scenario"),
        F.concat(F.lit("u"), _digit_text(user)).alias("orig_h"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("resp_h"),
        canonical_label(label).alias("detailed_label"),
    )


LABELLED_FLOWS = """labelled_flows AS (
  SELECT seq, scenario, orig_h, resp_h, CASE WHEN trim(detailed_label) IN ('-', '(empty)') THEN 'Benign'
    ELSE trim(detailed_label) END AS detailed_label FROM raw_flows)"""

EDGE_FEATURES = ("f_qty", "f_price", "f_disc", "f_tax")


def raw_edges(spark, sf_dir):
    """Flow edges between supplier and part addresses, one row per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("client-"), _digit_text(F.col("l_suppkey") % 6)).alias("scenario"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_quantity").cast("long").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        ).alias("edge_key"),
        F.col("l_orderkey").alias("pos"),
        F.concat(F.lit("s"), _digit_text(F.col("l_suppkey"))).alias("orig_h"),
        F.concat(F.lit("p"), _digit_text(F.col("l_partkey"))).alias("resp_h"),
        F.concat("l_returnflag", "l_linestatus").alias("detailed_label"),
        (F.col("l_quantity") / 50).alias("f_qty"),
        (F.col("l_extendedprice") / 100000).alias("f_price"),
        F.col("l_discount").alias("f_disc"),
        F.col("l_tax").alias("f_tax"),
    )


RAW_EDGES = """raw_edges AS (
  SELECT 'client-' || (l_suppkey % 6) AS scenario,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || CAST(l_quantity AS BIGINT) || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS edge_key,
    l_orderkey AS pos, 's' || l_suppkey AS orig_h, 'p' || l_partkey AS resp_h,
    l_returnflag || l_linestatus AS detailed_label, l_quantity / 50 AS f_qty,
    l_extendedprice / 100000 AS f_price, l_discount AS f_disc, l_tax AS f_tax
  FROM lineitem)"""


def split_edges(spark, sf_dir, seed=42):
    """Edges with the taxonomy index and a per-class split."""
    from ..operators.splitting import split_per_class

    return split_per_class(
        raw_edges(spark, sf_dir).withColumn("label_idx", edge_label_index(F.col("detailed_label"))),
        ["scenario", "detailed_label"], "edge_key", (0.7, 0.1, 0.2), seed,
    )


def edge_label_index(label):
    index = None
    for position, name in enumerate(EDGE_CLASSES):
        index = (
            F.when(label == name, position) if index is None else index.when(label == name, position)
        )
    return index.cast("int")


def split_rule_sql(source, keys, identity, out, seed=42):
    """Oracle text of the per-class split rule."""
    key_list = ", ".join(keys)
    return f"""{out}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {key_list} ORDER BY sha256('{seed}:' || {identity})) AS rk,
    count(*) OVER (PARTITION BY {key_list}) AS n FROM {source}),
{out}_sized AS (SELECT *, CASE WHEN n = 1 THEN 1
      ELSE greatest(1, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)) END AS n_train,
    CASE WHEN n = 1 THEN 0
      WHEN n >= 3 AND CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) = 0 THEN 1
      ELSE CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) END AS n_val0 FROM {out}_ranked),
{out} AS (SELECT * EXCLUDE (n_val0, n_train, n, rk), CASE WHEN rk <= n_train THEN 'train'
    WHEN rk <= n_train + CASE WHEN n > 1 AND n_train + n_val0 >= n THEN greatest(0, n - n_train - 1)
      ELSE n_val0 END THEN 'validation' ELSE 'test' END AS split FROM {out}_sized)"""


EDGE_INDEX_SQL = (
    "CASE detailed_label "
    + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(EDGE_CLASSES))
    + " END"
)
INDEXED_EDGES = f"indexed_edges AS (SELECT *, CAST({EDGE_INDEX_SQL} AS INTEGER) AS label_idx FROM raw_edges)"
SPLIT_EDGES = (
    RAW_EDGES + ",\n" + INDEXED_EDGES + ",\n"
    + split_rule_sql("indexed_edges", ["scenario", "detailed_label"], "edge_key", "split_edges")
)


def predictions(spark, sf_dir):
    """Scored flows: truth, prediction, confidence and probabilities."""
    flows = labelled_flows(spark, sf_dir)
    k = len(CLASSES)
    truth = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("detailed_label")) - 1
    i = F.col("seq")
    top = (F.lit(50) + i % 50) / F.lit(100.0)
    rest = (F.lit(1.0) - F.col("confidence")) / F.lit(float(k - 1))
    base = flows.select(
        "seq", F.col("scenario").alias("client"), "detailed_label",
        truth.cast("int").alias("true_idx"),
        top.alias("confidence"),
        F.when(i % 10 < 7, "train").when(i % 10 == 7, "validation").otherwise("test").alias("split"),
    ).withColumn(
        "pred_idx",
        F.when(F.col("seq") % 7 == 0, (F.col("true_idx") + 1) % k).otherwise(F.col("true_idx")).cast("int"),
    )
    return base.withColumn(
        "probabilities",
        F.array(*[F.when(F.col("pred_idx") == c, F.col("confidence")).otherwise(rest) for c in range(k)]),
    )


PREDICTIONS = RAW_FLOWS + ",\n" + LABELLED_FLOWS + f""",
predictions0 AS (
  SELECT seq, scenario AS client, detailed_label,
    CAST(list_position({list(CLASSES)!r}, detailed_label) - 1 AS INTEGER) AS true_idx,
    (50 + seq % 50) / CAST(100 AS DOUBLE) AS confidence,
    CASE WHEN seq % 10 < 7 THEN 'train' WHEN seq % 10 = 7 THEN 'validation' ELSE 'test' END AS split
  FROM labelled_flows),
predictions1 AS (
  SELECT *, CAST(CASE WHEN seq % 7 = 0 THEN (true_idx + 1) % {len(CLASSES)} ELSE true_idx END AS INTEGER)
    AS pred_idx FROM predictions0),
predictions AS (
  SELECT *, [{", ".join(f"CASE WHEN pred_idx = {c} THEN confidence ELSE (CAST(1 AS DOUBLE) - confidence) / {len(CLASSES) - 1} END" for c in range(len(CLASSES)))}]
    AS probabilities FROM predictions1)"""


def parameters(spark, sf_dir):
    """Model state per client as a long table: mean vector, named and indexed."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), _digit_text(F.col("label"))).alias("client"),
        F.posexplode("embedding").alias("i", "x"),
    )
    means = vectors.groupBy("client", "i").agg(F.avg(F.col("x").cast("double")).alias("value"))
    weight_size = PARAM_CLASSES * PARAM_ROW_WIDTH
    i = F.col("i")
    return means.select(
        "client",
        F.when(i < weight_size, "head.weight").when(i < weight_size + PARAM_CLASSES, "head.bias")
        .otherwise("encoder.weight").alias("param"),
        F.when(i < weight_size, i).when(i < weight_size + PARAM_CLASSES, i - weight_size)
        .otherwise(i - weight_size - PARAM_CLASSES).cast("int").alias("pos"),
        F.when(i < weight_size, F.floor(i / PARAM_ROW_WIDTH))
        .when(i < weight_size + PARAM_CLASSES, i - weight_size).cast("int").alias("row"),
        "value",
    )


def client_weights(spark, sf_dir):
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.concat(F.lit("c"), _digit_text(F.col("label"))).alias("client"))
        .agg(F.count(F.lit(1)).alias("num_examples"))
    )


def class_support(spark, sf_dir):
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(
            F.concat(F.lit("c"), _digit_text(F.col("label"))).alias("client"),
            (F.col("vec_id") % PARAM_CLASSES).cast("int").alias("class_idx"),
        )
        .agg(F.count(F.lit(1)).alias("support"))
    )


PARAMETERS = f"""vectors AS (
  SELECT 'c' || label AS client, unnest(range(len(embedding))) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT client, i, avg(x) AS value FROM vectors GROUP BY client, i),
parameters AS (SELECT client,
    CASE WHEN i < 48 THEN 'head.weight' WHEN i < 56 THEN 'head.bias' ELSE 'encoder.weight' END AS param,
    CAST(CASE WHEN i < 48 THEN i WHEN i < 56 THEN i - 48 ELSE i - 56 END AS INTEGER) AS pos,
    CAST(CASE WHEN i < 48 THEN i // 6 WHEN i < 56 THEN i - 48 END AS INTEGER) AS row, value FROM means),
client_weights AS (SELECT 'c' || label AS client, count(*) AS num_examples FROM embeddings GROUP BY label),
class_support AS (SELECT 'c' || label AS client, CAST(vec_id % 8 AS INTEGER) AS class_idx,
    count(*) AS support FROM embeddings GROUP BY ALL)"""
