"""Exact ranks and running values inside groups of any size.

``row_number() over (partition by label order by ...)`` sends a whole label to
one task. One label can hold a third of all rows, so rows are sorted into
ranges of (group, order) first, as many as the session has shuffle partitions;
a large group spans several. Values inside a range come from the place in it or
from a window, those of earlier ranges from a small table with a row per group
and range. The same steps run at every size, and results equal the plain window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Bits below the range number in a row's place (see monotonically_increasing_id).
PLACE_BITS = 33


def hash_order(seed, *columns) -> Column:
    """Reproducible random order: SHA-256 over the seed and the row identity."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(
        F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256
    )


def in_ranges(df: DataFrame, keys, order) -> DataFrame:
    """Rows with ``__place``, ascending along (keys, order), and ``__range``.

    The rows are written once, since the ranges come from a sample and have to
    be the same for every reader. Equal (keys, order) share a range.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = cut_lineage(dealt.withColumn("__place", F.monotonically_increasing_id()))
    return placed.withColumn("__range", F.shiftright("__place", PLACE_BITS))


def _earlier(keys, by="__range"):
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys, exclusive=False):
    frame = Window.partitionBy(*keys, "__range").orderBy("__place")
    return frame.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def group_offsets(rows: DataFrame, keys, sums) -> DataFrame:
    """Per ``(keys, range)``: totals of earlier ranges and of the whole group.

    ``sums`` maps a name to an expression summed over rows. The result has the
    columns ``<name>_before`` and ``<name>_total`` and a row per group and range
    it reaches into: groups plus ranges at most.
    """
    totals = rows.groupBy(*keys, "__range").agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    whole = Window.partitionBy(*keys)
    return totals.select(
        *keys,
        "__range",
        *[F.coalesce(F.sum(name).over(_earlier(keys)), F.lit(0)).alias(f"{name}_before") for name in sums],
        *[F.sum(name).over(whole).alias(f"{name}_total") for name in sums],
    )


def attach(left: DataFrame, right: DataFrame, keys, how="left") -> DataFrame:
    """Equi join on same-named keys in which null equals null."""
    renamed = right.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & left[key].eqNullSafe(renamed[f"__k{i}"])
    return left.join(renamed, condition, how).drop(*[f"__k{i}" for i in range(len(keys))])


def rank_in_groups(df, keys, order, rank="rank", total=None, limit=None):
    """Exact 1-based ``row_number`` of ``order`` within ``keys``; a null key is a group.

    With ``limit`` only the first rows are kept.
    """
    keys = list(keys)
    rows = in_ranges(df, keys, order)
    ranges = rows.groupBy(*keys, "__range").agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    offsets = ranges.select(
        *keys, "__range", "__first",
        F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    if limit is not None:
        offsets = offsets.where(F.col("__before") < limit)
    # The rows of a group are next to each other in a range, so places count them.
    ranked = attach(rows, offsets, [*keys, "__range"], "inner").withColumn(
        rank, F.col("__before") + F.col("__place") - F.col("__first") + 1
    )
    if limit is not None:
        ranked = ranked.where(F.col(rank) <= limit)
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop("__place", "__range", "__first", "__before", "__total")


#: Bits of a hash that one histogram tells apart, bits compared as a number, and distinct
#: hashes near a cut that one task sorts.
HISTOGRAM_BITS, PREFIX_BITS, NEAR_LIMIT = 12, 56, 100_000


def hash_segments(df, keys, order_hash, cuts, segment="segment", total=None, near_limit=NEAR_LIMIT):
    """Cuts every group into segments along a hash order without ranking it.

    ``cuts(n)`` gives ascending row counts for a group of ``n`` rows; a row of
    rank r gets the number of cuts c with r > c. Keys and the first bits of the hashes
    are written once; ``df`` is read for that, for the few hashes left around a cut and
    for the result. Counts by the first bits of the hash show in which of these buckets
    each cut lies; buckets with too many rows are counted by further bits. The hashes
    left around a cut are sorted, which gives the hash at it. All rows are compared with
    that, so the rows of ``df`` are not shuffled by rank. Rows with equal hashes share a
    segment.
    """
    keys = list(keys)
    rows = df.withColumn("__order", F.unhex(order_hash))
    prefix = F.conv(F.hex(F.substring("__order", 1, PREFIX_BITS // 8)), 16, 10).cast("long")
    placed = rows.select(*keys, "__order", prefix.alias("__p"))
    narrow = cut_lineage(placed.drop("__order"))
    n = F.col("__total")
    width = len(cuts(n))
    found = cut_lineage(_cut_buckets(narrow, keys, cuts))
    bits = PREFIX_BITS - HISTOGRAM_BITS
    while bits > 0 and not found.where(F.col("__n") > near_limit).isEmpty():
        bits = max(0, bits - HISTOGRAM_BITS)
        found = cut_lineage(_refined(narrow, found, keys, bits))
    # Equal hashes are one row here, so a repeated identity cannot fill a task.
    near = _inside_buckets(placed, found, keys).groupBy(*keys, "__i", "__c", "__before", "__order").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__i").orderBy("__order")) + F.col("__before")
    at = near.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__c")) & (F.col("__upto") - F.col("__n") < F.col("__c")))
    bounds = at.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__order"))).alias(f"__h{i}") for i in range(width)]
    )
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    joined = attach(rows, cut_lineage(attach(sizes, bounds, keys)), keys)
    passed = [
        F.when(c <= 0, 1).when(F.col("__order") > F.col(f"__h{i}"), 1).otherwise(0)
        for i, c in enumerate(cuts(n))
    ]
    result = joined.withColumn(segment, sum(passed[1:], passed[0]))
    if total:
        result = result.withColumn(total, n)
    return result.drop("__order", "__total", *[f"__h{i}" for i in range(width)])


def _cut_buckets(narrow, keys, cuts):
    """Per group and cut the bucket of first bits it lies in: its bounds, rows before and rows in it."""
    bits = PREFIX_BITS - HISTOGRAM_BITS
    counts = narrow.groupBy(*keys, F.shiftright("__p", bits).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = counts.select(
        *keys, "__b", "__n",
        F.coalesce(F.sum("__n").over(_earlier(keys, "__b")), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    wanted = F.posexplode(F.array(*[c.cast("long") for c in cuts(F.col("__total"))])).alias("__i", "__c")
    return _holding(ranked.select(*keys, "__b", "__before", "__n", wanted), keys, bits)


def _holding(counted, keys, bits):
    holds = (F.col("__before") < F.col("__c")) & (F.col("__c") <= F.col("__before") + F.col("__n"))
    return counted.where(holds).select(
        *keys, "__i", "__c", "__before", "__n",
        F.shiftleft("__b", bits).alias("__low"), (F.shiftleft(F.col("__b") + 1, bits) - 1).alias("__high"),
    )


def _inside_buckets(narrow, found, keys):
    """Rows of ``narrow`` within the bounds of a cut of their group, once per cut."""
    return attach(found, narrow, keys, "inner").where(F.col("__p").between(F.col("__low"), F.col("__high")))


def _refined(narrow, found, keys, bits):
    """As :func:`_cut_buckets` by further bits, inside the buckets found so far."""
    inside = _inside_buckets(narrow, found, keys)
    counts = inside.groupBy(*keys, "__i", "__c", "__before", F.shiftright("__p", bits).alias("__b")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    earlier = F.coalesce(F.sum("__n").over(_earlier([*keys, "__i"], "__b")), F.lit(0))
    return _holding(counts.withColumn("__before", F.col("__before") + earlier), keys, bits)


def running_sums(df, keys, order, sums, exclusive=False):
    """Running sums of expressions along ``order`` within ``keys``.

    ``sums`` maps output names to expressions. ``exclusive`` leaves the current
    row out. Group totals come along as ``<name>_total``.
    """
    keys = list(keys)
    rows = in_ranges(df, keys, order)
    joined = attach(rows, group_offsets(rows, keys, sums), [*keys, "__range"])
    inside = _inside(keys, exclusive)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(expr).over(inside), F.lit(0)) + F.col(f"{name}_before")).alias(name)
            for name, expr in sums.items()
        ],
        *[f"{name}_total" for name in sums],
    )


def running_max(df, keys, order, value, name, exclusive=False):
    """Running maximum of ``value`` along ``order`` within ``keys``."""
    keys = list(keys)
    rows = in_ranges(df, keys, order)
    per_range = rows.groupBy(*keys, "__range").agg(F.max(value).alias("__max"))
    offsets = per_range.select(*keys, "__range", F.max("__max").over(_earlier(keys)).alias("__earlier"))
    joined = attach(rows, offsets, [*keys, "__range"])
    inside = _inside(keys, exclusive)
    return joined.select(
        *df.columns, F.greatest(F.max(value).over(inside), F.col("__earlier")).alias(name)
    )


def previous_value(df, keys, order, value, name):
    """``lag(value)`` along ``order`` within ``keys``, across the borders of ranges."""
    keys = list(keys)
    rows = in_ranges(df, keys, order)
    last = rows.groupBy(*keys, "__range").agg(
        F.max_by(F.struct(value.alias("v")), F.col("__place")).alias("__last")
    )
    carried = last.select(
        *keys, "__range",
        F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range")).alias("__carry"),
    )
    joined = attach(rows, carried, [*keys, "__range"])
    inside = Window.partitionBy(*keys, "__range").orderBy("__place")
    first = F.row_number().over(inside) == 1
    return joined.select(
        *df.columns, F.when(first, F.col("__carry.v")).otherwise(F.lag(value).over(inside)).alias(name)
    )


def value_counts(df, keys, value):
    """Distinct values per group with their row counts, materialised.

    Rows are counted per value first, so a value shared by a third of all rows
    is one row here. The table has several readers. A row without a value is an error,
    so that no summary leaves rows out unseen; filter them where they are meant to go.
    """
    known = F.when(
        F.col(value).isNull(), F.raise_error(F.lit(f"a row without a value in {value}"))
    ).otherwise(F.col(value)).cast(df.schema[value].dataType)
    counts = df.select(*keys, known.alias(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counts)


def exact_quantiles(counts, keys, value, fractions, nearest=False):
    """Exact quantiles per group from ``value_counts``; no group meets in one task.

    ``fractions`` maps output names to numbers in [0, 1]. Linear interpolation
    between neighbouring ranks by default; ``nearest`` takes the rank
    ``round((n - 1) * f)`` with ties to even. Groups without values are absent.
    """
    keys = list(keys)
    ranked = running_sums(counts, keys, [value], {"cum": F.col("n")})
    first = F.col("cum") - F.col("n")
    outputs, partial = [], []
    for name, fraction in fractions.items():
        target = (F.col("cum_total") - 1) * F.lit(float(fraction))
        if nearest:
            position = F.bround(target)
            holds = (position >= first) & (position < F.col("cum"))
            partial.append(F.max(F.when(holds, F.col(value))).alias(name))
            outputs.append(F.col(name))
        else:
            low, high = F.floor(target), F.ceil(target)
            for tag, position in (("lo", low), ("hi", high)):
                holds = (position >= first) & (position < F.col("cum"))
                partial.append(F.max(F.when(holds, F.col(value))).alias(f"{name}__{tag}"))
            partial.append(F.max(target - low).alias(f"{name}__w"))
            lo, hi, weight = (F.col(f"{name}__{t}") for t in ("lo", "hi", "w"))
            outputs.append((lo + (hi - lo) * weight).alias(name))
    return ranked.groupBy(*keys).agg(*partial).select(*keys, *outputs)


def membership_digest(df, keys, identity, digest="digest", rows="n_rows"):
    """Order-free SHA-256 fingerprint of the set of row identities per group.

    Four 60-bit pieces of each identity's hash are summed exactly in decimal,
    so the fingerprint merges across partitions and never gathers a group.
    """
    hashed = F.sha2(identity.cast("string"), 256)
    pieces = [
        F.conv(F.substring(hashed, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        for i in range(4)
    ]
    totals = [F.sum(p).cast("decimal(38,0)").alias(f"__p{i}") for i, p in enumerate(pieces)]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *totals)
    return grouped.select(
        *keys,
        rows,
        F.sha2(
            F.concat_ws(
                ":", F.col(rows).cast("string"),
                *[F.col(f"__p{i}").cast("string") for i in range(4)],
            ),
            256,
        ).alias(digest),
    )
