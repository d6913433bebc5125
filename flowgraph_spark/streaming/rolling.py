"""Rolling windows per sensor as a batch query, without state.

After arrival *i* a sensor's buffer holds the accepted flows seen so far with
``ts >= max_seen - duration``, the newest ``max_flows`` of them by (ts, seq).
A flow is late, and dropped, if ``ts < max_seen_before - lateness``; a dropped
flow never raises the maximum, so the running maximum may include it.

The buffer is found by rank arithmetic instead of a time-range join. Number the
accepted flows of a sensor by (ts, seq). Of the ``hi`` flows with ``ts <=
max_seen`` exactly ``ordinal`` have arrived, so the newest ``max_flows`` arrived
ones all lie in ranks ``(ordinal - max_flows, hi]``. Ranks are cut into buckets
of the flow limit and joined by equality: each window reads about
``max_flows`` plus the flows that arrive out of order, however many flows the
duration holds.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import attach, group_offsets, in_ranges, rank_in_groups
from ..session import cut_lineage


def check_config(duration, max_flows, stride, lateness):
    if duration <= 0 or max_flows < 1:
        raise ValueError("Window duration and flow limit must be positive.")
    if stride < 1:
        raise ValueError("The emission stride must be positive.")
    if lateness < 0:
        raise ValueError("Allowed lateness cannot be negative.")


def arrival_ranges(df: DataFrame, lateness, sensor="sensor_id", seq="seq", ts="ts", by=()) -> DataFrame:
    """Rows with ``late``, ``max_seen`` (after the row), ``__range`` and ``__place`` along arrival."""
    keys = [*by, sensor]
    rows = in_ranges(df, keys, [seq])
    tops = rows.groupBy(*keys, "__range").agg(F.max(ts).alias("__top"))
    past = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    joined = attach(rows, tops.select(*keys, "__range", F.max("__top").over(past).alias("__past")), [*keys, "__range"])
    inside = Window.partitionBy(*keys, "__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    seen = joined.withColumn("__before", F.greatest(F.max(ts).over(inside), F.col("__past")))
    late = F.coalesce(F.col(ts) < F.col("__before") - F.lit(float(lateness)), F.lit(False))
    return seen.withColumns({"late": late, "max_seen": F.greatest(F.col("__before"), F.col(ts))}).drop("__before", "__past")


def flag_late(df: DataFrame, lateness, sensor="sensor_id", seq="seq", ts="ts", by=()) -> DataFrame:
    """Add ``late`` and ``max_seen`` (after the row). At the watermark is accepted."""
    return arrival_ranges(df, lateness, sensor, seq, ts, by).drop("__range", "__place")


def accept(df: DataFrame, lateness, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Accepted flows with their accepted ordinal (from 1) and the sensor's total.

    The flows are sorted by arrival once; the ordinal is the place among the accepted
    ones of a range plus those of earlier ranges.
    """
    kept = cut_lineage(arrival_ranges(df, lateness, sensor, seq, ts).where(~F.col("late")).drop("late"))
    counted = attach(kept, group_offsets(kept, [sensor], {"accepted": F.lit(1)}), [sensor, "__range"])
    inside = Window.partitionBy(sensor, "__range").orderBy("__place")
    return counted.select(
        *df.columns, "max_seen", (F.row_number().over(inside) + F.col("accepted_before")).alias("ordinal"), "accepted_total"
    )


def accept_ranked(df: DataFrame, lateness, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Accepted flows with ordinal and ``rank`` by (ts, seq), materialised.

    Emissions, reach and buffer contents all read this table. Each step below
    sorts its rows into ranges of the sensor's order, of which a busy sensor
    spans many.
    """
    counted = accept(df, lateness, sensor, seq, ts)
    return cut_lineage(rank_in_groups(counted, [sensor], [ts, seq], rank="rank"))


def contexts(ranked: DataFrame, emissions: DataFrame, duration, max_flows, payload, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Long form ``(emission columns..., payload, __ts, __seq, __ordinal, newest)``.

    One row per emission and flow in its buffer; ``newest`` counts from 1 for the
    newest flow. ``ranked`` comes from :func:`accept_ranked`; ``emissions`` are
    rows of it with ``ordinal`` and ``max_seen``.
    """
    width = max_flows
    reach = ranked.groupBy(F.col(sensor).alias("__s"), F.col(ts).alias("__t")).agg(
        F.max("rank").alias("__hi")
    )
    bounded = emissions.join(
        reach, (F.col(sensor) == F.col("__s")) & (F.col("max_seen") == F.col("__t"))
    ).drop("__s", "__t")
    low = F.greatest(F.col("ordinal") - max_flows, F.lit(0))
    first, last = F.floor(low / F.lit(width)), F.floor((F.col("__hi") - 1) / F.lit(width))
    probes = bounded.withColumn("__lo", low).withColumn("__rb", F.explode(F.sequence(first, last)))
    flows = ranked.select(
        F.col(sensor).alias("__fs"), F.floor((F.col("rank") - 1) / F.lit(width)).alias("__frb"),
        F.col("rank").alias("__frank"), F.col(seq).alias("__seq"), F.col(ts).alias("__ts"),
        F.col("ordinal").alias("__ordinal"), *[F.col(c).alias(f"flow_{c}") for c in payload],
    )
    joined = probes.join(
        flows,
        (F.col(sensor) == F.col("__fs"))
        & (F.col("__rb") == F.col("__frb"))
        & (F.col("__frank") > F.col("__lo"))
        & (F.col("__frank") <= F.col("__hi"))
        & (F.col("__seq") <= F.col(seq))
        & (F.col("__ts") >= F.col("max_seen") - F.lit(float(duration))),
    )
    # At most max_flows plus the out-of-order flows of one emission meet here.
    order = Window.partitionBy(sensor, seq).orderBy(F.desc("__ts"), F.desc("__seq"))
    return (
        joined.withColumn("newest", F.row_number().over(order))
        .where(F.col("newest") <= max_flows)
        .drop("__fs", "__frb", "__frank", "__rb", "__lo", "__hi")
    )


def emission_rows(accepted: DataFrame, stride, flush=True, sensor="sensor_id") -> DataFrame:
    """Accepted rows at which a window is emitted, with its number and id.

    A window goes out at every ``stride``-th accepted flow; ``flush`` also emits
    the tail of each sensor.
    """
    ordinal, total = F.col("ordinal"), F.col("accepted_total")
    at_stride = ordinal % stride == 0
    chosen = at_stride | (ordinal == total) if flush else at_stride
    number = F.ceil(ordinal / F.lit(stride))
    return accepted.where(chosen).withColumns(
        {
            "window_no": number,
            "window_id": window_id(F.col(sensor), number),
        }
    )


def window_id(sensor, number):
    return F.format_string("%s-window-%08d", sensor, number.cast("long"))


def rolling_windows(df: DataFrame, duration, max_flows, stride, lateness, payload=(), flush=True, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Windows in long form, one row per window and flow.

    ``position`` is the flow's index in (ts, seq) order; ``is_new`` marks the
    flows this window emits for the first time.
    """
    check_config(duration, max_flows, stride, lateness)
    accepted = accept_ranked(df, lateness, sensor, seq, ts)
    emissions = emission_rows(accepted, stride, flush, sensor).select(
        sensor, seq, "ordinal", "max_seen", "window_no", "window_id"
    )
    rows = contexts(accepted, emissions, duration, max_flows, payload, sensor, seq, ts)
    size = F.count(F.lit(1)).over(Window.partitionBy(sensor, seq))
    start = F.min("__ts").over(Window.partitionBy(sensor, seq))
    return rows.select(
        sensor, "window_id", "window_no", start.alias("start_ts"), F.col("max_seen").alias("end_ts"),
        F.col("__seq").alias("flow_seq"), F.col("__ts").alias("flow_ts"),
        (size - F.col("newest")).alias("position"),
        (F.col("__ordinal") > (F.col("window_no") - 1) * stride).alias("is_new"),
        *[F.col(f"flow_{c}").alias(c) for c in payload],
    )


def snapshots(windows: DataFrame, payload, sensor="sensor_id") -> DataFrame:
    """One row per window: its flows as an array and the indices newly emitted.

    The arrays hold at most the flow limit of the window.
    """
    flow = F.struct("position", "is_new", "flow_seq", "flow_ts", *payload)
    packed = windows.groupBy(sensor, "window_id", "window_no", "start_ts", "end_ts").agg(
        F.array_sort(F.collect_list(flow)).alias("flows")
    )
    fresh = F.filter("flows", lambda f: f["is_new"])
    return packed.withColumn("emission_indices", F.transform(fresh, lambda f: f["position"].cast("int")))


def window_counters(df: DataFrame, duration, max_flows, lateness, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Per sensor: accepted, late, capacity evictions and both rates.

    An arrival evicts a flow exactly when it is itself inside the duration and
    ``max_flows + 1`` arrived flows are. Evicted flows were accepted, so they are
    not input loss.
    """
    flagged = flag_late(df, lateness, sensor, seq, ts)
    counts = flagged.groupBy(sensor).agg(
        F.count_if(~F.col("late")).alias("accepted"), F.count_if(F.col("late")).alias("late_dropped")
    )
    accepted = accept_ranked(df, lateness, sensor, seq, ts)
    arrivals = accepted.where(F.col(ts) >= F.col("max_seen") - F.lit(float(duration))).select(
        sensor, seq, "ordinal", "max_seen"
    )
    full = contexts(accepted, arrivals, duration, max_flows + 1, (), sensor, seq, ts)
    evicted = full.where(F.col("newest") == max_flows + 1).groupBy(sensor).agg(
        F.count(F.lit(1)).alias("capacity_evictions")
    )
    a, late = F.col("accepted"), F.col("late_dropped")
    gone = F.coalesce("capacity_evictions", F.lit(0))
    return counts.join(evicted, sensor, "left").select(
        sensor, "accepted", "late_dropped", gone.alias("capacity_evictions"),
        F.when(a + late > 0, late / (a + late)).otherwise(0.0).alias("flow_drop_rate"),
        F.when(a > 0, gone / a).otherwise(0.0).alias("capacity_eviction_rate"),
    )


def late_event_probe(df: DataFrame, lateness, sensor="sensor_id", seq="seq", ts="ts", every=20) -> DataFrame:
    """Swap every 20th adjacent pair in time order and count the flows lost."""
    ranked = rank_in_groups(df.select(sensor, seq, ts), [sensor], [ts, seq], rank="__r", total="__n")
    offset = F.col("__r") - 1
    moved = (
        F.when((offset % every == 0) & (F.col("__r") < F.col("__n")), offset + 1)
        .when(offset % every == 1, offset - 1)
        .otherwise(offset)
    )
    swapped = ranked.select(sensor, ts, moved.alias("arrival"))
    flagged = flag_late(swapped, lateness, sensor, "arrival", ts)
    lost = F.count_if(F.col("late"))
    return flagged.groupBy(sensor).agg(
        F.count(F.lit(1)).alias("input_flows"), lost.alias("late_drop_count"),
        (lost / F.count(F.lit(1))).alias("flow_drop_rate"),
    )


def grid_contexts(df: DataFrame, durations, limits, lateness, values, same, keep=(), sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Context of every accepted flow under every (duration, limit), from one sweep.

    One row per flow and candidate: ``keep``, duration, max_flows, ``context`` (flows
    in the buffer) and ``<value>_mean`` over the flows of the buffer with the same
    ``same`` as the flow; null ``same`` meets none.

    Flows are sorted into ranges of arrival. Each range is swept in order with the
    newest flows that arrived before it, at most the largest limit of them; sums follow
    the flows that enter and leave the buffer of each candidate. So every flow is
    shuffled a fixed number of times, whatever the limits are.
    """
    columns = list(dict.fromkeys([sensor, seq, ts, same, *values, *keep]))
    accepted = arrival_ranges(df.select(*columns), lateness, sensor, seq, ts).where(~F.col("late")).drop("late")
    accepted = cut_lineage(accepted)
    halo = earlier_flows(accepted, max(limits), [same, *values], sensor, seq, ts)
    marked = accepted.withColumn("__halo", F.lit(0)).unionByName(halo.withColumn("__halo", F.lit(1)), allowMissingColumns=True)
    dealt = marked.repartition(sensor, "__range").sortWithinPartitions(sensor, "__range", F.desc("__halo"), "__place")
    kept = list(dict.fromkeys([sensor, seq, ts, *keep]))
    candidates = [(float(d), int(m)) for d in durations for m in limits]
    kinds = dict(accepted.dtypes)
    schema = ", ".join(
        [f"`{c}` {kinds[c]}" for c in kept] + ["duration double", "max_flows int", "context int"]
        + [f"`{v}_mean` double" for v in values]
    )
    return dealt.mapInArrow(_sweep(candidates, list(values), same, kept, sensor, seq, ts), schema)


def earlier_flows(accepted: DataFrame, limit, carried, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """For each range of ``accepted`` the newest ``limit`` flows that arrived before it.

    A range hands on its own newest flows only, so a sensor's ranges meet as
    ``limit`` rows each, however many flows they hold.
    """
    newest = Window.partitionBy(sensor, "__range").orderBy(F.desc(ts), F.desc(seq))
    own = accepted.select(sensor, "__range", ts, seq, *carried, F.row_number().over(newest).alias("__n"))
    own = own.where(F.col("__n") <= limit).drop("__n")
    names = [ts, seq, *carried]

    def run(batches):
        current, held, waiting, reached = None, [], [], None
        for batch in batches:
            out = []
            for key, number, *flow in zip(*(batch[c].to_pylist() for c in [sensor, "__range", *names])):
                if key != current or reached is None:
                    current, held, waiting, reached = key, [], [], number
                elif number != reached:
                    held = heapq.nlargest(limit, held + waiting, key=lambda one: one[:2])
                    out += [(key, number, *one) for one in held]
                    waiting, reached = [], number
                waiting.append(flow)
            if out:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, batch.schema.field(n).type) for c, n in zip(columns, [sensor, "__range", *names])],
                    names=[sensor, "__range", *names],
                )

    dealt = own.repartition(sensor).sortWithinPartitions(sensor, "__range")
    return dealt.mapInArrow(run, dealt.schema)


class CandidateWindow:
    """Buffer of one (duration, limit) with counts and compensated sums per key."""

    def __init__(self, duration, limit, values):
        self.duration, self.limit, self.width = duration, limit, values
        self.heap, self.sums, self.taken = [], {}, 0

    def _add(self, key, sign, values):
        if key is None:
            return
        own = self.sums.setdefault(key, [0] + [0.0] * (2 * self.width))
        own[0] += sign
        if not own[0]:
            del self.sums[key]
            return
        for k, value in enumerate(values):
            if value is None:
                continue
            total, value = own[1 + 2 * k], sign * value
            new = total + value
            # What the rounded sum lost is kept beside it.
            own[2 + 2 * k] += (total - new) + value if abs(total) >= abs(value) else (value - new) + total
            own[1 + 2 * k] = new

    def take(self, ts, seq, key, values, max_seen):
        self.taken += 1
        heapq.heappush(self.heap, (ts, seq, self.taken, key, values))
        self._add(key, 1, values)
        while len(self.heap) > self.limit or self.heap[0][0] < max_seen - self.duration:
            _, _, _, gone, held = heapq.heappop(self.heap)
            self._add(gone, -1, held)

    def means(self, key):
        own = self.sums.get(key) if key is not None else None
        return [None] * self.width if own is None else [(own[1 + 2 * k] + own[2 + 2 * k]) / own[0] for k in range(self.width)]


def _sweep(candidates, values, same, kept, sensor, seq, ts):
    def run(batches):
        current, windows = None, []
        for batch in batches:
            places, out = [], []
            columns = [batch[c].to_pylist() for c in (sensor, "__range", "__halo", ts, seq, same, "max_seen", *values)]
            for place, (key, number, halo, when, arrival, group, seen, *held) in enumerate(zip(*columns)):
                if (key, number) != current:
                    current = key, number
                    windows = [CandidateWindow(d, m, len(values)) for d, m in candidates]
                for window in windows:
                    # A flow of before waits for the next arrival to age it.
                    window.take(when, arrival, group, held, -math.inf if halo else seen)
                if not halo:
                    places.append(place)
                    out += [(w.duration, w.limit, len(w.heap), *w.means(group)) for w in windows]
            if not places:
                continue
            rows = pa.Table.from_batches([batch.select(kept)]).take(pa.array(np.repeat(places, len(candidates))))
            types = [pa.float64(), pa.int32(), pa.int32()] + [pa.float64()] * len(values)
            names = ["duration", "max_flows", "context"] + [f"{v}_mean" for v in values]
            for name, column, kind in zip(names, zip(*out), types):
                rows = rows.append_column(name, pa.array(column, kind))
            yield from rows.combine_chunks().to_batches()

    return run


def coverage(scored: DataFrame, expected: DataFrame, by, identity) -> DataFrame:
    """Per candidate: flows scored, distinct, expected; all equal when sound."""
    total = expected.agg(F.count(F.lit(1))).scalar()
    per_flow = scored.groupBy(*by, *identity).agg(F.count(F.lit(1)).alias("n"))
    return per_flow.groupBy(*by).agg(
        F.sum("n").alias("scored"), F.count(F.lit(1)).alias("distinct_flows"), F.first(total).alias("expected")
    )
