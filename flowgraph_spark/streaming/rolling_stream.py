"""Rolling windows on a stream: one bounded buffer per sensor in the state store.

Needs the RocksDB state store provider. Spark's watermark is global and moves
per micro-batch, so the per-sensor late rule lives in the state. A sensor's
buffer is a map with an entry per flow, at most the flow limit of them; a call
writes the flows that came and removes those that left. Spark gives no order
inside a group: a micro-batch of more than one Arrow batch is first put into a
second map by stretches of the arrival number and read back stretch by stretch,
so a task never holds a sensor's whole batch.
"""

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .rolling import check_config

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Arrival numbers of a stretch, and window rows handed out at once.
STRETCH = 1024
OUTPUT_ROWS = 8192
OUTPUT = (
    "sensor_id string, window_id string, window_no long, start_ts double, end_ts double, "
    "flow_seq long, flow_ts double, position int, is_new boolean, payload string, "
    "accepted long, late_dropped long, capacity_evictions long"
)
COUNTERS = "max_seen double, accepted long, emitted long, shown long, late long, evicted long"
FLOW = "seq long, ts double, payload string"


class RollingBuffer:
    """Buffer of one sensor: a min-heap by (ts, seq, ordinal), so leaving flows are on top.

    ``ordinal`` numbers the accepted flows; those beyond ``shown`` are new to the next
    window. ``came`` and ``left`` tell how the buffer differs from what was given.
    """

    def __init__(self, duration, max_flows, stride, lateness, counters=None, flows=()):
        self.duration, self.max_flows = duration, max_flows
        self.stride, self.lateness = stride, lateness
        self.max_seen, self.accepted, self.emitted, self.shown, self.late, self.evicted = counters or (None, 0, 0, 0, 0, 0)
        self.heap = list(flows)
        heapq.heapify(self.heap)
        self.known = {flow[2] for flow in self.heap}
        self.left = []

    def counters(self):
        return self.max_seen, self.accepted, self.emitted, self.shown, self.late, self.evicted

    def came(self):
        """Flows of the buffer that it was not given."""
        return [flow for flow in self.heap if flow[2] not in self.known]

    def _drop(self):
        ordinal = heapq.heappop(self.heap)[2]
        if ordinal in self.known:
            self.left.append(ordinal)

    def offer(self, ts, seq, payload):
        """Take one arrival; True when a window is due."""
        if self.max_seen is not None and ts < self.max_seen - self.lateness:
            self.late += 1
            return False
        self.max_seen = ts if self.max_seen is None else max(ts, self.max_seen)
        self.accepted += 1
        heapq.heappush(self.heap, (ts, seq, self.accepted, payload))
        while self.heap[0][0] < self.max_seen - self.duration:
            self._drop()
        if len(self.heap) > self.max_flows:
            self._drop()
            self.evicted += 1
        return self.accepted % self.stride == 0

    def pending(self):
        """Are there flows that no window has shown."""
        return bool(self.heap) and self.accepted > self.shown

    def emit(self, sensor):
        """Rows of the current window; the flows it covers are shown."""
        self.emitted += 1
        flows = sorted(self.heap, key=lambda flow: flow[:3])
        name = f"{sensor}-window-{self.emitted:08d}"
        rows = [
            (
                sensor, name, self.emitted, flows[0][0], self.max_seen, seq, ts, position,
                ordinal > self.shown, payload, self.accepted, self.late, self.evicted,
            )
            for position, (ts, seq, ordinal, payload) in enumerate(flows)
        ]
        self.shown = self.accepted
        return rows


class RollingWindowProcessor(StatefulProcessor):
    """Keyed by sensor; ``flush_after_ms`` of silence emits the tail."""

    COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]

    def __init__(self, duration, max_flows, stride, lateness, flush_after_ms=None):
        check_config(duration, max_flows, stride, lateness)
        self.config = (float(duration), int(max_flows), int(stride), float(lateness))
        self.flush_after_ms = flush_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", COUNTERS)
        self.flows = handle.getMapState("flows", "ordinal long", FLOW)
        self.spool = handle.getMapState("spool", "stretch long", "arrivals string")

    def _buffer(self):
        counters = tuple(self.counters.get()) if self.counters.exists() else None
        flows = [(ts, seq, ordinal, payload) for (ordinal,), (seq, ts, payload) in self.flows.iterator()] if counters else []
        return RollingBuffer(*self.config, counters, flows)

    def _save(self, buffer):
        for ordinal in buffer.left:
            self.flows.removeKey((ordinal,))
        for ts, seq, ordinal, payload in buffer.came():
            self.flows.updateValue((ordinal,), (seq, ts, payload))
        self.counters.update(buffer.counters())

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=self.COLUMNS)

    def _arrivals(self, frames):
        """(ts, seq, payload) of a micro-batch in order of ``seq``."""
        first = next(frames)
        second = next(frames, None)
        if second is None:
            yield from _in_order(first)
            return
        for frame in _chain(first, second, frames):
            for stretch, own in frame.groupby(frame["seq"] // STRETCH):
                key = (int(stretch),)
                held = json.loads(self.spool.getValue(key)[0]) if self.spool.containsKey(key) else []
                held += [list(one) for one in _in_order(own)]
                self.spool.updateValue(key, (json.dumps(held),))
        for stretch in sorted(key[0] for key in self.spool.keys()):
            held = json.loads(self.spool.getValue((stretch,))[0])
            self.spool.removeKey((stretch,))
            yield from sorted(held, key=lambda one: one[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer, out = self._buffer(), []
        for ts, seq, payload in self._arrivals(iter(rows)):
            if buffer.offer(ts, seq, payload):
                out += buffer.emit(key[0])
            if len(out) >= OUTPUT_ROWS:
                yield self._frame(out)
                out = []
        self._save(buffer)
        if self.flush_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if buffer.pending():
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(now + self.flush_after_ms)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer = self._buffer()
        if buffer.pending():
            yield self._frame(buffer.emit(key[0]))
            self._save(buffer)

    def close(self) -> None:
        pass


def _in_order(frame):
    ordered = frame.sort_values("seq", kind="stable")
    return zip(ordered["ts"].astype(float).tolist(), ordered["seq"].astype(int).tolist(), ordered["payload"].tolist())


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def rolling_window_stream(
    flows: DataFrame, duration, max_flows, stride, lateness, flush_after_ms=None
) -> DataFrame:
    """Windows in long form from a stream of ``sensor_id, seq, ts, payload``.

    ``payload`` is JSON text carried through the buffer.
    """
    processor = RollingWindowProcessor(duration, max_flows, stride, lateness, flush_after_ms)
    return flows.select("sensor_id", "seq", "ts", "payload").groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if flush_after_ms is None else "ProcessingTime",
    )


def with_payload(flows: DataFrame, columns, sensor="sensor_id", seq="seq", ts="ts") -> DataFrame:
    """Pack columns as the JSON payload of a rolling window stream."""
    return flows.select(
        F.col(sensor).alias("sensor_id"), F.col(seq).alias("seq"), F.col(ts).alias("ts"),
        F.to_json(F.struct(*columns)).alias("payload"),
    )
