"""Packing of tokenized documents into sequences by the sum-of-squares rule.

Placing a piece changes how many open sequences have each residual gap; it
goes where the sum of the squared counts becomes smallest. Groups of pieces
are packed apart, filled sequences are final, and the pieces of the others
meet again in other groups of the same size, as long as that fills more of
them. No task gets more than a group, and what a group wastes in the end is
little beside its pieces.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import byte_bpe
from .common import cut_lineage, slices, texts_of

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs; groups are as many as the pieces need.
PIECES_PER_GROUP = 40_000
#: Share of the pieces that a level has to settle for another one to follow.
LEAST_SETTLED = 0.02

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs, model, capacity=CAPACITY, end_id=END_ID, keep_ids=False):
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its text followed by ``end_id``; null text is
    empty and leaves ``end_id`` alone. One longer than ``capacity`` is cut so
    that all pieces but the first are full. ``keep_ids`` adds the ids as
    little-endian unsigned 32-bit integers. Repeated rows are cut each.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        words = byte_bpe.encoder(model)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), texts_of(part["text"])):
                    ids = words.encode(text) + tail if text else tail
                    total = len(ids) // 4
                    first = (total - 1) % capacity + 1
                    bounds = [0, *range(first, total + 1, capacity)]
                    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                        own = ids[4 * low : 4 * high]
                        rows.append((doc_id, k, low, high - low, zlib.crc32(own), own if keep_ids else None))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types[: len(names)])], names=names
                )

    schema = _PIECES + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def place(lengths, capacity=CAPACITY):
    """Sequence number and offset of each length, in the given order.

    Returns both as lists, with the levels the sequences reach.
    """
    count = np.zeros(capacity + 1, np.int64)  # open sequences by level
    open_at = [[] for _ in range(capacity + 1)]
    levels, sequence, offset = [], [], []
    for size in lengths:
        # Change of the sum of squares, less two, when level h becomes h + size.
        change = 2 * (count[size : capacity + 1] - count[: capacity + 1 - size])
        change[-1] -= 1  # a filled sequence is not open
        change[0] = 2 * count[size] - 1  # a new sequence
        change[1:][count[1 : capacity + 1 - size] == 0] = 4 * len(lengths) + 4
        level = int(change.argmin())
        if level == 0:
            number = len(levels)
            levels.append(0)
        else:
            number = open_at[level].pop()
            count[level] -= 1
        sequence.append(number)
        offset.append(level)
        levels[number] = level + size
        if level + size < capacity:
            open_at[level + size].append(number)
            count[level + size] += 1
    return sequence, offset, levels


def place_tightly(lengths, capacity=CAPACITY):
    """As :func:`place`, but each piece goes to the fullest open sequence that has room."""
    count = np.zeros(capacity + 1, np.int64)
    open_at = [[] for _ in range(capacity + 1)]
    levels, sequence, offset = [], [], []
    for size in lengths:
        fits = np.flatnonzero(count[: capacity - size + 1])
        level = int(fits[-1]) if len(fits) else 0
        if level:
            number = open_at[level].pop()
            count[level] -= 1
        else:
            number = len(levels)
            levels.append(0)
        sequence.append(number)
        offset.append(level)
        levels[number] = level + size
        if level + size < capacity:
            open_at[level + size].append(number)
            count[level + size] += 1
    return sequence, offset, levels


def place_all(lengths, capacity=CAPACITY, least_filled=0.02):
    """As :func:`place`, but pieces of sequences not filled are placed again.

    Each pass keeps the filled sequences and shuffles the other pieces; when
    under ``least_filled`` of the sequences fill, a last pass in descending
    order of length takes the rest. Lengths that fill no sequence exactly, such as
    many pieces of one length, leave the rule nothing to balance, so the last pass
    goes by the fullest sequence that has room where that needs fewer.
    """
    lengths = np.asarray(lengths, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting, used, turn, last = np.arange(len(lengths)), 0, 0, False
    while len(waiting):
        numbers, offsets, levels = place(lengths[waiting].tolist(), capacity)
        if last:
            tight = place_tightly(lengths[waiting].tolist(), capacity)
            numbers, offsets, levels = min((numbers, offsets, levels), tight, key=lambda one: len(one[2]))
        filled = np.array(levels) == capacity
        numbers = np.array(numbers)
        keep = np.ones(len(waiting), bool) if last else filled[numbers]
        fresh = np.zeros(len(levels), np.int64)
        fresh[np.unique(numbers[keep])] = 1
        fresh = np.cumsum(fresh) - 1 + used
        sequence[waiting[keep]] = fresh[numbers[keep]]
        offset[waiting[keep]] = np.array(offsets)[keep]
        used = max(used, int(fresh[-1]) + 1)
        waiting = np.random.default_rng(turn).permutation(waiting[~keep])
        last = filled.sum() < least_filled * len(levels)
        if last:
            waiting = waiting[np.argsort(-lengths[waiting], kind="stable")]
        turn += 1
    return sequence, offset, used


def pack(pieces, capacity=CAPACITY, pieces_per_group=PIECES_PER_GROUP, least_settled=LEAST_SETTLED):
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Sequences hold at most ``capacity`` tokens, gapless from offset 0. Full
    pieces fill a sequence each and are not shuffled. The order within a group
    is that of hashes, so it does not follow ids or sources. Levels end when one
    group is left or a level settles under ``least_settled`` of its pieces; then each
    group places all it has. Empty in, empty out.
    """
    pieces = cut_lineage(pieces)
    full = pieces.where(F.col("length") >= capacity).select(
        "*",
        (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    done = [full]
    rest = pieces.where(F.col("length") < capacity)
    left, level, stalled = rest.count(), 0, False
    while True:
        groups = max(1, -(-left // pieces_per_group))
        final = groups == 1 or stalled
        # Other groups on every level; rows that are equal in all are told apart by their place.
        key = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level), F.monotonically_increasing_id())
        dealt = (
            rest.withColumn("group", F.pmod(key, F.lit(groups)))
            .repartition(groups, "group")
            .sortWithinPartitions("group", F.xxhash64("ids_crc32", "doc_id", "piece"), "doc_id", "piece")
        )
        packed = cut_lineage(
            dealt.mapInArrow(_packer(capacity, level, final), f"{_PIECES}, sequence_id long, offset long")
        )
        done.append(packed.where("sequence_id is not null"))
        if final:
            break
        rest = packed.where("sequence_id is null").drop("sequence_id", "offset")
        before, left = left, rest.count()
        stalled, level = left > (1 - least_settled) * before, level + 1
    result = done[0]
    for one in done[1:]:
        result = result.unionByName(one)
    return result


def _packer(capacity, level, final):
    """Packs each group of a partition; null sequence_id marks pieces left over."""

    def run(batches):
        task = TaskContext.get().partitionId()
        used, held, group = 0, [], None
        for batch in batches:
            keys = batch["group"].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for low, high in zip([0, *cuts], [*cuts, len(keys)]):
                if high == low:
                    continue
                if held and keys[low] != group:
                    out, used = settle(held, task, used)
                    yield out
                    held = []
                group = keys[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield settle(held, task, used)[0]

    def settle(held, task, used):
        table = pa.Table.from_batches(held).drop(["group"]).combine_chunks()
        lengths = table["length"].to_pylist()
        if final:
            sequence, offset, opened = place_all(lengths, capacity)
            out = np.ones(len(sequence), bool)
        else:
            sequence, offset, levels = place(lengths, capacity)
            opened, out = len(levels), (np.array(levels) == capacity)[sequence]
        base = (level << 56) + (task << 34) + used
        table = table.append_column("sequence_id", pa.array(np.array(sequence, np.int64) + base, mask=~out))
        table = table.append_column("offset", pa.array(np.array(offset, np.int64), mask=~out))
        return table.combine_chunks().to_batches()[0], used + opened

    return run
