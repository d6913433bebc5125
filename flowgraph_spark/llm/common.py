"""Small helpers shared by the text operators."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import cut_lineage, forget, table_folder, temporary_tables  # noqa: F401  (re-exported)


def crc_remainder(id_column, modulus):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def texts_of(column):
    """Values of an Arrow string column as str; null becomes ''."""
    return [value if value is not None else "" for value in column.to_pylist()]


def slices(batch, rows=256):
    """An Arrow batch in parts of few rows, so that long texts do not pile up."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def bitmap_of(keys, column, bits):
    """Packed bitmap with bit ``column % bits`` set for every row of ``keys``.

    ``bits`` fixes the size, whatever the number of rows: Spark builds the
    32,768-bit pages and the driver gets at most ``bits / 8`` bytes.
    """
    slot = F.pmod(F.col(column), F.lit(bits)) + 1
    pages = (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    )
    packed = np.zeros((bits // 32768, 4096), np.uint8)
    for row in pages.collect():
        packed[row.page - 1] = np.frombuffer(bytes(row.bits), np.uint8)
    return packed


def bitmap_has(packed, slots):
    """Boolean array: is the bit ``slot % bits`` set for each slot."""
    slots = np.asarray(slots, np.int64) % (packed.size * 8)
    return (packed.ravel()[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


#: Rows of a narrow table (an id and a number or two) that are broadcast: some 10 MB.
BROADCAST_ROWS = 500_000


def bounded(table, rows=BROADCAST_ROWS):
    """A narrow written table, to be broadcast if it has at most ``rows`` rows; a larger
    one is joined as Spark decides."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def groups_in_order(batches, keys):
    """Tables of rows that follow each other with equal ``keys``; null equals null.

    For partitions sorted by ``keys``: each table is a whole group of the partition.
    """
    held, last = [], None

    def close():
        table = pa.Table.from_batches(held)
        held.clear()
        return table

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            codes = pc.fill_null(batch[key].dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            cuts |= codes[1:] != codes[:-1]
        starts = [0, *(np.flatnonzero(cuts) + 1).tolist()]
        for low, high in zip(starts, [*starts[1:], batch.num_rows]):
            own = tuple(batch[key][low].as_py() for key in keys)
            if held and own != last:
                yield close()
            last = own
            held.append(batch.slice(low, high - low))
    if held:
        yield close()
