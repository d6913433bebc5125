"""Exact top-k search by inner product: tiled matrix products and merged lists.

Candidates are stacked into shards and queries into blocks. Each pair of a
block and a shard is one matrix product, from which only the best ``k`` of
every query are kept. The lists of one block then meet in a tree: groups of
``FAN_IN`` lists first, until one list per query is left.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
#: Rows of a shard and of a query block; a tile holds their product.
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: By how many candidates usually outnumber queries; it sets how often shards and blocks are copied.
CANDIDATES_PER_QUERY = 50
#: Lists that meet on one level of the tree.
FAN_IN = 16
#: Whole numbers up to here are exact as double.
EXACT = float(1 << 53)

_LISTS = "block long, shard long, query_id long, vec_id long, score long"


def quantise(vectors, row_id="vec_id", vector="embedding", scale=SCALE):
    """``vec_id`` and ``codes`` (array of double), each floor(scale * x) as double.

    Rows whose vector is null or holds a null or non-finite component are left
    out, and so are rows without an id.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    # The whole part is kept as double: it may be beyond the range of long.
    whole = F.transform(x, lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0))
    return vectors.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(row_id).cast("long").alias("vec_id"), whole.alias("codes")
    )


def _stack(rows, size, number):
    """Rows stacked in tables of about ``size`` rows of one width.

    One record per table: dim, ``number`` (unique), ids and values as binary,
    values as 16-bit integers where they fit.
    """

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def close(dim):
            ids, values = (np.concatenate(part) for part in zip(*held.pop(dim)))
            if not values.size or np.abs(values).max() < 32768:
                values = values.astype(np.int16)
            return pa.record_batch(
                {
                    "dim": pa.array([dim], pa.int32()), number: pa.array([base + made], pa.int64()),
                    "ids": pa.array([ids.tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary()),
                    "kind": pa.array([values.dtype.str], pa.string()),
                }
            )

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids = part["vec_id"].to_numpy()
                widths = part["codes"].value_lengths().to_numpy()
                flat = part["codes"].flatten().to_numpy(zero_copy_only=False)
                firsts = np.cumsum(widths) - widths
                for dim in np.unique(widths).tolist():
                    chosen = widths == dim
                    places = firsts[chosen][:, None] + np.arange(dim)
                    held.setdefault(dim, []).append((ids[chosen], flat[places]))
                    if sum(len(i) for i, _ in held[dim]) >= size:
                        yield close(dim)
                        made += 1
        for dim in list(held):
            yield close(dim)
            made += 1

    return rows.mapInArrow(run, f"dim int, {number} long, ids binary, values binary, kind string")


def _matrix(values, kind, ids):
    return np.frombuffer(values, kind).astype(np.float64).reshape(len(ids), -1)


def products(queries, candidates):
    """Exact inner products of whole-numbered rows; object numbers where double is too short."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)))
    bound = np.abs(queries).max() * np.abs(candidates).max() * queries.shape[1]
    if bound < EXACT:
        return queries @ candidates.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries).dot(whole(candidates).T)


def best_of(scores, ids, k):
    """Columns of the ``k`` best of each row: highest score, then smallest id, in order."""
    found = []
    for row in scores:
        places = np.arange(len(row))
        if len(row) > k and row.dtype != object:
            # Everything down to the k-th score stays, so that ties are settled by id.
            places = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        order = sorted(places.tolist(), key=lambda p: (-row[p], ids[p]))
        found.append(order[:k])
    return found


def _tiles(k):
    """Best lists of each (query block, shard) tile."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids = np.frombuffer(row["q_ids"], np.int64)
                ids = np.frombuffer(row["ids"], np.int64)
                queries = _matrix(row["q_values"], row["q_kind"], query_ids)
                values = _matrix(row["values"], row["kind"], ids)
                scores = products(queries, values)
                own = query_ids[:, None] == ids[None, :]
                out = []
                for number, query_id in enumerate(query_ids.tolist()):
                    others = np.flatnonzero(~own[number])
                    kept = best_of(scores[number, others][None, :], ids[others], k)[0]
                    out += [
                        (row["block"], row["shard"], query_id, int(ids[others[p]]), _as_long(scores[number, others[p]]))
                        for p in kept
                    ]
                yield _records(out)

    return run


def _as_long(score):
    """A score as long; beyond its range the end of it."""
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _records(rows):
    names = ["block", "shard", "query_id", "vec_id", "score"]
    columns = list(zip(*rows)) or [[]] * 5
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


def search(vectors, is_query, k=K, scale=SCALE, shard_rows=SHARD_ROWS, block_rows=BLOCK_ROWS, fan_in=FAN_IN):
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the k best of each query.

    ``is_query`` is a condition on ``vec_id``. A query's candidates are all
    other ids of vectors as long as its own; a repeated row is a candidate of
    its own, and rows of one query id give one list. Ties go to the smaller
    id. A query without candidates, and an empty table, give no rows. Scores
    are whole and exact within the range of long; beyond it they are its ends, which
    tie. Other columns are not read.
    """
    rows = quantise(vectors, scale=scale)
    shards = _stack(rows, shard_rows, "shard")
    asked = rows.where(is_query).dropDuplicates(["vec_id"])
    blocks = _stack(asked, block_rows, "block").withColumnsRenamed({"ids": "q_ids", "values": "q_values", "kind": "q_kind"})
    # Every block meets every shard of its width, dealt over a rectangle of cells: a shard goes to
    # the few cells of a row, a block to those of a column, and each pair meets in one cell.
    down, across = _cells(vectors.sparkSession)
    shards = shards.withColumn("down", F.pmod(F.hash("shard"), F.lit(down))).withColumn("across", _each(across))
    blocks = blocks.withColumn("across", F.pmod(F.hash("block"), F.lit(across))).withColumn("down", _each(down))
    tiles = shards.join(blocks, ["dim", "down", "across"]).mapInArrow(_tiles(k), _LISTS)
    lists = _merge(tiles, k, F.pmod(F.xxhash64("shard"), F.lit(fan_in)))
    merged = _merge(lists, k, F.lit(0).cast("long"))
    place = F.row_number().over(_ranked())
    return merged.select("query_id", place.alias("rank"), "vec_id", "score")


def _cells(spark):
    """Height and width of the rectangle: about one cell per shuffle partition.

    Candidates outnumber queries by CANDIDATES_PER_QUERY, so a shard has that many times
    fewer copies than a block.
    """
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, round(math.sqrt(cells / CANDIDATES_PER_QUERY)))
    return max(1, math.ceil(cells / across)), across


def _each(count):
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def _ranked(*keys):
    return Window.partitionBy("query_id", *keys).orderBy(F.col("score").desc(), "vec_id")


def _merge(lists, k, group):
    """Lists whose shard has the same ``group`` become one list per query."""
    joined = lists.withColumn("shard", group)
    return joined.withColumn("place", F.row_number().over(_ranked("shard"))).where(F.col("place") <= k).drop("place")
