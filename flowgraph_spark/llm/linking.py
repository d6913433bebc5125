"""Groups of similar items from shared keys, without all pairs of a group.

Items that share a key may be similar; a function tells whether they are. Only
connected components are asked for, so links inside a component that is known
already need no test. Hence each key first tests its items against one of
them, its leader, which is linear in the rows; components that these links
make mostly leave one component per key. What stays open is settled exactly:
every pair of different components under a key is compared, block against block,
in the task that holds both blocks. Only pairs that join components leave it, fewer
than there are rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import bounded, cut_lineage, forget
from .components import connect

#: Rows of one key that meet in one block of the exact step.
BLOCK_ROWS = 2048
#: Rows of one key that are simply paired with each other.
FEW_ROWS = 8

_ROWS = "key long, id long, size int"
_ROW = ["key", "id", "size", "reach"]


def shared_rows(entries, needs_index=False, carry_reach=False):
    """Rows of ``entries`` (key, id, size[, reach][, indexed]) whose key has two or more items.

    With ``needs_index`` one of the rows of a key has to be ``indexed``. Rows of
    one key stand together after a shuffle by key and are read as a stream, of
    which the rows of the last undecided key are held, each different one once.
    """
    kept = ["key", "id", "size", *(["reach"] if carry_reach else [])]
    columns = [*kept, *(["indexed"] if needs_index else [])]
    # In this order the ids of a key show whether there are two, and an indexed row comes first.
    order = ["key", F.col("indexed").desc(), "id"] if needs_index else ["key", "id"]
    dealt = entries.select(columns).repartition("key").sortWithinPartitions(*order)

    def run(batches):
        held, open_key, wanted = None, None, False
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
                held = None
            keys = batch["key"].to_numpy()
            if not len(keys):
                continue
            ids = batch["id"].to_numpy()
            first = np.r_[True, keys[1:] != keys[:-1]]
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            several = np.zeros(len(starts), bool)
            several[group[1:][(~first[1:]) & (ids[1:] != ids[:-1])]] = True
            if needs_index:
                indexed = batch["indexed"].to_numpy(zero_copy_only=False)[starts]
                several &= indexed
            if open_key is not None and keys[0] == open_key:
                several[0] = wanted
            last = len(starts) - 1
            keep = several[group]
            if not several[last] and not (open_key == keys[-1] and last == 0):
                # The last key may go on in the next batch.
                if not needs_index or indexed[last]:
                    # All of one id, so few differ; the indexed one comes first.
                    held = _different(batch.slice(starts[last]), columns)
                    open_key, wanted = None, False
                else:
                    open_key, wanted = keys[-1], False
            else:
                open_key, wanted = keys[-1], bool(several[last])
            if keep.any():
                yield batch.filter(pa.array(keep)).select(kept)

    return dealt.mapInArrow(run, _ROWS + (", reach long" if carry_reach else ""))


def _different(batch, names):
    """The different rows of a batch, in order of their first occurrence."""
    rows = list(zip(*(batch[name].to_pylist() for name in names)))
    first = {}
    for place, row in enumerate(rows):
        first.setdefault(row, place)
    return batch.take(pa.array(list(first.values()), pa.int64()))


def with_components(rows, components):
    if components is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(bounded(components), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _starred(rows, admissible):
    """Different rows of every key but its leader, with ``lead``, the leader's id, and ``test``: may the two link.

    The leader is the item that can share most of itself, since copies of one item
    differ less from it than from each other. Rows of a key stand together after a
    shuffle by key, the leader first, and are read as a stream.
    """
    columns = ["key", "id", "size", "reach", "component"]
    dealt = rows.select(*columns).repartition("key").sortWithinPartitions(
        "key", 1 - F.col("reach") / F.col("size"), F.xxhash64("id"), "id", "size", "reach"
    )

    def run(batches):
        last, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {name: batch[name].to_numpy().astype(np.int64) for name in columns}
            # A line or document that lists a key several times is one row of it.
            again = np.ones(batch.num_rows, bool)
            for name in ("key", "id", "size", "reach"):
                again[1:] &= own[name][1:] == own[name][:-1]
                again[0] &= before is not None and own[name][0] == before[name]
            before = {name: values[-1] for name, values in own.items()}
            own = {name: values[~again] for name, values in own.items()}
            if not len(own["key"]):
                continue
            if last is not None:
                own = {name: np.r_[last[name], values] for name, values in own.items()}
            first = np.r_[True, own["key"][1:] != own["key"][:-1]]
            place = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            last = {name: values[place[-1]] for name, values in own.items()}
            lead = {name: values[place] for name, values in own.items()}
            test = admissible(own["size"], own["reach"], lead["size"], lead["reach"]) & (own["component"] != lead["component"])
            follows = np.flatnonzero((own["id"] != lead["id"]))
            yield pa.record_batch(
                {
                    "key": pa.array(own["key"][follows]), "id": pa.array(own["id"][follows]),
                    "size": pa.array(own["size"][follows], pa.int32()), "reach": pa.array(own["reach"][follows]),
                    "lead": pa.array(lead["id"][follows]), "test": pa.array(test[follows]),
                }
            )

    return dealt.mapInArrow(run, "key long, id long, size int, reach long, lead long, test boolean")


def _few_pairs(rows, open_keys, admissible):
    """All admissible pairs of different components under keys of a few rows."""
    chosen = rows.join(open_keys.where(F.col("rows") <= FEW_ROWS).select("key"), "key", "left_semi")
    names = ["id", "size", "reach", "component"]
    one = chosen.select("key", *[F.col(c).alias(f"{c}_a") for c in names])
    other = chosen.select("key", *[F.col(c).alias(f"{c}_b") for c in names])
    met = one.join(other, "key").where("id_a < id_b AND component_a <> component_b")
    fits = met.where(admissible(F.col("size_a"), F.col("reach_a"), F.col("size_b"), F.col("reach_b")))
    return fits.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _open_keys(rows):
    """Keys with more than one component, and their rows."""
    return (
        rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("components"),
        )
        .where("components > 1").select("key", "rows")
    )


def _cross_pairs(rows, open_keys, payload, admissible, compare, spanning, block_rows=BLOCK_ROWS):
    """Pairs (a, b) of different components under a key that ``compare`` lets pass.

    Rows meet block against block with their ``payload`` (id, size, payload). With ``spanning`` a pair that passes joins two components in its cell, whose
    other pairs are left out then: a cell gives out fewer pairs than it has rows.
    """
    blocks = F.ceil(F.col("rows") / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = (
        rows.join(bounded(open_keys.select("key", blocks.alias("blocks"))), "key")
        .join(payload, ["id", "size"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .select("key", "low", "high", "id", "size", "reach", "component", "own", "payload")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "component", "id")
    )
    names = ("key", "low", "high", "id", "size", "reach", "component", "own")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            batch = table.to_batches()[0]
            rows = {name: batch[name].to_numpy().astype(np.int64) for name in names}
            new = np.zeros(batch.num_rows, bool)
            for name in ("key", "low", "high"):
                new[1:] |= rows[name][1:] != rows[name][:-1]
            starts = np.flatnonzero(np.r_[True, new[1:]])
            # The last cell may go on in the next batch.
            held = batch.slice(starts[-1])
            yield from pairs(batch.slice(0, starts[-1]), starts)
        if held is not None:
            yield from pairs(held, np.array([0, held.num_rows]))

    def pairs(batch, starts):
        """Pairs of all cells at once: every row with the next of its cell, the one after it, and so on."""
        rows = {name: batch[name].to_numpy().astype(np.int64) for name in names}
        ready = compare.prepare(batch["payload"])
        # Components are joined within a cell, so they are numbered by cell.
        cell = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        _, own = np.unique(np.stack([cell, rows["component"]]), axis=1, return_inverse=True)
        own = own.ravel()
        end = np.repeat(starts[1:], np.diff(starts))
        first, step, found = np.arange(len(cell)), 0, []
        while True:
            step += 1
            first = first[first + step < end[first]]
            if not len(first):
                break
            second = first + step
            fits = own[first] != own[second]
            fits &= (rows["low"][first] == rows["high"][first]) | (rows["own"][first] != rows["own"][second])
            fits &= rows["id"][first] != rows["id"][second]
            if not fits.any():
                continue
            left, right = first[fits], second[fits]
            near = admissible(rows["size"][left], rows["reach"][left], rows["size"][right], rows["reach"][right])
            left, right = left[near], right[near]
            near = compare.passes(ready, rows["size"], left, right)
            left, right = left[near], right[near]
            if spanning and len(left):
                kept, own = _join(own, left, right)
                left, right = left[kept], right[kept]
            found.append((rows["id"][left], rows["id"][right]))
        if found:
            # Copies share many keys, so each pair goes out once per batch.
            a, b = (np.concatenate(side) for side in zip(*found))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.record_batch({"a": pa.array(both[0]), "b": pa.array(both[1])})

    return cells.mapInArrow(run, "a long, b long").distinct()


def _join(own, left, right):
    """Which of the pairs (left, right) join two components, and the components after it."""
    parent = {}

    def root(one):
        while parent.get(one, one) != one:
            parent[one] = one = parent.get(parent[one], parent[one])
        return one

    kept = []
    for a, b in zip(own[left].tolist(), own[right].tolist()):
        a, b = root(a), root(b)
        kept.append(a != b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    names = np.arange(own.max() + 1)
    for one in list(parent):
        names[one] = root(one)
    return np.array(kept, bool), names[own]


def link(rows, admissible, payload, compare, verify, sift=None, extra_links=None):
    """``id`` and ``component`` of every item that is linked, smallest id of its component.

    ``rows`` (key, id, size, reach) is read several times, so it should be a
    table; ``reach`` is what ``admissible`` bounds the overlap by, or what else
    it compares.
    ``admissible(n, r, m, s)`` says for two sizes and reaches, as columns or
    arrays, whether a link is possible. ``payload`` (id, size, payload) is what ``compare``
    looks at: ``prepare`` takes a column of it, ``passes`` tells for places of two sides
    which pairs may link. ``verify(pairs)`` gives the links (a, b) among ``pairs``, after
    ``sift(pairs)`` has refused what surely is none. Pairs with leaders go that way.
    Without ``sift`` a pair that passes ``compare`` is a link; with it the exact step
    first tests pairs that would join components, then all pairs that are left.
    ``extra_links`` are taken as given.
    """
    links = cut_lineage(extra_links) if extra_links is not None else None
    components = cut_lineage(connect(links)) if links is not None and not links.isEmpty() else None
    starred = cut_lineage(_starred(with_components(rows, components), admissible))
    tested = None
    for step in ["star", "cross"] if sift is None else ["star", "spanning", "cross"]:
        # Pairs with leaders are settled in the first step, so most keys, of two items, are.
        if step == "star":
            pairs = starred.where("test").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
            certain, placed, open_keys = None, None, None
        else:
            placed = cut_lineage(with_components(starred.select(*_ROW), components))
            open_keys = cut_lineage(_open_keys(placed))
            if open_keys.isEmpty():
                break
            many = open_keys.where(F.col("rows") > FEW_ROWS)
            crossed = _cross_pairs(placed, many, payload, admissible, compare, step == "spanning" or sift is None)
            # Few rows under a key are paired as they are; their payload moves once per pair.
            few = _few_pairs(placed, open_keys, admissible) if step != "cross" or sift is None else None
            certain = crossed if sift is None else None
            pairs = few if sift is None else crossed if few is None else few.union(crossed).distinct()
        if sift is None:
            new = verify(pairs) if certain is None else verify(pairs).union(certain)
            new = cut_lineage(new.select("a", "b").distinct())
        else:
            sifted = cut_lineage(sift(pairs))
            if tested is not None:
                sifted = cut_lineage(sifted.join(tested, ["a", "b"], "left_anti"))
            new = cut_lineage(verify(sifted))
            tested = sifted if tested is None else cut_lineage(tested.union(sifted))
        if not new.isEmpty():
            links = cut_lineage(links.union(new)) if links is not None else new
            components = cut_lineage(connect(links))
        forget(open_keys, placed)
    forget(starred)
    return components
