"""Merkle manifest of a dataset: one tree of digests per source, one tree over the sources.

A leaf is the digest of a row. While a tree has several nodes, every three
consecutive ones become the digest of their digests. Trees are cut into aligned
blocks of 3 ** LEVELS leaves; the roots of the blocks are the leaves of the
next blocks, so each step is spread over tasks whatever one source holds.

Within a block the tree is persistent: a changed leaf makes a new version that
copies its ancestors and shares every other node. The version goes on above its
block in the same way, with the digests of the nodes it shares there. These are
the same for all leaves of a block and travel once per block, not per version.
"""

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.ordering import attach, rank_in_groups
from .common import cut_lineage, groups_in_order, slices, temporary_tables

FAN = 3
#: Levels of a block; a task holds blocks of FAN ** LEVELS leaves.
LEVELS = 6

_STEPS = "array<struct<before: string, after: string>>"


def digest(*parts):
    """Lowercase hex SHA-256 of the parts in a row."""
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


class PersistentTree:
    """Versions of a tree of digests; nodes are only ever added, and versions share them.

    A version is the number of its root node. ``levels`` may be more than the leaves
    need: a node without neighbours still gets a parent.
    """

    def __init__(self, leaves, levels, fan=FAN):
        self.fan, self.levels = fan, levels
        self.digests = list(leaves)
        self.children = [()] * len(self.digests)
        row = range(len(self.digests))
        for _ in range(levels):
            row = [self._node(tuple(row[k : k + fan])) for k in range(0, len(row), fan)]
        (self.base,) = row

    def _node(self, children):
        self.children.append(children)
        self.digests.append(digest(*(self.digests[child] for child in children)))
        return len(self.digests) - 1

    def _descent(self, version, place):
        """(node, which child) from the root down to the parent of the leaf at ``place``."""
        node, steps = version, []
        for level in range(self.levels - 1, -1, -1):
            which = place // self.fan**level % self.fan
            steps.append((node, which))
            node = self.children[node][which]
        return steps

    def update(self, version, place, leaf):
        """The version with another leaf: copies of its ancestors, all else shared.

        Returns the copies from the leaf's parent to the root.
        """
        self.children.append(())
        self.digests.append(leaf)
        node, copies = len(self.digests) - 1, []
        for old, which in reversed(self._descent(version, place)):
            shared = self.children[old]
            node = self._node((*shared[:which], node, *shared[which + 1 :]))
            copies.append(node)
        return copies

    def shared(self, version, place):
        """Digests of the neighbours on the way up: (joined before, joined after) per level."""
        found = []
        for node, which in reversed(self._descent(version, place)):
            own = [self.digests[child] for child in self.children[node]]
            found.append(("".join(own[:which]), "".join(own[which + 1 :])))
        return found


def levels_of(total, levels=LEVELS, fan=FAN):
    """Levels of a block in a tree of ``total`` nodes: none for a lone node, ``levels`` at most."""
    need, nodes = 0, total
    while nodes > 1 and need < levels:
        nodes, need = -(-nodes // fan), need + 1
    return need


def _field(column):
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs, tampered):
    """doc_id, source, ``leaf`` and ``other``: the digest with the text that ``tampered`` gives.

    ``tampered`` is a column; where it is null or the text itself, ``other`` equals ``leaf``.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(*columns, F.coalesce(tampered, F.col("text")).alias("changed"))
    head = [_field(c) for c in columns[:-1]]
    leaf = F.sha2(F.concat(*head, _field("text")).cast("binary"), 256)
    other = F.sha2(F.concat(*head, _field("changed")).cast("binary"), 256)
    return rows.select("doc_id", "source", leaf.alias("leaf"), F.when(F.col("changed") == F.col("text"), leaf).otherwise(other).alias("other"))


def without_line_feeds():
    """The text without line feeds where 2 divides the crc32 of the decimal id, else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def _packed(nodes, extra, levels):
    """Nodes (tree, place, total, leaf, extra columns) as one row per aligned block.

    Blocks hold their columns as arrays in order of place, and ``root``.
    """
    size = FAN**levels
    kinds = dict(nodes.select(*extra).dtypes)

    def run(batches):
        for table in groups_in_order(batches, ["tree", "block"]):
            held = table["leaf"].to_pylist()
            total = table["total"][0].as_py()
            base = PersistentTree(held, levels_of(total, levels))
            row = {
                "tree": table["tree"].combine_chunks().slice(0, 1), "block": table["block"].combine_chunks().slice(0, 1),
                "total": pa.array([total], pa.int64()), "leaf": pa.array([held], pa.list_(pa.string())),
                "root": pa.array([base.digests[base.base]]),
            }
            for name in extra:
                own = table[name].combine_chunks()
                row[name] = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            yield pa.record_batch(row)

    dealt = (
        nodes.withColumn("block", F.floor(F.col("place") / size).cast("long"))
        .repartition("tree", "block")
        .sortWithinPartitions("tree", "block", "place")
    )
    schema = "tree string, block long, total long, leaf array<string>, root string"
    return dealt.mapInArrow(run, schema + "".join(f", {c} array<{kinds[c]}>" for c in extra))


def _forest(nodes, extra=(), levels=LEVELS):
    """Blocks of every height, lowest first, as tables of the shared folder."""
    heights = [cut_lineage(_packed(nodes, list(extra), levels))]
    while not heights[-1].where(F.col("total") > FAN**levels).isEmpty():
        above = heights[-1].where(F.col("total") > FAN**levels).select(
            "tree", F.col("block").alias("place"),
            F.ceil(F.col("total") / FAN**levels).cast("long").alias("total"), F.col("root").alias("leaf"),
        )
        heights.append(cut_lineage(_packed(above, [], levels)))
    return heights


def _roots(heights, levels):
    """tree, root: the last node of each tree."""
    size = FAN**levels
    found = [blocks.where(F.col("total") <= size).select("tree", "root") for blocks in heights]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def _children_steps(blocks, levels):
    """tree, place, steps of every leaf of blocks that have ``above`` (steps above the block)."""
    size = FAN**levels

    def run(batches):
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for row in _rows(batches):
            base = PersistentTree(row["leaf"], levels_of(row["total"], levels))
            above = [(step["before"], step["after"]) for step in row["above"]]
            count = len(row["leaf"])
            steps = [[{"before": a, "after": b} for a, b in base.shared(base.base, k) + above] for k in range(count)]
            places = [row["block"] * size + k for k in range(count)]
            yield pa.record_batch(
                [pa.array([row["tree"]] * count, pa.string()), pa.array(places, pa.int64()), pa.array(steps, kind)],
                names=["tree", "place", "steps"],
            )

    return blocks.select("tree", "block", "total", "leaf", "above").mapInArrow(run, f"tree string, place long, steps {_STEPS}")


def _lowest_with_above(heights, tops, levels):
    """The lowest blocks with ``above`` and what else ``tops`` holds per tree.

    ``tops``: tree, steps (above the whole tree), other columns.
    """
    size = FAN**levels
    steps = None
    for blocks in reversed(heights):
        lone = attach(blocks.where(F.col("total") <= size), tops, ["tree"], "inner").withColumnRenamed("steps", "above")
        if steps is not None:
            under = attach(
                blocks.where(F.col("total") > size), steps.withColumnRenamed("place", "block"), ["tree", "block"], "inner"
            ).withColumnRenamed("steps", "above")
            lone = lone.unionByName(attach(under, tops.drop("steps"), ["tree"], "inner"))
        if blocks is not heights[0]:
            steps = _children_steps(lone, levels)
    return lone


def build(docs, tampered=None, levels=LEVELS):
    """One row per document with its place in the manifest and the version its tampered leaf makes.

    doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, and ``copies``:
    the digests of the nodes the version copied, from the leaf's parent to the root.

    Rows of one source are ordered by ``doc_id`` (null first), repeated ids by leaf; equal
    rows are leaves of their own. A null source is a tree of its own and comes first. A null
    field counts as ``-``; a null text stays null when tampered with, and a null id is not
    tampered with. An empty table gives no rows. Other columns are not read.
    """
    with temporary_tables() as owner:
        return owner.keep(_build(docs, tampered, levels))


def _build(docs, tampered, levels):
    rows = cut_lineage(leaves(docs, without_line_feeds() if tampered is None else tampered))
    apart = rows.withColumn("spread", F.monotonically_increasing_id())
    ranked = rank_in_groups(apart, ["source"], ["doc_id", "leaf", "spread"], rank="place", total="total").select(
        F.col("source").alias("tree"), (F.col("place") - 1).alias("place"), "total", "leaf", "doc_id",
        F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("other"),
    )
    heights = _forest(ranked, ["doc_id", "other"], levels)
    subroots = cut_lineage(_roots(heights, levels))
    by_source = rank_in_groups(subroots.withColumn("one", F.lit("all")), ["one"], ["tree"], rank="place", total="total")
    by_source = cut_lineage(by_source.withColumn("place", F.col("place") - 1))
    top = _forest(by_source.select(F.col("one").alias("tree"), "place", "total", F.col("root").alias("leaf")), (), levels)
    whole = _roots(top, levels).withColumn("steps", F.array().cast(_STEPS))
    blocks = _lowest_with_above(top, whole.select("tree", "steps"), levels)
    steps = _children_steps(blocks, levels)
    sources = by_source.select(F.col("tree").alias("source"), F.col("root").alias("subroot"), "one", "place").join(
        steps.select("place", "steps"), "place"
    )
    sources = cut_lineage(sources.join(whole.select(F.col("tree").alias("one"), "root"), "one").select(
        F.col("source").alias("tree"), "steps", "subroot", F.col("root").alias("whole")
    ))
    lowest = _lowest_with_above(heights, sources, levels)
    return _versions(lowest, levels)


def _rows(batches):
    """Rows as dicts, one block at a time."""
    return (row for batch in batches for one in slices(batch, 1) for row in one.to_pylist())


_OUT = {
    "doc_id": "long", "source": "string", "leaf": "string", "subroot": "string", "root": "string",
    "proof_sha256": "string", "folded_root": "string", "verified": "boolean", "copies": "array<string>",
}


def _versions(blocks, levels):
    """The version of every leaf of blocks that have ``above``, subroot and root."""

    def run(batches):
        types = [pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.list_(pa.string())]
        for row in _rows(batches):
            tree = PersistentTree(row["leaf"], levels_of(row["total"], levels))
            above = [(step["before"], step["after"]) for step in row["above"]]
            out = []
            for place, (doc_id, leaf, other) in enumerate(zip(row["doc_id"], row["leaf"], row["other"])):
                proof = digest(*(part for step in tree.shared(tree.base, place) + above for part in step))
                copies = [tree.digests[node] for node in tree.update(tree.base, place, other or leaf)]
                top = copies[-1] if copies else other or leaf
                for before, after in above:
                    top = digest(before, top, after)
                    copies.append(top)
                out.append((doc_id, row["tree"], leaf, row["subroot"], row["whole"], proof, top, top == row["whole"], copies))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(_OUT))

    read = blocks.select("tree", "total", "leaf", "doc_id", "other", "above", "subroot", "whole")
    return read.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _OUT.items()))
