"""N-gram Jaccard join: documents that share enough five-word shingles.

The search is a T-occurrence problem: a document's partners occur in at least
T of the inverted lists of its shingles. As in DivideSkip the lists are divided.
The T - 1 longest can hold a partner together without reaching T, so it also
occurs in one of the others; these short lists, of the rarest shingles of a
document, are merged in Spark by a shuffle on the shingle. Candidates are then
verified by DivideSkip proper over the documents that came together in a task:
short lists merged with a heap, long ones probed by binary search.
"""

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, bounded, cut_lineage, forget, groups_in_order, slices, temporary_tables, texts_of
from .linking import link, shared_rows

WORDS = 5
#: A link needs PERCENT of the union in common.
PERCENT = 75
#: A shingle found this often, where it recurs within a chunk of CHUNK_SHINGLES, is frequent.
FREQUENT = 32
CHUNK_SHINGLES = 1 << 21
#: Bits of the table of frequent shingles, and of the filter for documents to be verified.
TABLE_BITS = 1 << 23
#: Bits of a parity sketch; blocks are compared by the least number.
LEAST_BITS, MOST_BITS = 2048, 8192
#: Partners of a document whose inverted lists are searched at once.
BLOCK_MEMBERS = 128
#: Weight of a probe against a step of the heap; it sets how many lists count as long.
PROBE_WEIGHT = 0.02

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text):
    """Sorted distinct 64-bit hashes of the word shingles of a text, as int64."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z, only \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def overlap_needed(n, m, percent=PERCENT):
    """Least intersection of two sets that makes them link."""
    return -(-percent * (n + m) // (100 + percent))


def admissible(n, r, m, s):
    """Can sets of sizes ``n`` and ``m`` and of reaches ``r`` and ``s`` link.

    A shingle of the smaller set's short lists can lie behind the end of the
    larger one's. What is behind is at most the larger set less its short
    lists, so the overlap is at most the reach of the larger set, and the reach
    of the smaller one plus the difference of what both have behind.
    """
    need = PERCENT * (n + m)
    behind_n, behind_m = ((k - k % 100) / 100 for k in (PERCENT * n + 99, PERCENT * m + 99))
    more = (100 + PERCENT) * (behind_m - behind_n)
    r, s = (100 + PERCENT) * r, (100 + PERCENT) * s
    return ((r >= need) | (r + more >= need)) & ((s >= need) | (s - more >= need))


def short_lists(shingle_set, frequent):
    """The rarest shingles of a set, as many as every partner must share one of.

    Frequent ones come last; the order is the same for all documents.
    """
    often = bitmap_has(frequent, shingle_set)
    count = len(shingle_set) - -(-PERCENT * len(shingle_set) // 100) + 1
    ordered = np.concatenate([shingle_set[~often], shingle_set[often]])[:count]
    return ordered, max(0, count - int((~often).sum()))


def frequent_shingles(docs):
    """Bitmap of frequent shingles, counted over all documents.

    Within chunks of CHUNK_SHINGLES only repeated shingles are reported, so
    what is shuffled stays small; a shingle that many documents share recurs in
    a chunk. The bitmap only sets an order, so it cannot change the links.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for text in texts_of(part["text"]):
                    held.append(shingles(text))
                    size += len(held[-1])
                if size >= CHUNK_SHINGLES:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(sets):
        found = np.sort(np.concatenate(sets))
        starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(found)])
        often = counts > 1
        return pa.record_batch({"shingle": pa.array(found[starts[often]]), "n": pa.array(counts[often])})

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return bitmap_of(counted.where(F.col("n") >= FREQUENT), "shingle", TABLE_BITS)


def describe(docs, frequent):
    """doc_id, n_shingles, digest of the set, its short lists, how many of them are frequent, and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sizes, digests, lists, often, sketches = [], [], [], [], []
                for text in texts_of(part["text"]):
                    found = shingles(text)
                    sizes.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    rare, late = short_lists(found, shared.value) if len(found) else (found, 0)
                    lists.append(rare)
                    often.append(late)
                    sketches.append(sketch(found))
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        part["doc_id"], pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))),
                        pa.array(often, pa.int32()), pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "size", "digest", "rare", "late", "sketch"],
                )

    schema = "doc_id long, size int, digest binary, rare array<bigint>, late int, sketch binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def merge_skip(lists, need):
    """Numbers that occur in ``need`` or more of the sorted lists, with their counts.

    A heap holds the head of each list; where the smallest number is in too few
    lists, the need - 1 smallest heads skip to the next possible number.
    """
    heap = [(one[0], k) for k, one in enumerate(lists) if one]
    heapq.heapify(heap)
    places = [0] * len(lists)
    while len(heap) >= need:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= need:
            yield top, len(taken)
            target = top + 1
        else:
            while len(taken) < need - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for k in taken:
            places[k] = bisect_left(lists[k], target, places[k])
            if places[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][places[k]], k))


def divide_skip(query, members):
    """Numbers of the ``members`` (sorted arrays) that link with the ``query``."""
    sizes = [len(m) for m in members]
    needs = [overlap_needed(len(query), size) for size in sizes]
    least = min(needs)
    owners = np.repeat(np.arange(len(members)), sizes)
    found = np.concatenate(members)
    order = np.argsort(found, kind="stable")
    found, owners = found[order], owners[order]
    low, high = np.searchsorted(found, query, "left"), np.searchsorted(found, query, "right")
    lengths = high - low
    longest = max(1, int(lengths.max(initial=1)))
    long_count = min(least - 1, int(least / (PROBE_WEIGHT * math.log2(longest) + 1)))
    by_length = np.argsort(-lengths, kind="stable")
    lists = [owners[low[k] : high[k]].tolist() for k in by_length]
    long_lists, rest = lists[:long_count], lists[long_count:]
    linked = []
    for member, count in merge_skip(rest, max(1, least - long_count)):
        need = needs[member]
        for left, one in zip(range(long_count, 0, -1), long_lists):
            if count >= need or count + left < need:
                break
            place = bisect_left(one, member)
            count += place < len(one) and one[place] == member
        if count >= need:
            linked.append(member)
    return linked


def sketch_bits(size):
    """Bits of the sketch of a set: a power of two that follows its size."""
    return min(max(1 << (4 * size - 1).bit_length(), LEAST_BITS), MOST_BITS) if size else LEAST_BITS


def sketch(shingle_set):
    """Parity sketch: every shingle flips one bit. Two sets differ in at least as many
    shingles as their sketches do in bits, so a pair refused by sketches cannot link."""
    bits = sketch_bits(len(shingle_set))
    flips = np.bincount(shingle_set & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(data, bits):
    """A sketch with fewer bits: that of the same set, as halves are added without carry."""
    found = np.frombuffer(data, np.uint64)
    while len(found) * 64 > bits:
        half = len(found) // 2
        found = found[:half] ^ found[half:]
    return found


def difference_allowed(n, m, percent=PERCENT):
    """Shingles in one of two sets but not in both, at most, if they link."""
    return n + m + 2 * (-percent * (n + m) // (100 + percent))


def may_link(n, one, m, other):
    """Do the sketches of two sets leave room for a link."""
    bits = 8 * min(len(one), len(other))
    apart = int(np.bitwise_count(folded(one, bits) ^ folded(other, bits)).sum())
    return apart <= difference_allowed(n, m)


class Sketches:
    """Compares the sketches of a block, all folded to LEAST_BITS."""

    def prepare(self, column):
        found = [folded(data, LEAST_BITS) for data in column.to_pylist()]
        return np.stack(found) if found else np.zeros((0, LEAST_BITS // 64), np.uint64)

    def passes(self, sketches, sizes, left, right):
        apart = np.zeros(len(left), np.int64)
        for start in range(0, len(left), 1 << 16):
            part = slice(start, start + (1 << 16))
            apart[part] = np.bitwise_count(sketches[left[part]] ^ sketches[right[part]]).sum(axis=1)
        return apart <= difference_allowed(sizes[left], sizes[right])


def _shortened(batches):
    """Sketches folded to the bits that blocks are compared by."""
    for batch in batches:
        short = [folded(data, LEAST_BITS).tobytes() for data in batch["payload"].to_pylist()]
        yield pa.record_batch([batch["id"], batch["size"], pa.array(short, pa.binary())], names=["id", "size", "payload"])


def sifter(sketches):
    """A function that refuses pairs (a, b) by their sketches (id, size, payload)."""

    def compare(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                columns = [part[c].to_pylist() for c in ("n", "one", "m", "other")]
                yield part.filter(pa.array([may_link(*row) for row in zip(*columns)], pa.bool_())).select(["a", "b"])

    def sift(pairs):
        one = sketches.select(F.col("id").alias("a"), F.col("size").alias("n"), F.col("payload").alias("one"))
        other = sketches.select(F.col("id").alias("b"), F.col("size").alias("m"), F.col("payload").alias("other"))
        met = pairs.join(one, "a").join(other, "b").select("a", "b", "n", "one", "m", "other")
        return met.mapInArrow(compare, "a long, b long").distinct()

    return sift


def verifier(docs):
    """A function that gives the links among pairs (a, b) of doc ids.

    The partners of one document are cut into blocks. The document is sent once to each
    of its blocks, whose members' shingles are the inverted lists: DivideSkip merges the
    short ones, probes the long ones and retains the members that reach the overlap.
    """

    def known_sets(ids):
        wanted = bitmap_of(ids.select(F.xxhash64("id").alias("h")), "h", TABLE_BITS)
        shared = docs.sparkSession.sparkContext.broadcast(wanted)

        def sets(batches):
            for batch in batches:
                for part in slices(batch):
                    part = part.filter(pa.array(bitmap_has(shared.value, part["h"].to_numpy())))
                    found = [shingles(text).tobytes() for text in texts_of(part["text"])]
                    yield pa.record_batch([part["doc_id"], pa.array(found, pa.binary())], names=["id", "found"])

        rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
            "doc_id", "text", F.xxhash64("doc_id").alias("h")
        )
        return cut_lineage(rows.mapInArrow(sets, "id long, found binary"))

    def search(batches):
        for table in groups_in_order(batches, ["query", "block"]):
            roles, ids, found = (table[c].to_pylist() for c in ("member", "id", "found"))
            sets = [np.frombuffer(data, np.int64) for data in found]
            members = [k for k, role in enumerate(roles) if role and len(sets[k])]
            out = []
            for k, role in enumerate(roles):
                if not role and len(sets[k]) and members:
                    out += [(ids[k], ids[members[hit]]) for hit in divide_skip(sets[k], [sets[m] for m in members])]
            yield pa.record_batch(
                {"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())}
            )

    def verify(pairs):
        known = known_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        # The document with more partners is the query, so fewer sets are sent.
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        ends = cut_lineage(ends)
        counted = (
            pairs.join(ends.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a")
            .join(ends.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
        )
        first = F.col("n_a") >= F.col("n_b")
        asked = counted.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("query"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"),
            F.ceil(F.greatest("n_a", "n_b") / F.lit(BLOCK_MEMBERS)).cast("int").alias("blocks"),
        )
        asked = cut_lineage(asked.select("query", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")))
        members = asked.select("query", "block", F.lit(True).alias("member"), "id")
        queries = asked.select("query", "block").distinct().select("*", F.lit(False).alias("member"), F.col("query").alias("id"))
        sent = members.unionByName(queries).join(known, "id").select("query", "block", "member", "id", "found")
        dealt = sent.repartition("query", "block").sortWithinPartitions("query", "block", "member")
        links = cut_lineage(dealt.mapInArrow(search, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        forget(known, ends, asked)
        return links

    return verify


def with_reach(rows, rare, alone):
    """``rows`` with ``reach``: the shingles of a document less those it lists alone.

    These are of its rare short lists and in no other document's, but others
    can hold them behind theirs; :func:`admissible` allows for it. A doc_id with
    several sets keeps all, as its lists are not told apart.
    """
    found = rare.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    lists = alone.groupBy(F.col("doc_id").alias("id")).agg(
        F.count(F.lit(1)).alias("sets"), F.max(F.size("rare") - F.col("late")).alias("listed")
    )
    lost = lists.join(found, "id", "left").select(
        "id", F.when(F.col("sets") == 1, F.col("listed") - F.coalesce("shared", F.lit(0))).otherwise(0).alias("lost")
    )
    return rows.join(bounded(cut_lineage(lost)), "id").select("key", "id", "size", (F.col("size") - F.col("lost")).cast("int").alias("reach"))


def classes(docs):
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Two documents link when their shingle sets have PERCENT of their union in
    common; the component id is the smallest doc_id reachable by links. Equal
    sets are one class from the start and only its smallest doc_id is compared
    further. Null and word-less texts have no shingles and stay alone. Rows of
    one doc_id are one document: it links by any of its texts. A null doc_id
    has a null component and links with nothing. An empty table gives no rows.
    Other columns are not read.
    """
    with temporary_tables() as owner:
        return owner.keep(_classes(docs.select("doc_id", "text")))


def _classes(docs):
    described = cut_lineage(describe(docs, frequent_shingles(docs)))
    sets = described.where("size > 0 AND doc_id IS NOT NULL")
    first = cut_lineage(sets.groupBy("digest").agg(F.min("doc_id").alias("first")))
    members = described.select("doc_id", "size", "digest").join(first, "digest", "left")
    members = cut_lineage(members.select("doc_id", "size", "first"))
    alone = sets.join(first.withColumnRenamed("first", "doc_id"), ["digest", "doc_id"], "left_semi")
    listed = alone.select(
        F.col("doc_id").alias("id"), "size", F.posexplode("rare").alias("place", "key"),
        (F.size("rare") - F.col("late")).alias("rare_count"),
    )
    # Frequent shingles have many documents for sure; only the others are looked through for pairs.
    rare = cut_lineage(shared_rows(listed.where("place < rare_count")))
    late = listed.where("place >= rare_count").select("key", "id", "size")
    rows = cut_lineage(with_reach(rare.unionByName(late), rare, alone))
    forget(rare)
    # A doc_id with several texts belongs to several classes, which it links.
    several = (
        members.where("first IS NOT NULL").groupBy("doc_id")
        .agg(F.min("first").alias("a"), F.max("first").alias("z")).where("a <> z")
    )
    extra = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("first").alias("b")).where("a <> b")
    sketches = cut_lineage(alone.select(F.col("doc_id").alias("id"), "size", F.col("sketch").alias("payload")))
    forget(described)
    short = cut_lineage(sketches.mapInArrow(_shortened, "id long, size int, payload binary"))
    components = link(rows, admissible, short, Sketches(), verifier(docs), sifter(sketches), extra)
    forget(rows, sketches, short)
    result = members
    if components is not None:
        result = members.join(bounded(components).withColumnRenamed("id", "first"), "first", "left")
    else:
        result = members.withColumn("component", F.lit(None).cast("long"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    return result.select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs):
    """``docs`` with one document of each component, the one of smallest id; columns stay.

    Documents without words stay, and so do rows with a null doc_id. Of several
    rows of one doc_id that have words one stays.
    """
    found = classes(docs)
    worded = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    dropped = worded.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti")
    has_words = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = left.where(has_words).dropDuplicates(["doc_id"])
    return kept.unionByName(left.where(~has_words)).select(docs.columns)
