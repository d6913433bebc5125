"""Line deduplication across documents by a segment-partition edit join.

Lines within an edit distance of MAX_EDITS share at least one of MAX_EDITS + 1
segments unchanged, since each edit spoils one at most. Every line lists its
own segments by length, number and content, and probes those of lines of its
length or a little less at the few places where a shared segment can stand.
Lines that meet are compared by a bit-parallel automaton within the band of
the diagonal. Similar lines form classes, of which only the first occurrence
in the corpus stays.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, cut_lineage, forget, slices, texts_of
from .linking import link, shared_rows

MAX_EDITS = 2
#: Shorter lines, less white space at their ends, are neither compared nor removed.
MIN_CHARS = 20
#: Bits of the filter for lines to be verified.
TABLE_BITS = 1 << 23
#: Bins of the character counts by which lines are told apart before they are compared.
SIGNATURE_BINS = 7
#: Name beside the columns of the documents, which may have any others.
_REMOVED = "line_dedup_removed"


def line_id(line):
    """64-bit number of a line. Among 10^9 different lines two share one with odds of 1 in 37."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def lines_of(text, min_chars=MIN_CHARS):
    """Number and content, without white space at the ends, of the lines compared."""
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if len(line) >= min_chars:
            yield number, line


def segments(length, edits=MAX_EDITS):
    """Start and size of the edits + 1 segments of a line, as even as can be."""
    size, longer = divmod(length, edits + 1)
    found, start = [], 0
    for k in range(edits + 1):
        own = size + (k >= edits + 1 - longer)
        found.append((start, own))
        start += own
    return found


def probe_places(length, edits=MAX_EDITS):
    """(indexed length, segment, start, size) at which a line of ``length`` is probed.

    A segment of a line shorter by ``gap`` that is the first one unspoilt has
    at most k edits before it and edits - k after it, which bounds its shift
    from both ends. Own segments are among the places, with gap 0 and shift 0.
    """
    found = []
    for gap in range(edits + 1):
        if length - gap <= edits:
            break
        for k, (start, size) in enumerate(segments(length - gap, edits)):
            low = max(start - k, start + gap - (edits - k), 0)
            high = min(start + k, start + gap + (edits - k), length - size)
            found += [(length - gap, k, place, size) for place in range(low, high + 1)]
    return found


def within(a, b, edits=MAX_EDITS):
    """Is the edit distance of two strings at most ``edits``.

    One automaton row per number of edits, of 2 * edits + 1 bits: bit k stands
    for k - edits characters of ``a`` more than of ``b``.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    # What both begin with needs no automaton.
    same = 0
    step = 1 << (min(len(a), len(b)).bit_length())
    while step:
        if a[same : same + step] == b[same : same + step] and same + step <= min(len(a), len(b)):
            same += step
        else:
            step >>= 1
    a, b = a[same:], b[same:]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    places = {}
    for place, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << (place + edits)
    # Before any character of b: k - edits characters of a cost as many edits.
    rows = [sum(1 << (edits + k) for k in range(d + 1)) for d in range(edits + 1)]
    for place, char in enumerate(b):
        equal = places.get(char, 0) >> place & full
        before, fresh = 0, []
        for d, row in enumerate(rows):
            now = row & equal
            if d:
                now |= before | before >> 1 | fresh[-1] << 1
            fresh.append(now & full)
            before = row
        rows = fresh
        if not rows[-1]:
            return False
    end = len(a) - len(b) + edits
    return bool(rows[-1] >> end & 1)


def signature(codes):
    """Counts of the characters of a line in SIGNATURE_BINS bins, modulo 256, as one number."""
    counts = np.bincount(codes % SIGNATURE_BINS, minlength=SIGNATURE_BINS).astype(np.uint8)
    return int.from_bytes(counts.tobytes(), "little")


def _admissible(n, r, m, s):
    """Lengths within MAX_EDITS; of arrays the signatures too, as an edit moves two counts at most by one."""
    near = (n - m <= MAX_EDITS) & (m - n <= MAX_EDITS)
    if isinstance(near, Column):
        return near
    apart = np.zeros(len(near), np.int64)
    for k in range(SIGNATURE_BINS):
        # Counts are known modulo 256; the shorter way round never exceeds the true difference.
        gap = ((r >> (8 * k)) - (s >> (8 * k))) & 255
        apart += np.minimum(gap, 256 - gap)
    return near & (apart <= 2 * MAX_EDITS)


def probe_rows(docs, edits=MAX_EDITS, min_chars=MIN_CHARS):
    """Rows key, id, size, reach (the signature), indexed of all lines, once per part of a batch."""

    def run(batches):
        known = {}
        for batch in batches:
            for part in slices(batch):
                lines = {line for text in texts_of(part["text"]) for _, line in lines_of(text, min_chars)}
                keys, ids, sizes, marks, indexed = [], [], [], [], []
                for line in lines:
                    length, raw = len(line), line.encode("utf-32-le", "surrogatepass")
                    places = known.get(length)
                    if places is None:
                        own = {(length, k, start) for k, (start, _) in enumerate(segments(length, edits))}
                        places = known[length] = [
                            (4 * start, 4 * (start + size), (of << 8) + k, (of, k, start) in own)
                            for of, k, start, size in probe_places(length, edits)
                        ]
                    for low, high, seed, is_own in places:
                        keys.append(xxhash.xxh3_64_intdigest(raw[low:high], seed))
                        indexed.append(is_own)
                    ids.append(line_id(line))
                    sizes.append((length, len(places)))
                    marks.append(signature(np.frombuffer(raw, "<u4")))
                repeats = [n for _, n in sizes]
                yield pa.record_batch(
                    {
                        "key": pa.array(np.array(keys, np.uint64).view(np.int64)),
                        "id": pa.array(np.repeat(np.array(ids, np.int64), repeats)),
                        "size": pa.array(np.repeat(np.array([n for n, _ in sizes], np.int32), repeats)),
                        "reach": pa.array(np.repeat(np.array(marks, np.int64), repeats)),
                        "indexed": pa.array(np.array(indexed, bool)),
                    }
                )

    return docs.select("text").mapInArrow(run, "key long, id long, size int, reach long, indexed boolean")


def known_lines(docs, rows, min_chars=MIN_CHARS):
    """id, size and payload, the text, of the lines that share a key; few beside all lines."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(rows, "id", TABLE_BITS))

    def found(batches):
        for batch in batches:
            for part in slices(batch):
                lines = list({line for text in texts_of(part["text"]) for _, line in lines_of(text, min_chars)})
                numbers = np.array([line_id(line) for line in lines], np.int64)
                keep = bitmap_has(wanted.value, numbers) if lines else np.zeros(0, bool)
                kept = [x for x, k in zip(lines, keep) if k]
                sizes = pa.array([len(x) for x in kept], pa.int32())
                yield pa.record_batch([pa.array(numbers[keep]), sizes, pa.array(kept, pa.string())], names=["id", "size", "payload"])

    lines = docs.select("text").mapInArrow(found, "id long, size int, payload string")
    # One text per number; the copies of a line meet in partial sums first.
    return cut_lineage(lines.groupBy("id", "size").agg(F.first("payload").alias("payload")))


class Near:
    """Compares lines of a block: within ``edits`` of each other or not."""

    def __init__(self, edits=MAX_EDITS):
        self.edits = edits

    def prepare(self, column):
        return column.to_pylist()

    def passes(self, lines, sizes, left, right):
        return np.array([within(lines[a], lines[b], self.edits) for a, b in zip(left, right)], bool)


def verifier(lines, edits=MAX_EDITS):
    """A function that gives the pairs (a, b) of line ids within ``edits``."""
    texts = lines.select("id", "payload")

    def compare(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                near = [within(a, b, edits) for a, b in zip(part["line_a"].to_pylist(), part["line_b"].to_pylist())]
                yield part.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    def verify(pairs):
        return (
            pairs.join(texts.select(F.col("id").alias("a"), F.col("payload").alias("line_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("payload").alias("line_b")), "b")
            .select("a", "b", "line_a", "line_b").mapInArrow(compare, "a long, b long")
        )

    return verify


def occurrences(docs, min_chars=MIN_CHARS):
    """doc_id, number and id of every line compared."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [
                    (doc_id, number, line_id(line))
                    for doc_id, text in zip(part["doc_id"].to_pylist(), texts_of(part["text"]))
                    for number, line in lines_of(text, min_chars)
                ]
                columns = list(zip(*rows)) or [[], [], []]
                types = [pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "number", "id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, number int, id long")


def removals(docs, edits=MAX_EDITS, min_chars=MIN_CHARS):
    """doc_id and the numbers of the lines to remove, for documents that lose some."""
    probes = probe_rows(docs, edits, min_chars)
    rows = cut_lineage(shared_rows(probes, needs_index=True, carry_reach=True))
    lines = known_lines(docs, rows, min_chars)
    components = link(rows, _admissible, lines, Near(edits), verifier(lines, edits))
    forget(rows, lines)
    seen = cut_lineage(occurrences(docs, min_chars))
    # The first occurrence of each line, with the number of occurrences, and of each class.
    lines = seen.groupBy("id").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count(F.lit(1)).alias("n"))
    lines = cut_lineage(lines)
    if components is None:
        kept = lines.where("n > 1").select("id", "first")
    else:
        joined = cut_lineage(
            lines.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
            .where(F.col("component").isNotNull())
        )
        firsts = cut_lineage(joined.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("all")))
        kept = joined.join(firsts.where("all > 1"), "component").select("id", F.col("kept").alias("first"))
    kept = cut_lineage(kept)
    removed = seen.join(kept, "id").where(F.struct("doc_id", "number") != F.col("first"))
    # A document has as many numbers as lines at most.
    return removed.groupBy("doc_id").agg(F.collect_set("number").alias("removed"))


def remove_lines(docs, edits=MAX_EDITS, min_chars=MIN_CHARS, drop_empty=False, counted=False):
    """``docs`` without repeated lines; ``n_chars``, where there, follows the text.

    Lines are cut at line feeds and compared without white space at their
    ends; lines within ``edits`` of each other, directly or through others, are
    one class. Of a class only the occurrence of smallest doc_id and line
    number stays. Lines under ``min_chars`` stay. Rows of one doc_id lose the
    same lines and keep the first one, so exact copies of a row are left to
    document deduplication. Null texts and rows with a null doc_id stay as they
    are. ``drop_empty`` drops rows whose lines with a word all went; ``counted``
    adds ``n_removed``, in place of a column of that name.
    """
    decided = removals(docs, edits, min_chars)
    names = [name for name in docs.columns if not counted or name != "n_removed"]
    schema = docs.select(names).schema
    if counted:
        schema = schema.add("n_removed", "long")
    joined = docs.select(names).join(decided.withColumnRenamed("removed", _REMOVED), "doc_id", "left")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, keep = part["text"].to_pylist(), np.ones(part.num_rows, bool)
                sizes = part["n_chars"].to_pylist() if "n_chars" in names else None
                for k, gone in enumerate(part[_REMOVED].to_pylist()):
                    if gone is None or texts[k] is None:
                        continue
                    gone = set(gone)
                    left = [line for number, line in enumerate(texts[k].split("\n")) if number not in gone]
                    texts[k] = "\n".join(left)
                    if sizes is not None:
                        sizes[k] = len(texts[k])
                    keep[k] = not drop_empty or bool(texts[k].strip())
                columns = {name: part[name] for name in names}
                columns["text"] = pa.array(texts, part["text"].type)
                if sizes is not None:
                    columns["n_chars"] = pa.array(sizes, part["n_chars"].type)
                if counted:
                    columns["n_removed"] = pa.array([len(gone or ()) for gone in part[_REMOVED].to_pylist()], pa.int64())
                yield pa.record_batch(list(columns.values()), names=list(columns)).filter(pa.array(keep))

    return joined.select(*names, _REMOVED).mapInArrow(run, schema)


def summarise(docs, edits=MAX_EDITS, min_chars=MIN_CHARS):
    """doc_id, n_lines, n_removed, n_chars and text_sha256 of every document after removal."""

    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    lined = filled.withColumn("n_lines", F.when(F.length("text") > 0, breaks + 1).otherwise(0).cast("long"))
    return remove_lines(lined, edits, min_chars, counted=True).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )
