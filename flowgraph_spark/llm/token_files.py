"""Token ids of documents in binary files of fixed-width packed ids.

Documents lie in ascending order of ``doc_id`` (null first), each as the ids of
its text and an end id. An id takes the least number of bits that holds the
vocabulary. A file holds one range of documents:

======== =====================================================================
header   magic, bits per id, ids per block, number of the file
blocks   ``block_ids`` packed ids each (the last one fewer), most significant
         bit first, filled up with zero bits to a whole byte
index    counts of documents, blocks and ids; per document its id, whether that
         is null and its first id; per block its byte offset
trailer  byte offset of the index, magic
======== =====================================================================

Each part is followed by a byte 0x0A. So Spark's text writer can write the files
on whatever storage holds the folder, and its commit leaves out what lost or
repeated tasks wrote. Block offsets give any id by reading one block, and a whole
block is unpacked by numpy at once. ``manifest`` counts the ids before each file.
"""

import array
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut_lineage, table_folder

MAGIC = b"IDPACK01"
BLOCK_IDS = 1 << 16
#: Bytes of text that a file is planned for.
TEXT_BYTES_PER_FILE = 64 << 20
#: Distinct words and parts of words a worker keeps, and bytes of text it splits at once.
MEMO_WORDS = 500_000
BATCH_BYTES = 4 << 20

#: Latin letters whose lower case is one letter, and marks behind them: two pre-tokens.
_PLAIN = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?$%&*#]*)")

_HEADER = struct.Struct("<8sIIQ")
_COUNTS = struct.Struct("<QQQ")
_TRAILER = struct.Struct("<Q8sc")
_ENCODERS = {}


def bits_for(vocabulary):
    """Bits that hold every id below ``vocabulary``, at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, bits):
    """Ids (unsigned 32-bit) as packed bytes of ``bits`` bits each."""
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data, count, bits):
    """The first ``count`` ids of packed bytes, as unsigned 32-bit integers."""
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


class WordIds:
    """Ids of whole texts by a model whose pre-tokens never cross white space.

    Such a model gives a text the ids of its words in a row, so distinct words
    are encoded once: Arrow splits a batch into words and numbers them, and the
    ids are gathered by these numbers. ASCII letters are lowered first, as the
    model does. Texts with a special token in them are encoded as a whole.
    """

    def __init__(self, model):
        self.tokenizer = Tokenizer.from_str(model)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        samples = ["a b", "A\tb \n", "é\u0301 'S x.", "don't 12 ,;"]
        self.by_word = all(self._ids(text) == sum(map(self._ids, text.lower().split()), []) for text in samples)
        self.merge = self.tokenizer.model.tokenize
        # The character that stands for each byte in pre-tokens.
        self.shown = {}
        for letter in map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]):
            for code, shown in zip(letter.encode("utf-8"), "".join(one for one, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letter))):
                self.shown[code] = shown
        samples = ["word.,;:!?$%&*#", "àÇñß,", "ĀſǅȺ", "straße"]
        self.plain = self.by_word and all(
            self._plain(*_PLAIN.fullmatch(text).groups()) == self._part(text) for text in samples
        )
        self.memo = {}

    def _plain(self, letters, marks):
        """Ids of letters and the marks behind them, each merged as a pre-token."""
        if not letters.isascii():
            letters = letters.lower().encode("utf-8").decode("latin-1").translate(self.shown)
        ids = [token.id for part in (letters, marks) if part for token in self.merge(part)]
        return array.array("I", ids).tobytes()

    def _part(self, part):
        return np.array(self._ids(part), "<u4").tobytes()

    def _ids(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_all(self, texts):
        """Ids of an Arrow column of texts (null is empty) as one array, and their number per text."""
        texts = pc.fill_null(texts, "")
        lowered = pc.ascii_lower(texts)
        whole = np.full(len(texts), not self.by_word)
        for token in self.special:
            whole |= pc.match_substring(lowered, token).to_numpy(zero_copy_only=False)
        found, start = [], 0
        for place in [*np.flatnonzero(whole).tolist(), len(texts)]:
            if place > start:
                found.append(self._words(lowered.slice(start, place - start)))
            if place < len(texts):
                ids = np.array(self._ids(texts[place].as_py()), "<u4")
                found.append((ids, np.array([len(ids)])))
            start = place + 1
        if not found:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found))

    def _words(self, texts):
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._known(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<u4")))
        gathered = lists.take(words.indices).flatten().to_numpy(zero_copy_only=False)
        numbers = words.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[numbers])])
        bounds = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])
        return gathered, np.diff(upto[bounds])

    def _known(self, words):
        """Ids of each word as little-endian unsigned 32-bit integers."""
        ids = list(map(self.memo.get, words))
        missing = [k for k, one in enumerate(ids) if one is None]
        if not missing:
            return ids
        memo, others = self.memo, []
        for k in missing:
            plain = _PLAIN.fullmatch(words[k]) if self.plain else None
            if plain is None:
                others.append(k)
                continue
            letters, marks = plain.groups()
            known = memo.get(letters) if marks else None
            ids[k] = self._plain(letters, marks) if known is None else known + self._plain("", marks)
        encoded = self.tokenizer.encode_batch_fast([words[k] for k in others], add_special_tokens=False) if others else []
        for k, one in zip(others, encoded):
            ids[k] = np.array(one.ids, "<u4").tobytes()
        memo.update((words[k], ids[k]) for k in missing[: max(0, MEMO_WORDS - len(memo))])
        return ids


def encoder(model):
    """The worker's encoder for a model given as JSON text."""
    key = hash(model)
    if key not in _ENCODERS:
        # Spark has a worker per core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[key] = WordIds(model)
    return _ENCODERS[key]


class Writer:
    """Parts of one file, in order: documents go in, whole parts come out."""

    def __init__(self, number, bits, block_ids=BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.place, self.total = 0, 0
        self.held, self.held_ids = [], 0
        self.ids, self.starts, self.offsets = [], [], []
        self.header = _HEADER.pack(MAGIC, bits, block_ids, number)

    def _part(self, data):
        self.place += len(data) + 1
        return data

    def open(self):
        yield self._part(self.header)

    def add(self, doc_ids, ids, sizes):
        """Documents with ``sizes`` ids each, in a row in ``ids``."""
        self.ids += doc_ids
        starts = self.total + np.cumsum(sizes) - sizes
        self.starts.append(starts)
        self.total += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= self.block_ids:
            joined = np.concatenate(self.held)
            whole = len(joined) // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                yield self._block(joined[start : start + self.block_ids])
            self.held, self.held_ids = [joined[whole:].copy()], len(joined) - whole

    def _block(self, ids):
        self.offsets.append(self.place)
        return self._part(pack(ids, self.bits))

    def close(self):
        if self.held_ids:
            yield self._block(np.concatenate(self.held))
        index = self.place
        yield self._part(
            _COUNTS.pack(len(self.ids), len(self.offsets), self.total)
            + np.array([i or 0 for i in self.ids], "<i8").tobytes()
            + np.array([i is None for i in self.ids], "u1").tobytes()
            + np.concatenate([np.empty(0), *self.starts]).astype("<u8").tobytes()
            + np.array(self.offsets, "<u8").tobytes()
        )
        # The text writer adds the last byte.
        yield _TRAILER.pack(index, MAGIC, b"\n")[:-1]


class Reader:
    """Random access to one file, given as bytes or any buffer (such as a memory map)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block_ids, self.number = _HEADER.unpack_from(self.data)
        index, again, _ = _TRAILER.unpack_from(self.data, len(self.data) - _TRAILER.size)
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a file of packed ids, or not whole")
        docs, blocks, self.total = _COUNTS.unpack_from(self.data, index)
        place = index + _COUNTS.size
        self.doc_ids, place = np.frombuffer(self.data, "<i8", docs, place), place + 8 * docs
        self.null_ids, place = np.frombuffer(self.data, "u1", docs, place) == 1, place + docs
        starts, place = np.frombuffer(self.data, "<u8", docs, place), place + 8 * docs
        self.bounds = np.append(starts, np.uint64(self.total)).astype(np.int64)
        self.offsets = np.frombuffer(self.data, "<u8", blocks, place)

    def block(self, number):
        count = min(self.block_ids, self.total - number * self.block_ids)
        start = int(self.offsets[number])
        return unpack(self.data[start : start + (count * self.bits + 7) // 8], count, self.bits)

    def ids(self, start, stop):
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        start, stop = max(start, 0), min(stop, self.total)
        if start >= stop:
            return np.empty(0, "<u4")
        first = start // self.block_ids
        found = [self.block(k) for k in range(first, (stop - 1) // self.block_ids + 1)]
        joined = found[0] if len(found) == 1 else np.concatenate(found)
        return joined[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, place):
        """Ids of the document at ``place`` of the file, its end id included."""
        return self.ids(int(self.bounds[place]), int(self.bounds[place + 1]))


def write(docs, model, end_id, folder=None, text_bytes_per_file=TEXT_BYTES_PER_FILE, block_ids=BLOCK_IDS):
    """Writes the ids of every text and returns the folder.

    ``model`` is a tokenizer as JSON text; null text is empty and leaves
    ``end_id`` alone. Documents are sorted into ranges of ``doc_id`` and each range
    becomes a file, so no task holds more than its range. Rows that share an id
    lie next to each other, ordered by a hash of the text, and may lie in several
    files. An empty table gives a folder without documents. Only ``doc_id`` and
    ``text`` are read.
    """
    spark = docs.sparkSession
    folder = folder or table_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // text_bytes_per_file))
    # Rows of one id are told apart, so that a range can end among them.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("spread")]
    dealt = (
        rows.withColumn("spread", F.monotonically_increasing_id())
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    def run(batches):
        words = encoder(model)
        writer = None
        for batch in batches:
            for part in _by_bytes(batch, "text", BATCH_BYTES):
                out = []
                if writer is None:
                    bits = bits_for(max(words.vocabulary, end_id + 1))
                    writer = Writer(TaskContext.get().partitionId(), bits, block_ids)
                    out += writer.open()
                ids, sizes = words.encode_all(part["text"])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                out += writer.add(part["doc_id"].to_pylist(), ids, sizes + 1)
                if out:
                    yield _parts(out)
        if writer is not None:
            yield _parts(list(writer.close()))

    parts = dealt.mapInArrow(run, "part binary")
    # The text writer copies the bytes as they are and adds the line feed.
    parts.select(F.col("part").cast("string")).write.option("compression", "none").text(folder)
    return folder


def _by_bytes(batch, column, limit):
    """A batch in parts of about ``limit`` bytes of a text column, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _parts(parts):
    return pa.record_batch({"part": pa.array(parts, pa.binary())})


def _files(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.where("length > 0").select("path", "content")


def manifest(spark, folder):
    """A row per file: file (number), path, first (ids of earlier files), n_ids, n_docs."""

    def run(batches):
        for batch in batches:
            found = []
            for path, data in zip(batch["path"].to_pylist(), batch["content"]):
                one = Reader(data.as_buffer())
                found.append((one.number, path, one.total, len(one.doc_ids)))
            columns = list(zip(*found)) or [[]] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["file", "path", "n_ids", "n_docs"]
            )

    files = _files(spark, folder).mapInArrow(run, "file long, path string, n_ids long, n_docs long")
    return files.select("file", "path", _ids_before(), "n_ids", "n_docs")


def _ids_before():
    """Ids of earlier files, over a table with a row per file."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first")


def read(spark, folder, keep_ids=False, ids_at_once=1 << 22):
    """doc_id, start, n_tokens, ids_crc32 of every document of a folder of :func:`write`.

    ``start`` counts the ids of all documents before it. ``keep_ids`` adds the ids
    as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                one = Reader(data.as_buffer())
                low = 0
                while low < len(one.doc_ids):
                    base = int(one.bounds[low])
                    high = max(low + 1, int(np.searchsorted(one.bounds, base + ids_at_once, "right")) - 1)
                    ids = one.ids(base, int(one.bounds[high]))
                    cuts = (one.bounds[low : high + 1] - base).tolist()
                    own = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                    columns = {
                        "file": pa.array(np.full(high - low, one.number), pa.int64()),
                        "doc_id": pa.array(one.doc_ids[low:high], pa.int64(), mask=one.null_ids[low:high]),
                        "local": pa.array(one.bounds[low:high], pa.int64()),
                        "n_tokens": pa.array(np.diff(one.bounds[low : high + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(data) for data in own], pa.int64()),
                    }
                    if keep_ids:
                        columns["ids"] = pa.array(own, pa.binary())
                    yield pa.record_batch(columns)
                    low = high

    schema = "file long, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    rows = cut_lineage(_files(spark, folder).select("content").mapInArrow(run, schema))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n_ids"))
    placed = rows.join(totals.select("file", _ids_before()), "file")
    return placed.select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])
    )


def span(spark, folder, start, stop):
    """Ids ``start`` to ``stop`` of the whole folder as one array; opens only the files they lie in.

    For a bounded span, such as a training window: it comes to the driver.
    """
    hit = manifest(spark, folder).where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start)).collect()
    firsts = {row.path: row.first for row in hit}
    if not firsts:
        return np.empty(0, "<u4")

    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"]):
                first = firsts[path]
                ids = Reader(data.as_buffer()).ids(start - first, stop - first)
                yield pa.record_batch({"first": pa.array([first], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary())})

    files = spark.read.format("binaryFile").load(list(firsts)).select("path", "content")
    found = sorted(tuple(row) for row in files.mapInArrow(run, "first long, ids binary").collect())
    return np.frombuffer(b"".join(ids for _, ids in found), "<u4")
