"""Language identification with multinomial naive Bayes over hashed character n-grams."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import crc_remainder, slices, texts_of

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Documents per language that a model is fitted on; more labelled rows are sampled by hash.
TRAIN_ROWS_PER_LANGUAGE = 5000
#: The matrix has 2 ** BUCKET_BITS rows and a column per language; this bounds its size.
MAX_LANGUAGES = 512
#: Characters whose n-grams are scored at once.
CHUNK_CHARS = 1 << 19

_LETTERS = None


def _letters():
    """Boolean table over all code points: is it a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _codes(text):
    """Lower-cased code points; everything but letters is a space, one at each end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[raw], raw, np.uint32(32))


def _buckets(codes, order):
    """Hash bucket of the n-gram that starts at each position."""
    length = len(codes) - order + 1
    mixed = np.full(length, order, np.uint32)
    for k in range(order):
        mixed = (mixed ^ codes[k : k + length]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)


def bucket_counts(text):
    """Occurrences of each hash bucket in a text."""
    codes = _codes(text)
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for order in ORDERS:
        if len(codes) >= order:
            counts += np.bincount(_buckets(codes, order), minlength=len(counts))
    return counts


def fit(docs, text="text", lang="lang", row_id="doc_id", rows_per_language=TRAIN_ROWS_PER_LANGUAGE):
    """Languages and their log-probability matrix, counted in Spark.

    Rows with a null language or text are left out. A language with more than
    ``rows_per_language`` rows is sampled by the hash of its ids to about that
    many, whole texts each. No rows give no languages.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {
        row["lang"]: row["count"]
        for row in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    }
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages.")
    if not sizes:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32)
    share = F.element_at(
        F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, rows_per_language / n))]),
        F.col("lang"),
    )
    position = F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(position < share).select("lang", "text")

    def count(batches):
        totals = {}
        for batch in batches:
            for part in slices(batch):
                for name, value in zip(part["lang"].to_pylist(), texts_of(part["text"])):
                    if name not in totals:
                        totals[name] = np.zeros(1 << BUCKET_BITS, np.int64)
                    totals[name] += bucket_counts(value)
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch(
                {"lang": pa.array([name] * len(used), pa.string()), "bucket": used, "n": counts[used]}
            )

    counted = (
        sample.mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    languages = sorted(sizes)
    place = {name: k for k, name in enumerate(languages)}
    matrix = np.ones((1 << BUCKET_BITS, len(languages)))  # add-one smoothing
    table = counted.toArrow()
    columns = np.array([place[name] for name in table["lang"].to_pylist()], np.int64)
    matrix[table["bucket"].to_numpy(), columns] += table["n"].to_numpy()
    return languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def _log_likelihoods(texts, matrix):
    """Summed log-probabilities of each text under each language."""
    totals = np.zeros((len(texts), matrix.shape[1]))
    codes = [_codes(text) for text in texts]
    start = 0
    while start < len(codes):
        stop, size = start + 1, len(codes[start])
        while stop < len(codes) and size + len(codes[stop]) <= CHUNK_CHARS:
            size += len(codes[stop])
            stop += 1
        joined = codes[start] if stop == start + 1 else np.concatenate(codes[start:stop])
        owner = np.repeat(np.arange(start, stop), [len(c) for c in codes[start:stop]])
        for low in range(0, len(joined), CHUNK_CHARS):
            # A window reaches past the chunk by the longest n-gram less one.
            window = joined[low : low + CHUNK_CHARS + max(ORDERS) - 1]
            for order in ORDERS:
                count = min(CHUNK_CHARS, len(window) - order + 1)
                if count <= 0:
                    continue
                found = _buckets(window[: count + order - 1], order)
                first = owner[low : low + count]
                inside = first == owner[low + order - 1 : low + order - 1 + count]
                found, first = found[inside], first[inside]
                edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
                if len(first):
                    totals[first[edges]] += np.add.reduceat(matrix[found], edges, axis=0, dtype=np.float64)
        start = stop
    return totals


def predict(docs, model, text="text", row_id="doc_id"):
    """``row_id``, ``lang_pred`` and ``score`` for every row of ``docs``.

    The score is the posterior probability of the predicted language under
    equal priors. A null text, a text without a letter, or a model without
    languages gives ``und`` and score 0. Ties go to the first name in order.
    Repeated rows are scored each; other columns are not read.
    """
    languages, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    rows = docs.select(F.col(row_id), F.col(text).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()

    def score(batches):
        table = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part["text"])
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if languages:
                    totals = _log_likelihoods(texts, table)
                    best = totals.argmax(axis=1)
                    weights = np.exp(totals - totals.max(axis=1, keepdims=True))
                    share = weights.max(axis=1) / weights.sum(axis=1)
                    for k, value in enumerate(texts):
                        if any(map(str.isalpha, value)):
                            names[k], scores[k] = languages[best[k]], float(share[k])
                yield pa.record_batch(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[row_id, "lang_pred", "score"],
                )

    return rows.mapInArrow(score, f"`{row_id}` {id_type}, lang_pred string, score double")


def detect(docs, rows_per_language=TRAIN_ROWS_PER_LANGUAGE):
    """Fit on the documents not held out, predict all of them."""
    held_out = crc_remainder("doc_id", 3) == 1
    model = fit(docs.where(~held_out), rows_per_language=rows_per_language)
    return predict(docs, model).withColumn("held_out", held_out)


def keep_identified(docs, min_score=0.5, rows_per_language=TRAIN_ROWS_PER_LANGUAGE):
    """Documents whose language is identified with ``min_score`` or more; columns stay.

    The filter is evaluated in one pass over the rows themselves, so repeated
    ids need no care.
    """
    held_out = crc_remainder("doc_id", 3) == 1
    languages, matrix = fit(docs.where(~held_out), rows_per_language=rows_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def keep(batches):
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part["text"])
                totals = _log_likelihoods(texts, shared.value)
                weights = np.exp(totals - totals.max(axis=1, keepdims=True))
                sure = weights.max(axis=1) / weights.sum(axis=1) >= min_score
                lettered = [any(map(str.isalpha, value)) for value in texts]
                yield part.filter(pa.array(sure & np.array(lettered, bool)))

    return docs.mapInArrow(keep, docs.schema) if languages else docs.limit(0)
