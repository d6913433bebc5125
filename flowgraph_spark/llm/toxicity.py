"""Toxicity from two class-conditional Kneser-Ney models of character sequences.

Each class has discounted counts of ORDER-character sequences within words;
both back off to one chain of continuation counts over all labelled texts. So
a sequence that no class has seen weighs the same under both but for the back-
off mass of its context, and an expression is told apart as soon as one class
has seen it. Only the log-likelihood ratios are kept: a table of all seen
sequences and one of all contexts, which grow with their number.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, crc_remainder, cut_lineage, slices, texts_of

ORDER = 5
DISCOUNT = 0.75
START, END = "\x02", "\x03"
FILTER_BITS = 1 << 23
#: Words of a window; the worst window of a text is the second feature.
WINDOW = 24
#: Labelled rows that the two weights and the offset are fitted on.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Distinct words, and sequences, that a worker remembers.
MEMO = 400_000


def words_of(text):
    return text.lower().split()


def count_words(rows):
    """Words of labelled rows with their counts: word, toxic, ordinary."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                found = {}
                for text, toxic in zip(texts_of(part["text"]), part["toxic"].to_pylist()):
                    for word in words_of(text):
                        pair = found.get(word)
                        if pair is None:
                            pair = found[word] = [0, 0]
                        pair[toxic] += 1
                yield pa.record_batch(
                    [
                        pa.array(list(found), pa.string()),
                        pa.array([p[1] for p in found.values()], pa.int64()),
                        pa.array([p[0] for p in found.values()], pa.int64()),
                    ],
                    names=["word", "toxic", "ordinary"],
                )

    counted = rows.mapInArrow(run, "word string, toxic long, ordinary long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def sequence_table(words, order=ORDER, discount=DISCOUNT):
    """Log-likelihood ratio of every seen sequence, and of the back-off of every context.

    Two DataFrames: ``gram, ratio, total`` and ``context, ratio, total``.
    """
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    place = F.explode(F.sequence(F.lit(1), F.length("word") + 1))
    grams = cut_lineage(
        words.select(padded.alias("padded"), "toxic", "ordinary", place.alias("k"))
        .select(F.substring("padded", F.col("k"), F.lit(order)).alias("gram"), "toxic", "ordinary")
        .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    head = lambda n: F.substring("gram", 1, n - 1).alias("context")
    contexts = grams.groupBy(head(order)).agg(
        *[F.sum(c).alias(f"{c}_sum") for c in ("toxic", "ordinary")],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")],
    )
    # Back-off probability of the sequence less its first character, from continuation counts.
    tail = lambda n: F.substring("gram", 2, n - 1).alias("gram")
    shorter, kinds = {}, grams.select("gram")
    for n in range(order, 1, -1):
        shorter[n - 1] = kinds.select(tail(n)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        kinds = shorter[n - 1]
    total = shorter[1].agg(F.sum("n") + F.count(F.lit(1))).scalar()
    backoff = shorter[1].select("gram", ((F.col("n") + 1) / total).alias("p"))
    for n in range(2, order):
        sums = shorter[n].groupBy(head(n)).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("t"))
        backoff = (
            shorter[n].withColumn("context", head(n)).withColumn("rest", F.substring("gram", 2, n - 1))
            .join(sums, "context").join(backoff.select(F.col("gram").alias("rest"), "p"), "rest")
            .select("gram", ((F.col("n") - discount + discount * F.col("t") * F.col("p")) / F.col("s")).alias("p"))
        )

    def mass(c):
        """Probability mass a context leaves to the shared model."""
        left = discount * F.col(f"{c}_kinds") / F.col(f"{c}_sum")
        return F.when(F.col(f"{c}_sum") > 0, left).otherwise(1.0)

    def probability(c):
        own = F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"{c}_sum")
        return F.when(F.col(f"{c}_sum") > 0, own).otherwise(0.0) + mass(c) * F.col("p")

    ratios = (
        grams.withColumn("context", head(order)).withColumn("rest", F.substring("gram", 2, order - 1))
        .join(contexts, "context").join(backoff.select(F.col("gram").alias("rest"), "p"), "rest")
        .select(
            "gram", F.log(probability("toxic") / probability("ordinary")).alias("ratio"),
            (F.col("toxic") + F.col("ordinary")).alias("total"),
        )
    )
    unseen = contexts.select(
        "context", F.log(mass("toxic") / mass("ordinary")).alias("ratio"),
        (F.col("toxic_sum") + F.col("ordinary_sum")).alias("total"),
    )
    return ratios, unseen


def _packed(table, key):
    """All keys of a table as sorted 64-bit hashes with their ratios, and a dict of those that share a hash.

    12 bytes a key; the dict holds the texts of keys whose hashes are equal, so none is lost.
    """
    hashed = table.select(F.xxhash64(key).alias("h"), F.col(key).alias("text"), "ratio")
    rows = (
        hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("ratio").alias("ratio"))
        .select("h", "n", F.col("ratio").cast("float").alias("ratio"))
    )
    rows = cut_lineage(rows)
    shared = hashed.join(rows.where("n > 1").select("h"), "h").select("text", "ratio").collect()
    found = rows.where("n = 1").select("h", "ratio").toArrow()
    hashes, ratios = found["h"].to_numpy(), found["ratio"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], ratios[order], {row["text"]: row["ratio"] for row in shared}


class Scorer:
    """Log-likelihood ratios of words under the tables of sequences and contexts."""

    def __init__(self, grams, contexts, order=ORDER):
        self.grams, self.contexts, self.order = grams, contexts, order
        self.words, self.sequences = {}, {}

    @staticmethod
    def _lookup(table, key):
        hashes, ratios, shared = table
        if key in shared:
            return shared[key]
        h = xxhash.xxh64_intdigest(key.encode("utf-8"), 42)  # as Spark's xxhash64
        h = np.int64(h - (1 << 64) if h >> 63 else h)
        place = hashes.searchsorted(h)
        return float(ratios[place]) if place < len(hashes) and hashes[place] == h else None

    def sequence(self, gram):
        found = self._lookup(self.grams, gram)
        if found is None:
            found = self._lookup(self.contexts, gram[:-1])
        found = 0.0 if found is None else found
        if len(self.sequences) < MEMO:
            self.sequences[gram] = found
        return found

    def word(self, word):
        """Summed ratio and number of sequences of a word."""
        order, known = self.order, self.sequences
        padded = f"{START * (order - 1)}{word}{END}"
        total = 0.0
        for k in range(len(word) + 1):
            gram = padded[k : k + order]
            ratio = known.get(gram)
            total += self.sequence(gram) if ratio is None else ratio
        found = (total, len(word) + 1)
        if len(self.words) < MEMO:
            self.words[word] = found
        return found

    def features(self, text):
        """Mean ratio per character of the whole text and of its worst window."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0
        known, one = self.words, self.word
        pairs = np.array([known.get(w) or one(w) for w in words])
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(pairs, axis=0)])
        width = min(WINDOW, len(words))
        windows = sums[width:] - sums[:-width]
        return sums[-1, 0] / sums[-1, 1], float((windows[:, 0] / windows[:, 1]).max())


_SCORERS = {}


def _features(rows, shared, key, columns):
    """Adds the two features to ``columns`` of ``rows``."""

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()  # a worker holds one model
            _SCORERS[key] = Scorer(*shared.value)
        scorer = _SCORERS[key]
        for batch in batches:
            for part in slices(batch):
                pairs = [scorer.features(text) for text in texts_of(part["text"])]
                yield pa.record_batch(
                    [part[c] for c in columns]
                    + [pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)],
                    names=[*columns, "mean_ratio", "window_ratio"],
                )

    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in columns] + ["mean_ratio double", "window_ratio double"])
    return rows.select(*columns, "text").mapInArrow(run, schema)


def logistic(features, labels, steps=60, ridge=1e-3):
    """Scale, weights and offset of a logistic regression, by Newton's method."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + ridge * len(x) * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()


def _likely(rows, marked):
    """``rows`` less most of those without a label, so that their texts are not shuffled.

    A bitmap of fixed size stands for the labelled ids; the join that follows is exact.
    """
    bits = bitmap_of(marked.select(F.xxhash64("doc_id").alias("h")), "h", FILTER_BITS)
    shared, names = rows.sparkSession.sparkContext.broadcast(bits), rows.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                yield part.filter(pa.array(bitmap_has(shared.value, part["h"].to_numpy()))).select(names)

    return rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, rows.schema)


def score(docs, labels, threshold=THRESHOLD, calibration_rows=CALIBRATION_ROWS):
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Rows whose crc32 of the id leaves 2 modulo 4 are held out. Weights and
    offset are fitted on rows with remainder 3, sampled by hash beyond
    ``calibration_rows``; the models count all words of all other labelled
    rows. A text without words, or null, has both features 0
    and the score they give. Labels that are null or belong to no row are not
    used; several labels of one id count as toxic if one is. Without toxic and
    ordinary rows in both parts the score is the mean label of what there is,
    0 without any. Repeated rows are scored each; other columns are not read.
    """
    spark = docs.sparkSession
    remainder = crc_remainder("doc_id", 4)
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    texts = docs.select("doc_id", "text", remainder.alias("part"))
    marked = cut_lineage(marked)
    wanted = texts.where("part <> 2 AND text IS NOT NULL").select("doc_id", "text", "part")
    train = _likely(wanted, marked).join(marked, "doc_id")
    train = cut_lineage(train.select("doc_id", "text", "part", "toxic"))
    # The calibration sample comes first, and what is not in it is counted.
    share = calibration_rows / max(1, train.where("part = 3").count())
    position = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    train = train.withColumn("counts", (F.col("part") != 3) | (position >= share))
    sizes = {
        (row["counts"], row["toxic"]): row["count"] for row in train.groupBy("counts", "toxic").count().collect()
    }
    result = texts.select("doc_id", "text", (F.col("part") == 2).alias("held_out"))
    if len(sizes) < 4:
        rows = sum(sizes.values())
        constant = sum(n for (_, toxic), n in sizes.items() if toxic) / rows if rows else 0.0
        scored = result.select("doc_id", "held_out", F.lit(constant).alias("score"))
    else:
        ratios, unseen = sequence_table(count_words(train.where("counts").select("text", "toxic")))
        ratios, unseen = cut_lineage(ratios), cut_lineage(unseen)
        model = (_packed(ratios, "gram"), _packed(unseen, "context"))
        shared = spark.sparkContext.broadcast(model)
        key = xxhash.xxh64_hexdigest(
            b"".join(p.tobytes() for table in model for p in table[:2]) + repr([sorted(t[2].items()) for t in model]).encode()
        )
        fitted = _features(train.where("NOT counts"), shared, key, ["toxic"]).toPandas()
        weights, offset = logistic(
            fitted[["mean_ratio", "window_ratio"]].to_numpy(), fitted["toxic"].to_numpy(np.float64)
        )
        line = F.col("mean_ratio") * float(weights[0]) + F.col("window_ratio") * float(weights[1]) + float(offset)
        scored = _features(result, shared, key, ["doc_id", "held_out"]).select(
            "doc_id", "held_out", (1 / (1 + F.exp(-line))).alias("score")
        )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
