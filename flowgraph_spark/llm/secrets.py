"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

The patterns find what their wording gives away. Other strings are judged by
two second-order character models, one of random strings and one of ordinary
identifiers: a string whose log-likelihood ratio is high enough is a span too.
Both are trained on samples labelled by the patterns themselves.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import slices, texts_of

#: The base patterns and the least length of what they match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a whole run, since the run is greedy
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
#: One of these is in every text that the first pattern matches, in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

#: What the models judge: a run of these, not next to a letter, digit or mark of a longer one. Both sides
#: of an equals sign are runs of their own, and so are the parts of a dotted token.
CANDIDATE_CHARS = 16
CANDIDATE = re.compile(rf"(?<![\w+/-])[A-Za-z0-9+/_-]{{{CANDIDATE_CHARS},}}={{0,2}}(?![\w+/-])")
IDENTIFIER = re.compile(r"(?<![\w+/=.-])[A-Za-z_][A-Za-z0-9_-]{7,}(?![\w+/=.-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: A candidate is a span from this share of the ratio per symbol that even random strings have,
#: and from LEAST_RATIO nats in any case.
RATIO_SHARE = 0.6
LEAST_RATIO = 0.7
#: Documents that the samples are taken from; more are thinned by hash.
TRAIN_ROWS = 20_000
#: Weight of the even distribution within the model of random strings.
EVEN_WEIGHT = 0.5

_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_END, _START = len(ALPHABET), len(ALPHABET) + 1
_SIZE = len(ALPHABET) + 2
#: Parts of a compound name: a word with at most a capital in front, capitals, digits; + and = are rare in names.
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[+=]")


def base_spans(text):
    """(start, order of kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(string):
    """Codes of a string's parts, each with two starts before and an end behind.

    Taken apart, a name made of words looks like its words, while a random
    string falls into many short parts. Case shows in the parts alone, and marks
    only part.
    """
    codes = []
    for part in _PARTS.findall(string.lower() if string.isupper() else string):
        part = part.lower()
        codes += [_START, _START, *_CODE[np.frombuffer(part.encode("ascii"), np.uint8)].tolist(), _END]
    return np.array(codes, np.int64) if codes else np.full(2, _START)


def _triples(string):
    c = _codes(string)
    triples = c[:-2], c[1:-1], c[2:]
    real = triples[2] != _START
    return tuple(t[real] for t in triples)


def trigram_counts(strings):
    counts = np.zeros((_SIZE,) * 3)
    for string in strings:
        np.add.at(counts, _triples(string), 1)
    return counts


def _probabilities(counts, prior=8.0):
    """Second-order model backing off to first and zeroth order and to even shares."""
    even = 1 / _SIZE
    zero = (counts.sum((0, 1)) + prior * even) / (counts.sum() + prior)
    pair = counts.sum(0)
    one = (pair + prior * zero) / (pair.sum(1, keepdims=True) + prior)
    return (counts + prior * one) / (counts.sum(2, keepdims=True) + prior)


def train(secrets, identifiers):
    """Table of log-likelihood ratios by three codes, from the counts of both samples."""
    random = (1 - EVEN_WEIGHT) * _probabilities(secrets) + EVEN_WEIGHT / _SIZE
    return np.log(random / _probabilities(identifiers)).astype(np.float32)


def ratio(table, string):
    """Mean log-likelihood ratio per symbol; a number is as ordinary as can be."""
    if string.isdigit():
        return -np.inf
    triples = _triples(string)
    return float(table[triples].mean()) if len(triples[0]) else -np.inf


class Covered:
    """What spans sorted by start cover; a question takes logarithmic time."""

    def __init__(self, spans):
        self.starts = [start for start, _, _ in spans]
        self.upto = list(accumulate((end for _, _, end in spans), max))

    def meets(self, start, end):
        """Does a span share a place with ``start`` to ``end``."""
        place = bisect_left(self.starts, end)
        return place > 0 and self.upto[place - 1] > start

    def holds(self, start, end):
        """Does one span hold all of ``start`` to ``end``."""
        place = bisect_right(self.starts, start)
        return place > 0 and self.upto[place - 1] >= end


def samples(docs, train_rows=TRAIN_ROWS):
    """``secret`` and ``string``: labelled strings of about ``train_rows`` documents sampled by hash.

    Secret strings are what the base patterns match, less the wording. Ordinary
    ones are identifiers outside all base spans that two or more documents use.
    """
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    position = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = texts.where(position < train_rows / max(1, docs.count())).select("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                secret, ordinary = [], []
                for text in texts_of(part["text"]):
                    spans = base_spans(text)
                    secret += [m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
                    secret += [text[a:b] for a, kind, b in spans if kind]
                    covered = Covered(spans)
                    ordinary += {m.group() for m in IDENTIFIER.finditer(text) if not covered.meets(*m.span())}
                flags = [True] * len(secret) + [False] * len(ordinary)
                yield pa.record_batch(
                    {"secret": pa.array(flags, pa.bool_()), "string": pa.array(secret + ordinary, pa.string())}
                )

    found = chosen.mapInArrow(run, "secret boolean, string string")
    counted = found.groupBy("secret", "string").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("secret OR n > 1").select("secret", "string")


def fit(docs, train_rows=TRAIN_ROWS):
    """Table of log-likelihood ratios, with counts summed over the sample in Spark, and the bar.

    No documents give models that do not differ, and no spans beside the base ones.
    """

    def count(batches):
        totals = {flag: np.zeros((_SIZE,) * 3) for flag in (True, False)}
        for batch in batches:
            flags, strings = batch["secret"].to_pylist(), batch["string"].to_pylist()
            for flag, total in totals.items():
                total += trigram_counts(s for f, s in zip(flags, strings) if f == flag)
        for flag, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.record_batch(
                {"secret": pa.array([flag] * len(used), pa.bool_()), "place": pa.array(used),
                 "n": pa.array(total.ravel()[used].astype(np.int64))}
            )

    # A row per place of the table at most.
    summed = (
        samples(docs, train_rows).mapInArrow(count, "secret boolean, place long, n long")
        .groupBy("secret", "place").agg(F.sum("n").alias("n")).toArrow()
    )
    counts = {flag: np.zeros(_SIZE**3) for flag in (True, False)}
    for flag in counts:
        part = summed.filter(pc.equal(summed["secret"], flag))
        counts[flag][part["place"].to_numpy()] = part["n"].to_numpy()
    shape = (_SIZE,) * 3
    table = train(counts[True].reshape(shape), counts[False].reshape(shape))
    # How far apart the models are follows the size of the samples, so the bar does as well.
    even = np.random.default_rng(0).choice(list(ALPHABET[:62]), (200, 32))
    usual = float(np.mean([ratio(table, "".join(row)) for row in even]))
    return table, max(LEAST_RATIO, RATIO_SHARE * usual)


def all_spans(text, model):
    """Base spans, and candidates that look random and do not lie within one of them.

    A candidate that reaches beyond a base span is judged as a whole, and its span
    stands beside the base one.
    """
    table, least = model
    base = base_spans(text)
    found, covered = list(base), Covered(base)
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        if not covered.holds(start, end) and ratio(table, match.group()) >= least:
            found.append((start, 3, end))
    return base, sorted(found)


def _listed(spans):
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs, model):
    """Span counts, digest and list for every row.

    Positions are code points, the end exclusive. Null text counts as empty: no
    spans. Repeated rows are scanned each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), texts_of(part["text"])):
                    base, spans = all_spans(text, shared.value)
                    digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                    rows.append((doc_id, *(sum(s[1] == k for s in base) for k in range(3)), digest, _listed(spans)))
                columns = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs, model, mask="[SECRET]"):
    """``docs`` with every span replaced by ``mask``; all rows and columns stay.

    ``n_chars``, where there, follows the text. Rows without a span are left as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part["text"].to_pylist()
                sizes = part["n_chars"].to_pylist() if "n_chars" in names else None
                for k, text in enumerate(texts):
                    spans = all_spans(text, shared.value)[1] if text else []
                    if spans:
                        parts, at = [], 0
                        for start, _, end in spans:
                            if start >= at:
                                parts += [text[at:start], mask]
                            at = max(at, end)
                        texts[k] = "".join(parts) + text[at:]
                        if sizes is not None:
                            sizes[k] = len(texts[k])
                columns = {name: part[name] for name in names}
                columns["text"] = pa.array(texts, part["text"].type)
                if sizes is not None:
                    columns["n_chars"] = pa.array(sizes, part["n_chars"].type)
                yield pa.record_batch(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
