"""Line-first quality rules: failing lines go, then documents that lost too much."""

import re

import numpy as np
import pyarrow as pa

from .common import slices, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays if this share of its words is in lines that passed.
MIN_KEPT_SHARE = 0.5

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Characters a sentence may end with, and closing marks after them.
TERMINAL = ".!?…。！？:;"
CLOSING = "\"'”’»)]"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "sign in", "sign up", "subscribe to", "terms of service", "terms of use", "use cookies",
)
#: Separators between navigation entries.
NAVIGATION = re.compile(r" [|»›·•>] ")

_SPACES = " \t\n\r\x0b\x0c"


def line_fails(line):
    """The first rule that a line breaks, or None. A line without words breaks none."""
    words = line.split()
    if not words:
        return None
    count = len(words)
    if len(NAVIGATION.findall(line)) * 4 >= count:
        return "navigation"
    symbols = sum(map(line.count, SYMBOLS))
    if symbols * 5 > count:
        return "symbols"
    bare = line.rstrip(_SPACES + CLOSING)
    if not bare or bare[-1] not in TERMINAL:
        return "punctuation"
    if line.count("!") * 3 > count:
        return "exclamation"
    if count < 30:
        lowered = line.lower()
        if any(phrase in lowered for phrase in BOILERPLATE):
            return "boilerplate"
    return None


def repeated_words(words):
    """Words inside 3-word windows that occur twice or more in the list."""
    if len(words) < 4:
        return 0
    numbers = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pair_codes = codes[:-1] * len(numbers) + codes[1:]
    # Pairs are numbered again, so that a window's number cannot overflow.
    pair_codes = np.unique(pair_codes, return_inverse=True)[1]
    windows = pair_codes[:-1] * len(numbers) + codes[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= repeated
    return int(covered.sum())


def measure(text, min_kept_share=MIN_KEPT_SHARE):
    """All columns of :func:`assess` for one text, the cleaned text last."""
    words = text.encode("utf-8").split()  # bytes split at [\x20\x09-\x0D] alone
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen, n_dup_lines, kept_lines, kept_words = set(), 0, [], 0
    for line in text.split("\n"):
        size = len(line.encode("utf-8").split())
        if not size:
            kept_lines.append(line)
            continue
        if line in seen:
            n_dup_lines += 1
            continue
        seen.add(line)
        if line_fails(line) is None:
            kept_lines.append(line)
            kept_words += size
    n_repeat = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base_failed and kept_words >= min_kept_share * n_words
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, "\n".join(kept_lines)


def assess(docs, min_kept_share=MIN_KEPT_SHARE, with_text=False):
    """Counts and verdict for every document.

    Words are runs of characters other than space and U+0009 to U+000D. Lines
    are cut at line feeds. A line that equals an earlier one, or breaks a rule
    of :func:`line_fails`, is removed; ``kept`` needs ``min_kept_share`` of the
    words to stay and the base rules to hold. Null text counts as empty and
    fails. Repeated rows are judged each; other columns are not read.
    ``with_text`` adds ``clean_text``, the lines that passed.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string()),
    ]
    fields = fields if with_text else fields[:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [
                    (doc_id, *measure(text, min_kept_share))[: len(fields)]
                    for doc_id, text in zip(part["doc_id"].to_pylist(), texts_of(part["text"]))
                ]
                columns = list(zip(*rows))
                yield pa.record_batch(
                    [pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
                )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", clean_text string" if with_text else ""))
