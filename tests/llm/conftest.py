import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words(rng, count):
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(count))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, nulls, empty, short, very long and odd ones."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 90)) for _ in range(25)]
    found = list(base)
    found += [base[0], base[0].upper(), base[1] + " extra", f"intro {base[2]}"]
    for text in base[3:9]:
        parts = text.split()
        parts[rng.randrange(len(parts))] = "changed"
        found.append(" ".join(parts))
    found += [None, "", "   \n\t ", "one", "one two", "one  two", "a\x0bb\x0cc", "é ß 中文 😀 x\x85y"]
    found.append(words(rng, 30_000))
    found.append("\n".join([base[4]] * 5 + [base[5]]))
    return found


@pytest.fixture(scope="session")
def documents(spark, texts):
    """doc_id, text, lang, source, n_chars, and columns whose names could clash."""
    rows = [
        (7 * k % 1009, text, ("en", "de", None)[k % 3], "src0" if k % 3 else None, len(text or ""), "x", k)
        for k, text in enumerate(texts)
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, piece int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
