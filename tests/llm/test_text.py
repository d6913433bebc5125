"""Operators on single texts, against libraries, brute force and held-out labels."""

import hashlib
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from flowgraph_spark.llm import byte_bpe, langid, packing, quality, secrets, sentencepiece_bpe, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
BYTE_MODEL = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def odd_texts(count, alphabet):
    rng = random.Random(7)
    fixed = ["", " ", "  a b ", "▁x ▁▁", "<s></s><unk><0x0A>", "\n a", " \n a \n", "x" * 300, "▁" * 40, " " * 33,
             "a  b", "x <|endoftext|> y", "don't  we'll\r\n", "a　 b", "a  b", "\x00\x1c \x85"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(count)]


def test_sentencepiece_equals_the_library(texts):
    model = sentencepiece_bpe.model_of(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for text in odd_texts(800, "aab  ▁\n\té😀ẞ中文 <s>0x0A1234thein 　") + [t or "" for t in texts]:
        want = library.encode(text, add_bos=True, add_eos=True)
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text[:80])
        assert model.decode(ids) == library.decode(want), repr(text[:80])


def test_sentencepiece_decodes_broken_bytes_as_the_library():
    model = sentencepiece_bpe.model_of(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_sentencepiece_rows(documents, empty):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    found = {r.doc_id: r for r in sentencepiece_bpe.encode_documents(documents, MODEL).collect()}
    for row in documents.collect():
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        got, raw = found[row.doc_id], np.array(ids, "<u4").tobytes()
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(raw).hexdigest() and bytes(got.ids) == raw
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(empty, MODEL, digests_only=True).count() == 0


def test_byte_ids_equal_the_library(texts):
    library, own = Tokenizer.from_str(BYTE_MODEL), byte_bpe.encoder(BYTE_MODEL)
    for text in odd_texts(800, "aab  \n\té😀ẞ中文 's 't'll 1234 　 \x85\x1c<|>!?.,\r") + [t or "" for t in texts]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_sequences(rows, capacity):
    """Every sequence is gapless from 0 and within capacity."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(documents, empty):
    library = Tokenizer.from_str(BYTE_MODEL)
    rows = packing.pack(packing.cut_pieces(documents, BYTE_MODEL), pieces_per_group=9).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in documents.collect():
        ids = np.array(library.encode(doc.text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[doc.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert check_sequences(rows, 1024) <= 1.1 * sum(r.length for r in rows) / 1024 + 1
    assert packing.pack(packing.cut_pieces(empty, BYTE_MODEL)).count() == 0


def test_packing_of_pieces_that_fill_nothing(spark):
    """100,000 pieces of 600 tokens fill no sequence; they are placed in groups, none in one last task."""
    pieces = spark.range(100_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "600L as length", "id as ids_crc32")
    packed = packing.pack(pieces, pieces_per_group=5000).selectExpr("sequence_id", "offset", "shiftright(sequence_id, 34) as task")
    rows = packed.collect()
    assert len(rows) == len({r.sequence_id for r in rows}) == 100_000 and {r.offset for r in rows} == {0}
    tasks = {}
    for r in rows:
        tasks[r.task] = tasks.get(r.task, 0) + 1
    assert len(tasks) > 4
    mixed = spark.range(40_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + pmod(xxhash64(id), 1023) as length", "id as ids_crc32")
    found = packing.pack(mixed, pieces_per_group=2000).collect()
    assert check_sequences(found, 1024) <= 1.07 * sum(r.length for r in found) / 1024 + 1 and len(found) == 40_000
    # Rows that are equal in all are spread over groups as well; a sequence holds 20 of them.
    same = spark.createDataFrame([(1, 0, 0, 50, 7)] * 3000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert 150 <= check_sequences(packing.pack(same, pieces_per_group=1000).collect(), 1024) <= 153


@pytest.mark.parametrize("seed", range(4))
def test_packing_wastes_little(seed):
    rng = random.Random(seed)
    lengths = [min(1023, 1 + int(rng.lognormvariate(5.5, 0.8))) for _ in range(4000)]
    _, _, used = packing.place_all(lengths)
    assert used <= 1.02 * sum(lengths) / 1024 + 1


def test_placement_follows_the_sum_of_squares():
    def squares(levels):
        return sum(n * n for level, n in Counter(levels).items() if 0 < level < 16)

    rng = random.Random(3)
    lengths = [rng.randrange(1, 16) for _ in range(200)]
    sequence, offset, _ = packing.place(lengths, 16)
    levels = []
    for size, number, at in zip(lengths, sequence, offset):
        options = [squares(levels + [size])] + [
            squares([*levels[:k], level + size, *levels[k + 1 :]]) for k, level in enumerate(levels) if level + size <= 16
        ]
        if number == len(levels):
            levels.append(0)
        assert levels[number] == at
        levels[number] += size
        assert squares(levels) == min(options)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_counts_equal_brute_force(documents, empty):
    found = {r.doc_id: r for r in quality.assess(documents, with_text=True).collect()}
    for doc in documents.collect():
        r = found[doc.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_quality(doc.text or "")
        assert not (r.base_failed and r.kept)
    assert quality.assess(empty).count() == 0


def test_quality_lines():
    prose = "A sentence of ordinary words that goes on for a while and then ends."
    for line, rule in (
        (prose, None), ("", None), ("Home | About | Contact | Help", "navigation"), ("x### y*** z$$$ w%%%.", "symbols"),
        ("A heading without an end", "punctuation"), ("BUY!! NOW!! TODAY!!", "exclamation"),
        ("All rights reserved.", "boilerplate"), ('He said "yes."', None),
    ):
        assert quality.line_fails(line) == rule, line
    lines = [prose.replace("while", f"while {k}") for k in range(6)]
    good = "\n".join(lines)
    assert quality.measure(good, 0.5)[6] or quality.measure(good, 0.5)[5]
    assert quality.measure("a | b | c | d | e | f | g\n" * 20, 0.5)[6] is False


def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def secret_texts(spark):
    rng = random.Random(6)
    plain = "the ordinary words of a longer text with some internationalisation and responsibilities_of_users"
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    base62 = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(32))
    texts = [
        plain, f"{plain} password={hexes[:18]} end", f"é😀 TOKEN : '{hexes}' x", f"AKIA{'AB12' * 4} {hexes}", f"see {base62} there",
        "password = short", "api_key=api_key=abcdefgh", "ſecret=abcdefghij Token=abcdefgh.", "4917085256960696", None, "", hexes * 40,
        "secret: " * 50, f"a{hexes}g",
    ]
    texts += [f"{plain} {k} token={''.join(rng.choice('0123456789abcdef') for _ in range(20))}" for k in range(30)]
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string"), base62


def test_tokens_that_reach_beyond_a_base_span(spark):
    """A random token with a run of hex in it is a span as a whole; the base span stays, and nothing of it is left."""
    rng = random.Random(41)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    token = f"{word(30)}Z{hexes}Z{word(30)}"
    rows = [(k, f"password={word(24)} id {word(32)} and some_plain_identifier_name") for k in range(200)] + [(999, f"key {token} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.fit(docs)
    base, spans = secrets.all_spans(rows[-1][1], model)
    assert base == [(35, 2, 75)] and spans == [(4, 3, 4 + len(token)), (35, 2, 75)]
    masked = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert masked[999] == "key [SECRET] end"
    started = time.process_time()
    long = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30_000))
    assert len(secrets.all_spans(long, model)[0]) == 30_000 and time.process_time() - started < 10


def test_secret_spans(spark, empty):
    docs, base62 = secret_texts(spark)
    table = secrets.fit(docs)
    found = {r.doc_id: r for r in secrets.scan(docs, table).collect()}
    for doc in docs.collect():
        text, r = doc.text or "", found[doc.doc_id]
        base = brute_spans(text)
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert found[4].spans == "markov:4:36"
    assert all(found[k].spans == "" for k in (0, 5, 8, 9, 10))
    masked = {r.doc_id: r.text for r in secrets.redact(docs, table).collect()}
    assert masked[4] == "see [SECRET] there" and masked[0] == docs.first().text and masked[9] is None
    none = secrets.fit(empty)
    assert secrets.scan(empty, none).count() == 0 and secrets.redact(empty, none).count() == 0


def test_secrets_behind_equals_signs_and_between_dots(spark):
    """Env lines, URL parameters and the parts of a JWT are judged; names and paths stay."""
    docs, _ = secret_texts(spark)
    model = secrets.fit(docs)
    value, other = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzEXAMq9Lk2Z", "9fQ2xLk81ZpTtR7uVwYb"
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"
    parts = ["q7Rz4TbW9xKc2LmV8nPd", "Hj5Gt3Yw6QsZx1Nv7BkM", jwt.split(".")[2]]
    assert secrets.CANDIDATE.findall(f"Bearer {jwt}") == jwt.split(".")  # each is judged
    for text, hidden in (
        (f"AWS_SECRET_ACCESS_KEY={value}", [value]), (f"export client_key={other}\n", [other]),
        (f"https://x.example/a?sig={value}&page=2", [value]), (f"client_key={value}==", [value]),
        (f"Authorization: Bearer {'.'.join(parts)}", parts), (f"{other}=on", [other]),
    ):
        found = [text[a:b].rstrip("=") for a, _, b in secrets.all_spans(text, model)[1]]
        assert found == list(hidden), text
    masked = secrets.redact(spark.createDataFrame([(1, f"client_key={other} {'.'.join(parts)}")], "doc_id long, text string"), model)
    assert masked.first().text == "client_key=[SECRET] [SECRET].[SECRET].[SECRET]"
    for text in ("responsibilities_of_users=internationalisation", "see www.responsibilities-of-users.example for more"):
        assert secrets.all_spans(text, model)[1] == []


def test_language_of_held_out_texts(spark, empty):
    rng = random.Random(8)
    kinds = {"aa": "the of and ing er".split(), "bb": "der und ein sch keit".split(), "cc": "que los ción mente".split()}
    rows = []
    for k in range(240):
        name = sorted(kinds)[k % 3]
        text = " ".join("".join(rng.choice(kinds[name]) for _ in range(rng.randint(1, 3))) for _ in range(20))
        rows.append((k, text, name, "x"))
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 34 !", None, "x"), (903, "the of and", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = {r.doc_id: r for r in langid.detect(docs).collect()}
    assert len(found) == len(rows)
    for k, text, name, _ in rows:
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= found[k].score <= 1
        if k < 900:
            assert found[k].lang_pred == name
    assert [found[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(240), 903}
    assert langid.detect(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    assert {r.lang_pred for r in langid.detect(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_long_text_scores_as_its_parts_together(monkeypatch):
    matrix = np.random.default_rng(0).normal(size=(1 << langid.BUCKET_BITS, 3)).astype(np.float32)
    texts = ["abc déf" * 50, "", "x", "hello world " * 30]
    want = [langid.bucket_counts(t) @ matrix.astype(np.float64) for t in texts]
    for size in (1 << 19, 17):
        monkeypatch.setattr(langid, "CHUNK_CHARS", size)
        assert np.allclose(langid._log_likelihoods(texts, matrix), want, atol=1e-3)


def toxic_rows():
    rng = random.Random(11)
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(600):
        text = [word() for _ in range(rng.randint(30, 80))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(5):
                text[rng.randrange(len(text))] = rng.choice(["grrx", "frotz"]) + rng.choice(syllables)
        docs.append((k, " ".join(text), "x"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_texts(spark, empty):
    docs, labels = toxic_rows()
    toxic = {k for k, _, t in labels if t}
    docs += [(900, None, "x"), (901, "", "x"), (902, "12 !", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(frame, marks).collect()}
    assert len(found) == len(docs)
    held = [r for k, r in found.items() if r.held_out and k < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.values())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    right = sum(r.predicted == (r.doc_id in toxic) for r in held)
    assert right >= 0.95 * len(held) and len(held) > 100
    assert found[900].score == found[901].score
    assert toxicity.score(empty, marks).count() == 0
    unlabelled = toxicity.score(frame, marks.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.0}


def test_toxicity_counts_all_rows_outside_the_calibration_sample(spark, monkeypatch):
    """Every labelled row that is not held out is counted or calibrated on, and none is both."""
    docs, labels = toxic_rows()
    counted, real, fitted, fit = [], toxicity.count_words, [], toxicity.logistic
    monkeypatch.setattr(toxicity, "count_words", lambda rows: counted.append(rows.count()) or real(rows))
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: fitted.append(len(y)) or fit(x, y))
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.score(frame, marks, calibration_rows=60).count() == len(docs)
    parts = Counter(zlib.crc32(str(k).encode()) % 4 for k, _, _ in docs)
    assert counted[0] + fitted[0] == len(docs) - parts[2]
    assert 30 < fitted[0] < 90 < parts[3]


def test_backoff_probabilities_sum_to_one(spark):
    """The ratios come from proper distributions: over all next characters both models sum to 1."""
    words = spark.createDataFrame([("abab", 3, 1), ("abba", 0, 2), ("bab", 1, 1)], "word string, toxic long, ordinary long")
    grams, contexts = toxicity.sequence_table(words, order=3)
    ratios = {r.gram: r.ratio for r in grams.collect()}
    unseen = {r.context: r.ratio for r in contexts.collect()}
    assert all(np.isfinite(v) for v in [*ratios.values(), *unseen.values()])
    assert {g[:2] for g in ratios} == set(unseen)
    assert ratios["aba"] > ratios["abb"]  # one class alone has seen abb


def test_every_sequence_keeps_its_ratio(spark):
    """More sequences than 2^21, the size that the table once had: each is found, and an unseen one is not."""
    many = spark.range(2_500_000).select(F.concat(F.lit("q"), F.conv("id", 10, 36)).alias("gram"), (F.col("id") % 1000 / 8).alias("ratio"))
    table = toxicity._packed(many, "gram")
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def name(k):
        found = ""
        while k or not found:
            k, last = divmod(k, 36)
            found = digits[last] + found
        return f"q{found}"

    assert len(table[0]) + len(table[2]) == 2_500_000
    for k in random.Random(2).sample(range(2_500_000), 5000):
        assert toxicity.Scorer._lookup(table, name(k)) == k % 1000 / 8
    assert toxicity.Scorer._lookup(table, "never") is None


def test_sequences_that_share_a_hash_keep_their_own_ratio(monkeypatch, spark):
    rows = spark.createDataFrame([("ab", 1.5), ("cd", -2.5), ("ef", 0.25)], "gram string, ratio double")
    monkeypatch.setattr(toxicity.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    hashes, _, shared = table = toxicity._packed(rows, "gram")
    assert len(hashes) == 0 and shared == {"ab": 1.5, "cd": -2.5, "ef": 0.25}
    assert [toxicity.Scorer._lookup(table, k) for k in ("ab", "cd", "ef", "gh")] == [1.5, -2.5, 0.25, None]
