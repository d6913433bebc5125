"""Conversation repair, packed token files and the Merkle manifest against plain Python."""

import functools
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from flowgraph_spark.llm import merkle, token_files, turns
from flowgraph_spark.session import checkpoint_dir
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CONVERSATION = "conv_id long, turn long, role string, text string, source string, dropped_by string"


# Conversations


def cheapest(roles, texts):
    """(cost, edits) by trying everything; inserts in a row are at most three."""
    seen, fault = set(), []
    for role, text in zip(roles, texts):
        left = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        kind = "blank" if not left else "duplicate" if (role, text) in seen else "" if left[-1] in ".!?" else "truncated"
        fault.append(kind)
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserts):
        found = [(0, "")] if i == len(roles) and last in ("", "a") else []

        def then(cost, edit, *after):
            rest = best(*after)
            found.append((cost + rest[0], edit + rest[1]))

        if i < len(roles):
            then(3, "D", i + 1, last, 0)
            if fault[i] in ("", "truncated"):
                extra = fault[i] == "truncated"
                initial = roles[i][:1]
                if initial and initial in follows[last]:
                    then(extra, "K", i + 1, initial, 0)
                for made in set(follows[last]) - {"s"}:
                    then(2 + extra, "R", i + 1, made, 0)
        if inserts < 3:
            for made in set(follows[last]) - {"s"}:
                then(2, "I", i, made, inserts + 1)
        return min(found) if found else (10**9, "")

    return best(0, "", 0)


def random_turns(rng, size):
    roles = [rng.choice(["user", "assistant", "system", "tool", " ", "", "user", "assistant"]) for _ in range(size)]
    texts = [rng.choice(["Hi.", "yes", "what?", "", " \t", "ok!", f"x{rng.random()}.", f"y{rng.random()}"]) for _ in range(size)]
    return roles, texts


def test_auction_finds_the_least_of_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(600):
        roles, texts = random_turns(rng, rng.randint(0, 11))
        report, rows = turns.solve([None] * len(roles), roles, texts)
        assert (report["cost"], report["audit"]) == cheapest(roles, texts)
        initials = "".join(role[0] for role, _ in rows)
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_prices_are_dual():
    """No arc is shorter than the fall of the price, and the way found falls by its cost."""
    roles, texts = random_turns(random.Random(4), 40)
    auction = turns.Auction(turns.faults(roles, texts, set()), turns.TAIL_COSTS)
    cost = auction.run(turns.START)
    assert auction.prices[auction.end] == 0 and auction.prices[turns.START] == cost
    for node in range(auction.end):
        assert all(auction.prices[node] <= c + auction.prices[to] for _, to, c in auction.arcs(node) if c < turns.FAR)


def test_parts_of_a_conversation_add_up():
    rng = random.Random(6)
    for _ in range(200):
        roles, texts = random_turns(rng, rng.randint(0, 14))
        codes, cut = turns.faults(roles, texts, set()), rng.randint(0, len(roles))
        first, second = turns.costs_between(codes[:cut]), turns.costs_between(codes[cut:])
        assert turns.joined_costs(first, second) == turns.costs_between(codes)


def damaged(rows):
    """Rows (turn, role, text) after damage of each conversation, in order."""
    found = {}
    for conv_id, turn, role, text, *_ in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        own = found.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in found.values():
        own.sort(key=lambda row: (row[0] is not None, row[0] or 0, *row[1:]))
    return found


@pytest.fixture(scope="module")
def conversations():
    """Ordinary ones, one of 900 turns, nulls in every column, repeated rows, ties and a very long text."""
    rng = random.Random(8)
    rows = []
    for conv_id in range(40):
        rows += [(conv_id, turn, *pair) for turn, pair in enumerate(zip(*random_turns(rng, rng.randint(1, 9))))]
    rows += [(77, turn + (turn > 300), *pair) for turn, pair in enumerate(zip(*random_turns(rng, 900)))]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (78, None, "user", "b."), (78, 5, None, "c"), (78, 5, "user", None)]
    rows += [(79, 3, "user", "same.")] * 5 + [(80, 1, "user", "w " * 200_000 + "."), (80, 2, "assistant", "short.")]
    rows += [(81, k, "user", "hi.") for k in range(400) if zlib.crc32(f"81:{k}".encode()) % 20 == 0]
    return [(*row, "src", "x") for row in rows]


@pytest.mark.parametrize("chunk_rows", (2, 7, 1000))
def test_repair_equals_plain_python(spark, conversations, chunk_rows):
    df = spark.createDataFrame(conversations, CONVERSATION).repartition(5)
    got = turns.repair(turns.damage(df), chunk_rows=chunk_rows).collect()
    want = {
        conv_id: turns.solve(*([list(c) for c in zip(*rows)] if rows else [[], [], []]))[0]
        for conv_id, rows in damaged(conversations).items()
    }
    assert {row["conv_id"]: {c: row[c] for c in turns._REPORT} for row in got} == want and len(got) == len(want)
    empty = hashlib.sha256(b"").hexdigest()
    assert want[81] == dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0) | {"audit": "", "repaired_sha256": empty}


def test_repaired_rows_have_the_digest(spark, conversations):
    df = turns.damage(spark.createDataFrame(conversations, CONVERSATION))
    digests = {row["conv_id"]: row["repaired_sha256"] for row in turns.repair(df, chunk_rows=9).collect()}
    rows = turns.repair(df, keep_rows=True, chunk_rows=9).orderBy("conv_id", "place").collect()
    for conv_id, own in itertools.groupby(rows, key=lambda row: row["conv_id"]):
        text = "\n".join(f"{row['role']}:{row['text']}" for row in own)
        assert hashlib.sha256(text.encode()).hexdigest() == digests[conv_id]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert turns.repair(turns.damage(empty)).count() == 0
    assert turns.repair(empty.select("conv_id", "turn", "role", "text"), keep_rows=True).count() == 0


# Token files


@pytest.mark.parametrize("bits", (1, 7, 13, 16, 17, 32))
def test_packed_ids_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack(data, 1001, bits) == ids).all()


def test_least_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


ODD = [
    "a <|endoftext|> b", "<|ENDOFTEXT|>", "It's DON'T we'LL", "é ́x", "tab\x1cfs\x85nel em", "İSTANBUL ΣΑΣ ς",
    "word,.;? mark!!", "x" * 1_100_000, "12 345", "\x00 nul", "😀 中文 text", "a.b,c", "...", " nbsp ", "'s 's",
]


def plain_ids(model, text):
    return np.array(Tokenizer.from_str(model).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_token_files_equal_the_tokenizer(spark, documents, texts, model, tmp_path):
    docs = documents.select("doc_id", "text", "score", "piece")
    extra = [(2000 + k, text, "x", 1) for k, text in enumerate(ODD)] + [(None, "no id", "x", 1), (None, None, "x", 1)]
    extra += [(3000, "copy one", "x", 1)] * 3
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, score string, piece int"))
    rows = docs.select("doc_id", "text").collect()
    folder = token_files.write(docs, model, 1, folder=str(tmp_path / "ids"), text_bytes_per_file=50_000, block_ids=512)
    got = token_files.read(spark, folder, keep_ids=True, ids_at_once=700).orderBy("start").collect()
    assert len(got) == len(rows)
    order = [row["doc_id"] for row in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    wanted = {}
    for row in rows:
        wanted.setdefault(row["doc_id"], []).append(plain_ids(model, row["text"]).tobytes())
    start, whole = 0, []
    for row in got:
        ids = bytes(row["ids"])
        wanted[row["doc_id"]].remove(ids)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
        whole.append(ids)
    whole = np.frombuffer(b"".join(whole), "<u4")
    for low, high in ((0, 5), (510, 1030), (len(whole) - 3, len(whole) + 9), (7, 7)):
        assert (token_files.span(spark, folder, low, high) == whole[low:high]).all()


def test_random_access_opens_single_blocks(spark, documents, model, tmp_path):
    folder = token_files.write(documents, model, 1, folder=str(tmp_path / "ids"), block_ids=256)
    texts = {row["doc_id"]: row["text"] for row in documents.select("doc_id", "text").collect()}
    seen = 0
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if not name.startswith("part-") or not os.path.getsize(path):
            continue
        one = token_files.Reader(np.memmap(path, np.uint8, "r"))
        assert one.bits == 16
        for place, doc_id in enumerate(one.doc_ids.tolist()):
            ids = one.document(place)
            assert ids[-1] == 1 and len(ids) == one.bounds[place + 1] - one.bounds[place]
            if place % 5 == 0:
                assert (ids == plain_ids(model, texts[doc_id])).all()
            seen += 1
    assert seen == len(texts)


def test_token_files_of_nothing(spark, empty, model):
    folder = token_files.write(empty, model, 1)
    assert token_files.read(spark, folder).count() == 0
    assert token_files.manifest(spark, folder).count() == 0 and len(token_files.span(spark, folder, 0, 9)) == 0


def test_damaged_file_is_refused():
    writer = token_files.Writer(0, 16, 8)
    ids = np.arange(20, dtype="<u4")
    parts = [*writer.open(), *writer.add([1, None], ids, np.array([12, 8])), *writer.close()]
    data = b"".join(part + b"\n" for part in parts)
    one = token_files.Reader(data)
    assert (one.document(1) == ids[12:]).all() and one.null_ids.tolist() == [False, True]
    with pytest.raises(ValueError, match="not whole"):
        token_files.Reader(data[:-40])


# Merkle manifest

MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def manifest(rows):
    """doc_id, leaf, ... and the digests on the way up, by rebuilding level by level."""
    by_source = {}
    for doc_id, source, lang, n_chars, text in rows:
        head = [field(v) for v in (doc_id, source, lang, n_chars)]
        leaf = other = digest(*head, field(text))
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            other = digest(*head, field(text.replace("\n", "")))
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([row[2] for row in sorted(by_source[s], key=lambda r: r[:3])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    found = []
    for number, source in enumerate(sources):
        for place, (_, _, leaf, other, doc_id) in enumerate(sorted(by_source[source], key=lambda r: r[:3])):
            node, siblings, copies = other, [], []
            for tree, k in ((trees[source], place), (top, number)):
                for row in tree[:-1]:
                    run, at = row[k // 3 * 3 : k // 3 * 3 + 3], k % 3
                    siblings += run[:at] + run[at + 1 :]
                    node = digest(*run[:at], node, *run[at + 1 :])
                    copies.append(node)
                    k //= 3
            root = top[-1][0]
            found.append((doc_id, leaf, trees[source][-1][0], root, digest(*siblings), node, node == root, copies))
    return found


@pytest.fixture(scope="module")
def leaves_rows():
    rng = random.Random(12)
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "B", "é", "日本", "z", None]) if k % 7 else f"lone{k}"
        rows.append((k * 7 % 401, source, rng.choice(["en", None]), k, rng.choice(["line\nline", "no feed", "\n", "", None, "é\n😀"])))
    rows += [(None, "hot", "en", 1, "x\ny"), (None, None, None, None, None), (5, "hot", "en", 3, "again")]
    rows += [(9, "hot", "en", 2, "same\nrow")] * 3 + [(1000, "long", "en", 9, "w\n" * 600_000)]
    return rows


@pytest.mark.parametrize("height", (1, 2, 6))
def test_manifest_equals_plain_python(spark, leaves_rows, height):
    rows = [(*row, "clash", 4) for row in leaves_rows]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")
    got = [tuple(row) for row in merkle.build(docs.repartition(3), levels=height).select(*MANIFEST, "copies").collect()]
    assert sorted(got, key=repr) == sorted(manifest(leaves_rows), key=repr)


def test_manifest_of_one_row_and_of_none(spark, empty):
    row = merkle.build(spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == digest() and row["copies"] == []
    assert merkle.build(empty).count() == 0


def test_versions_share_all_other_nodes():
    tree = merkle.PersistentTree([digest(str(k)) for k in range(25)], 3)
    nodes, copies = len(tree.digests), tree.update(tree.base, 13, digest("new"))
    # A leaf and an ancestor per level are new; the base version is as before.
    assert len(tree.digests) == nodes + 4 and len(copies) == 3
    assert levels([digest(str(k)) for k in range(25)])[-1][0] == tree.digests[tree.base]
    changed = [digest("new" if k == 13 else str(k)) for k in range(25)]
    assert levels(changed)[-1][0] == tree.digests[copies[-1]]
    again = tree.update(copies[-1], 2, digest("second"))
    changed[2] = digest("second")
    assert levels(changed)[-1][0] == tree.digests[again[-1]]


def test_operators_leave_only_their_result(spark, leaves_rows, conversations):
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    docs = spark.createDataFrame(leaves_rows, "doc_id long, source string, lang string, n_chars long, text string")
    results = [merkle.build(docs), turns.repair(turns.damage(spark.createDataFrame(conversations, CONVERSATION)), chunk_rows=5)]
    assert len(set(os.listdir(tables)) - before) == len(results)
    assert all(result.agg(F.count(F.lit(1))).first()[0] for result in results)
