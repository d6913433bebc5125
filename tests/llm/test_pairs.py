"""Similarity joins, line classes and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from flowgraph_spark.llm import line_dedup, linking, ngram_join
from flowgraph_spark.llm.components import connect
from pyspark.sql import functions as F


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (200, 201)]
    links += [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(20)]
    rng.shuffle(links)
    found = connect(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = closure({x for pair in real for x in pair}, real)
    assert {r.id: r.component for r in found} == want and len(found) == len(want)


def test_components_without_links(spark):
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    found = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def jaccard_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [
        (a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :]
        if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return {i: (len(s),) for i, s in sets}, closure({i for i, _ in rows}, links)


def test_ngram_join_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sizes, want = jaccard_components(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(documents).collect()}
    assert found == {i: (*sizes[i], want[i]) for i, _ in rows}
    assert sum(i != c for i, c in want.items()) >= 8


def test_ngram_join_of_chains_repeats_and_nulls(spark):
    """Near copies that link through others only, a repeated row, two texts of one id, a null id."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows, current = [], list(base)
    for k in range(12):
        rows.append((50 - k, " ".join(current)))
        current = current[5:] + [f"v{k}x{j}" for j in range(5)]
    rows += [rows[0], (3, "same words here for both of them"), (3, rows[4][1]), (None, rows[0][1]), (4, "same words here for both of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.classes(docs).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id is not None} == {3}
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_ngram_join_of_contained_texts_of_unequal_size(spark):
    """Texts inside longer ones, whose shared shingles can lie behind the longer one's short lists."""
    rng = random.Random(14)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(300):
        inner = text(84)
        rows.append((2 * k, " ".join(inner)))
        rows.append((2 * k + 1, " ".join(inner + text((26, 24, 20, 17)[k % 4]))))
    for k in range(30):  # three sizes that contain each other, with a leader and a pivot in common
        inner, more = text(84), text(22)
        rows += [(1000 + 3 * k, " ".join(inner)), (1001 + 3 * k, " ".join(inner + more[:11])), (1002 + 3 * k, " ".join(inner + more))]
    sizes, want = {}, {}
    for low, high in [(2 * k, 2) for k in range(300)] + [(1000 + 3 * k, 3) for k in range(30)]:
        own_sizes, own = jaccard_components([r for r in rows if low <= r[0] < low + high])
        sizes.update(own_sizes)
        want.update(own)
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (*sizes[i], want[i]) for i, _ in rows}
    assert 200 < sum(i != c for i, c in want.items())


def test_ngram_join_bound_holds_for_any_order():
    """No pair that links is refused, wherever the shared shingles fall in the order of both sets."""
    rng = random.Random(15)
    listed = lambda s: sorted(s)[: len(s) - -(-75 * len(s) // 100) + 1]
    links = 0
    for _ in range(4000):
        both = rng.sample(range(1000), rng.randrange(5, 120))
        other = rng.sample(range(1000), rng.randrange(0, 40))
        cut = rng.randrange(len(other) + 1) if rng.random() < 0.5 else 0
        a, b = {*both, *other[:cut]}, {*both, *other[cut:]}
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        links += 1
        shared = {*listed(a)} & {*listed(b)}
        r, s = (len(x) - len({*listed(x)} - shared) for x in (a, b))
        assert shared and ngram_join.admissible(len(a), r, len(b), s)
    assert links > 1000


def test_ngram_join_of_empty_table(empty):
    assert ngram_join.classes(empty).count() == 0


def test_cross_pairs_in_blocks_lose_nothing(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), k, 10 + k % 4, rng.randrange(6)) for k in range(120)]
    frame = spark.createDataFrame(rows, "key long, id long, size int, component long").withColumn("reach", F.col("size"))
    fits = lambda n, r, m, s: (n - m <= 1) & (m - n <= 1)
    payload = frame.select("id", "size", F.lit("x").alias("payload"))

    class All:
        """Lets every pair pass; defined here, so that tasks need not import it."""

        def prepare(self, column):
            return column

        def passes(self, ready, sizes, left, right):
            return np.ones(len(left), bool)

    open_keys = linking._open_keys(frame)
    got = linking._cross_pairs(frame, open_keys, payload, fits, All(), False, block_rows=7).collect()
    want = {
        (min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows
        if a[0] == b[0] and a[3] != b[3] and a[1] != b[1] and abs(a[2] - b[2]) <= 1
    }
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    # Of the same pairs those that join components: they join the same ones, with fewer pairs than rows.
    few = linking._cross_pairs(frame, open_keys, payload, fits, All(), True, block_rows=2048).collect()
    owner = {k: c for _, k, _, c in rows}
    joined = lambda pairs: closure(range(6), [(owner[a], owner[b]) for a, b in pairs])
    assert {(r.a, r.b) for r in few} <= want and joined([(r.a, r.b) for r in few]) == joined(want)
    assert len(few) < len(rows)


def edits_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def test_line_dedup_of_a_segment_that_many_lines_share(spark):
    """5,000 lines with one segment in common and three or more edits apart, and a few near ones among them."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "all of these lines begin alike "
    lines = set()
    while len(lines) < 5000:
        code = "".join(rng.choice(letters) for _ in range(5))
        # Every letter stands three times, so two codes differ in three places at least.
        lines.add(base + "".join(3 * c for c in code))
    lines = sorted(lines)
    rng.shuffle(lines)
    assert min(edits_apart(lines[0], other) for other in lines[1:400]) >= 3
    near = [lines[k][:-1] + "#" for k in range(0, 100, 10)]
    rows = [(k, line) for k, line in enumerate(lines + near)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.n_removed for r in line_dedup.summarise(frame).collect()}
    assert {k for k, n in got.items() if n} == set(range(5000, 5010))


def test_parity_sketches_refuse_no_link():
    """The sketches of two sets differ in no more bits than the sets in shingles, at every size."""
    rng = np.random.default_rng(2)
    links = refused = 0
    for _ in range(3000):
        size = int(rng.integers(1, 1500))
        base = rng.integers(-(1 << 62), 1 << 62, size)
        keep = base[rng.random(size) > rng.choice([0.02, 0.1, 0.3])]
        other = np.unique(np.concatenate([keep, rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, size // 4 + 2)))]))
        base = np.unique(base)
        one, two = ngram_join.sketch(base), ngram_join.sketch(other)
        both = len(np.intersect1d(base, other))
        link = len(other) and 100 * both >= 75 * (len(base) + len(other) - both)
        fits = ngram_join.may_link(len(base), one, len(other), two)
        ready = ngram_join.Sketches()
        column = pa.array([one, two], pa.binary())
        in_block = ready.passes(ready.prepare(column), np.array([len(base), len(other)]), np.array([0]), np.array([1]))[0]
        assert not link or (fits and in_block)
        links += bool(link)
        refused += not link and not fits
    assert links > 500 and refused > 500


def test_shared_rows_across_batch_borders(spark):
    """An indexed row stays with its key, whatever rows of the same item stand between it and the next one."""
    rows = [(1, 5, 30, True)] + [(1, 5, 30, False)] * 7 + [(1, 6, 30, False), (1, 7, 31, False)]
    rows += [(2, 8, 20, True)] + [(2, 8, 20, False)] * 9 + [(3, 9, 20, False), (3, 10, 20, False)]
    rows += [(4, 11, size, True) for size in (7, 8, 9)] + [(4, 12, 9, True)]
    frame = spark.createDataFrame(rows, "key long, id long, size int, indexed boolean")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for size in (1, 2, 3, 10_000):
            spark.conf.set(setting, str(size))
            found = {tuple(r) for r in linking.shared_rows(frame, needs_index=True).collect()}
            assert found == {(1, 5, 30), (1, 6, 30), (1, 7, 31), (4, 11, 7), (4, 11, 8), (4, 11, 9), (4, 12, 9)}, size
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip_equals_set_intersection(seed):
    rng = random.Random(seed)
    query = sorted(rng.sample(range(400), 60))
    members = [
        sorted({*rng.sample(query, rng.randrange(30, 60)), *rng.sample(range(400), rng.randrange(1, 25))})
        for _ in range(30)
    ]
    got = ngram_join.divide_skip(np.array(query), [np.array(m) for m in members])
    want = [k for k, m in enumerate(members) if 100 * len({*query} & {*m}) >= 75 * len({*query} | {*m})]
    assert sorted(got) == want


def test_keep_one_keeps_the_smallest_id_and_all_columns(documents):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sizes, want = jaccard_components(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if want[i] == i)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def edited(rng, text, count):
    chars = list(text)
    for _ in range(count):
        place = rng.randrange(len(chars) + 1)
        chars[place : place + rng.randrange(2)] = rng.choice(["", "a", "b"])
    return "".join(chars)


@pytest.mark.parametrize("edits", (0, 1, 2, 3))
def test_band_automaton_and_segments(edits):
    rng = random.Random(edits)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        b = edited(rng, a, rng.randrange(5))
        near = distance(a, b) <= edits
        assert line_dedup.within(a, b, edits) == near
        short, long = sorted((a, b), key=len)
        if near and len(short) > edits:
            own = {(len(short), k, short[s : s + n]) for k, (s, n) in enumerate(line_dedup.segments(len(short), edits))}
            probes = {(of, k, long[s : s + n]) for of, k, s, n in line_dedup.probe_places(len(long), edits)}
            assert own & probes


def brute_lines(rows):
    seen = [(i, n, line) for i, t in rows for n, line in line_dedup.lines_of(t or "")]
    lines = sorted({line for _, _, line in seen})
    number = {line: k for k, line in enumerate(lines)}
    links = [
        (a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))
        if abs(len(lines[a]) - len(lines[b])) <= 2 and distance(lines[a], lines[b]) <= 2
    ]
    component = closure(range(len(lines)), links)
    first = {}
    for i, n, line in sorted(seen):
        first.setdefault(component[number[line]], (i, n))
    gone = {(i, n) for i, n, line in seen if first[component[number[line]]] != (i, n)}
    return {
        i: "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone) if t is not None else None
        for i, t in rows
    }


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    stock = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(18, 40))) for _ in range(30)]
    rows = []
    for k in range(60):
        lines = [edited(rng, rng.choice(stock), rng.choice((0, 0, 1, 2, 3))) for _ in range(rng.randrange(6))]
        rows.append((k, "\n".join(lines), "note"))
    rows += [(100, None, None), (101, "", "x"), (102, "\n\n", "x"), (103, "short\nshort", "x"), (104, f"  {stock[0]} ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    cleaned = line_dedup.remove_lines(docs)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == brute_lines([r[:2] for r in rows])
    summary = {r.doc_id: r for r in line_dedup.summarise(docs).collect()}
    assert len(summary) == len(rows) and summary[100].n_lines == 0 and summary[103].n_removed == 0


def test_line_dedup_of_repeated_rows_null_ids_and_no_rows(spark, empty):
    line = "this very line stands in many places"
    rows = [(1, line), (1, line), (None, line), (2, f"{line}\nother text that is only here"), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in line_dedup.remove_lines(docs, drop_empty=True).collect()))
    assert kept == [(0, line), (1, line), (1, line), (2, "other text that is only here")]
    assert line_dedup.remove_lines(empty).count() == 0
