"""Search over vectors and extraction over pages, the registered queries and the pipeline."""

import os
import random
import time

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import pytest
from flowgraph_spark.llm import html_extract, topk
from flowgraph_spark.llm.queries import QUERIES
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def brute_top(rows, k):
    codes = [
        (i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = set()
    for query, q in codes:
        if query % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in codes if i != query and len(v) == len(q)]
            found |= {(query, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return found


@pytest.mark.parametrize("scale", (1.0, 1e6))
def test_top_k_equals_brute_force(spark, scale):
    rng = random.Random(2)
    rows = [(k, [scale * rng.choice([-1.5, -0.3, 0.0, 0.25, 0.7]) for _ in range(4)]) for k in range(230)]
    rows += [(1000, None), (1050, [1.0, None, 2.0, 3.0]), (1100, [float("nan")] * 4), (1150, [float("inf")] * 4)]
    rows += [(1200, [0.1, 0.2]), (1201, [0.5, 0.5]), (None, [1.0] * 4), (1250, [0.5] * 3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.search(frame, F.col("vec_id") % 50 == 0, shard_rows=16, block_rows=3, fan_in=2).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(rows, 5)
    assert len(got) == len(brute_top(rows, 5))


def test_top_k_of_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(frame, F.col("vec_id") % 50 == 0).count() == 0


def test_products_beyond_double_are_exact():
    big = np.array([[2.0**40, 3.0], [-(2.0**41), 1.0]])
    assert topk.products(big, big).tolist() == [[2**80 + 9, -(2**81) + 3], [-(2**81) + 3, 2**82 + 1]]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="top-teaser"><p>Our site of the year {lead}</p></div>
<!-- ad --><div class="ad">Buy &amp; win</div>{body}<div class="comments"><p>First!</p></div>
<form><input value="q"><button>Go</button></form><footer>&copy; site</footer></body></html>"""


def test_top_k_beyond_the_range_of_long(spark):
    """Products out of range are the ends of the range and tie; none ends the job."""
    rows = [(0, [1e150, 0.0]), (50, [-1e150, 1.0]), (3, [1e150, 5.0]), (4, [2.0, 1.0]), (2, [3e150, 0.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    high, low = (1 << 63) - 1, -(1 << 63)
    assert [found[0, k] for k in (1, 2, 3, 4)] == [(2, high), (3, high), (4, high), (50, low)]
    assert [found[50, k][1] for k in (1, 2, 3, 4)] == [low] * 4 and [found[50, k][0] for k in (1, 2, 3, 4)] == [0, 2, 3, 4]


def extracted(spark, pages):
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    return {r.page_id: r for r in html_extract.extract(frame).collect()}


def test_article_without_furniture(spark):
    body = "<article><h1>A  title &amp</h1><p><b>Bold &lt;text<br>goes\n on<p>Next<i>ly</i> one</p><ul><li>x<li>y</ul></article>"
    found = extracted(spark, [(1, "http://a.example/1", PAGE.format(lead="", body=body))])
    assert found[1].text == "A title & Bold <text goes on Nextly one x y"
    assert found[1].n_chars == len(found[1].text)


def test_recurring_subtrees_of_a_host_go(spark):
    """Without an article element only recurrence tells the teaser from the text."""
    rng = random.Random(1)
    pages = []
    for k in range(12):
        text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(40))
        pages.append((k, "http://one.example/x", PAGE.format(lead="", body=f"<div class='story'><p>{text}</p></div>")))
        pages.append((100 + k, f"http://h{k}.example/x", PAGE.format(lead="", body=f"<div><p>{text} {k}</p></div>")))
    found = extracted(spark, pages)
    for k, _, html in pages:
        teaser = "Our site of the year" in found[k].text
        assert teaser == (k >= 100)
        assert html.split("<p>")[2].split("</p>")[0] in found[k].text


def test_repeated_sentences_of_articles_stay(spark):
    body = "<article><p>The same closing sentence.</p><p>Own text {}</p></article>"
    found = extracted(spark, [(k, "http://a.example/", PAGE.format(lead="", body=body.format(k))) for k in range(9)])
    assert all(found[k].text == f"The same closing sentence. Own text {k}" for k in range(9))


def test_notices_of_most_articles_of_a_host_go(spark):
    body = (
        "<article><p>Read our <b>terms</b> now.</p><ul><li>Follow us</ul><div><span>Members only</span></div>"
        "<p>Own <b>terms</b> {0}</p>{1}<table><tr><td>yes<td>{0}</table></article>"
    )
    quote = "<p>A quoted sentence.</p>"
    pages = [(k, "http://a.example/", PAGE.format(lead="", body=body.format(f"{k} of many more words to read", quote * (k % 3 == 0)))) for k in range(24)]
    found = extracted(spark, pages)
    for k in range(24):
        own = f"{k} of many more words to read"
        assert found[k].text == f"Own terms {own}" + " A quoted sentence." * (k % 3 == 0) + f" yes {own}"


def test_no_paragraph_goes_by_a_shared_bit(spark):
    common = "".join(f"<p>Line {k} of all pages</p>" for k in range(600))
    pages = [(k, "http://a.example/", common + "".join(f"<p>own {k} {j}</p>" for j in range(30)), "x") for k in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    for r in html_extract.extract(frame, table_bits=1 << 15).collect():
        assert r.text == " ".join(f"own {r.page_id} {j}" for j in range(30))


def test_cascade_tells_all_keys_apart(spark):
    keys = spark.range(60_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("key"), "id").collect()
    frame = spark.createDataFrame(keys)
    levels = html_extract.cascade(frame.where("id < 9000").select("key"), frame.select("key"), 1 << 15)
    assert len(levels) > 2
    assert html_extract.cascade_has(levels, [r.key for r in keys]).tolist() == [r.id < 9000 for r in keys]


def test_odd_pages(spark):
    pages = [
        (1, None, None), (2, "", ""), (3, "http://[bad", "<p>unclosed <b>x"), (4, "x", "plain text &eacute;"),
        (5, "x", "<article>a</article><p>not main</p><article>b</article>"), (6, "x", "</p></div><div><p>x</div>y"),
        (7, "x", "<p a=\"1>2\">q</p><!-- open <p>z"), (8, "x", "<div>" * 3000 + "deep" + "</div>" * 3000), (4, "x", "plain text &eacute;"),
    ]
    found = extracted(spark, pages)
    texts = {k: found[k].text for k in found}
    assert texts == {1: "", 2: "", 3: "unclosed x", 4: "plain text é", 5: "a b", 6: "x y", 7: "q", 8: "deep"}


def test_templates_equal_a_plain_count(spark):
    """Keys that are template, recounted per host in plain Python; the text changes without the counts."""
    rng = random.Random(30)
    menu = "<div id=x>Home and more</div>"
    pages = []
    for k in range(60):
        host = ("a.example", "b.example")[k % 2] if k < 56 else f"lone{k}.example"
        story = f"<p>Story {k} {rng.random()}</p>" + ("<section><p>Said on every page.</p></section>" if k % 3 else "")
        story = f"<article>{story}</article>" if k % 2 else f"<div>{story}</div>"
        pages.append((k, f"http://{host}:80/{k}", f"{menu if k < 56 else ''}{story}<div>tail {k % 3}</div>"))
    pages += [(60, None, menu), (61, "http://[bad", ""), (62, "http://a.example/n", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    counts, hosts = {}, {}
    for _, url, page in pages:
        host, root = html_extract.host_of(url), html_extract.parse(page or "")
        html_extract.digest(root)
        hosts[host] = hosts.get(host, 0) + 1
        marks = {(host, html_extract.HOST_MARK, True)} if host else set()
        for key in {(host, node.digest, prose) for node, prose in html_extract.candidates(root)} | marks:
            counts[key] = counts.get(key, 0) + 1
    want = {
        html_extract._key(*key) for key, n in counts.items()
        if n >= (10 if key[2] else 3) and n >= 0.01 * hosts[key[0]] and (not key[2] or n > 0.5 * hosts[key[0]])
    }
    found = html_extract.templates(html_extract.template_counts(frame)).collect()
    assert want and {r.key for r in found} == want
    texts = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    whole = {r.page_id: r.text for r in html_extract.extract(frame, min_pages=10**6).collect()}
    assert "Home and more" in whole[0] and "Home and more" not in texts[0]
    assert sum(texts[k] != whole[k] for k in texts) >= 28


def test_text_outside_articles_and_plain_class_words(spark):
    """On a host with pages enough to count, only what recurs goes; a lone page is its article."""
    pages = [(100, "http://lone.example/", "<p>Lead text</p><article><p>Middle</p></article>", "Middle")]
    for k in range(12):
        page = f"<p>Menu of all</p><p>Lead text {k}</p><article><p>Middle {k}</p></article><div><p>Second half {k}</p></div>"
        pages.append((k, "http://site.example/", page, f"Lead text {k} Middle {k} Second half {k}"))
    pages += [
        (200, "http://h1.example/", '<article><section class="notice-board-history"><p>Kept</p></section><div class="ad">x</div><p>End</p></article>', "Kept End"),
        (201, "http://h2.example/", '<article><p>A</p><div class="post-comments">b</div><div class="share-box">c</div><div class="newsletter signup">d</div></article>', "A"),
    ]
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(frame).collect()} == {p[0]: p[3] for p in pages}


HOSTILE = {
    "open blocks": "<div>x" * 170_000, "no end": "<a b " * 200_000, "quotes": '<a "b" ' * 150_000 + '">"', "odd quotes": "<a \"" * 250_000,
    "lists": "<ul><li>" * 120_000, "items": "<li><b>" * 140_000, "paragraphs": "<p><b>" * 160_000, "comments": "<!--" * 250_000,
    "scripts": "<script>" * 120_000, "declarations": "<!x " * 250_000, "mixed": "<a b 'c>d' " * 100_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_a_megabyte_of_broken_markup_takes_seconds(name):
    started = time.process_time()
    root = html_extract.parse(HOSTILE[name])
    html_extract.digest(root)
    html_extract.candidates(root)
    html_extract.main_text(root, lambda node, inside: False)
    assert time.process_time() - started < 12


def test_pages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extract.extract(empty).count() == 0


def test_every_query_is_registered():
    names = entry.queries()
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and set(QUERIES) <= set(names)
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_rows(spark, name):
    table = "embeddings" if "top_k" in name else "pages" if "html" in name else "documents"
    count = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    if "conversation" in name:
        count = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id").distinct().count()
    rows = entry.queries()[name](spark, SF_DIR).count()
    assert rows == (5 * -(-count // 50) if "top_k" in name else rows)
    assert rows >= count if "packing" in name else rows == count or "top_k" in name


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ba be do ka lu mi no".split()) for _ in range(rng.randint(1, 4)))
    clean = ["\n".join(" ".join(word() for _ in range(40)) for _ in range(4)) for _ in range(40)]
    rows = [(k, t, "aa", "s", len(t)) for k, t in enumerate(clean)]
    changed = clean[3].split(" ")
    changed[80] = "new"
    rows += [
        (100, clean[0], "aa", "s", 0), (101, " ".join(changed).replace("\n", " "), "aa", "s", 0), (102, "1234 !!", "aa", "s", 0),
        (103, None, "aa", "s", 0), (104, f"{clean[5][:200]} zz password=0123456789abcdef00\n{clean[6].splitlines()[0]}", "aa", "s", 0),
        (105, clean[3].replace("\n", " "), "aa", "s", 0),
    ]
    folder = os.path.join(tmp_path, "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder)
    docs, seen = spark.read.parquet(folder), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        out = os.path.join(tmp_path, name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {102, 103}.isdisjoint(seen["language_id"]) and set(range(40)) <= set(seen["language_id"])
    lines = seen["line_dedup"]
    assert 100 not in lines and all(lines[k].text == clean[k] for k in range(40))
    assert lines[104].text.count("\n") == 0 and lines[104].n_chars == len(lines[104].text)
    assert set(seen["ngram_jaccard_join"]) == {*range(40), 104}
    assert "[SECRET]" in seen["secret_scans"][104].text and "0123456789abcdef" not in seen["secret_scans"][104].text
    assert set(seen["best_fit_packing"]) == {*range(40), 104}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {*range(40), 104}
