"""The operators over the given tables, one query each, with oracle SQL where SQL can say it."""

import public_tokenizers

from pyspark.sql import functions as F

from . import html_extract, langid, line_dedup, merkle, ngram_join, packing, quality, secrets, sentencepiece_bpe
from . import token_files, topk, toxicity, turns


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _model_text(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def language_id(spark, sf_dir):
    return langid.detect(_table(spark, sf_dir, "documents"))


def best_fit_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.cut_pieces(docs, _model_text("byte_bpe_50k.json")))


def ngram_jaccard_join(spark, sf_dir):
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def toxic_documents(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def quality_rules(spark, sf_dir):
    return quality.assess(_table(spark, sf_dir, "documents"))


def deduplicated_lines(spark, sf_dir):
    return line_dedup.summarise(_table(spark, sf_dir, "documents"))


def secret_scans(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def exact_top_k(spark, sf_dir):
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def sentencepiece_round_trip(spark, sf_dir):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return sentencepiece_bpe.encode_documents(_table(spark, sf_dir, "documents"), model, digests_only=True)


def html_extraction(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def token_id_files(spark, sf_dir):
    folder = token_files.write(_table(spark, sf_dir, "documents"), _model_text("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder)


def conversation_repair(spark, sf_dir):
    return turns.repair(turns.damage(_table(spark, sf_dir, "conversations")))


def merkle_manifest(spark, sf_dir):
    return merkle.build(_table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


_WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

NGRAM_JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN both_ways ON r = a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id
FROM n JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) ON id = doc_id"""

#: The line rules of :mod:`quality` as patterns; the tables are texts without line-end characters but \\n.
_NAVIGATION = r"' [|»›·•>] '"
_ENDED = "'[" + quality.TERMINAL + "][" + quality.CLOSING.replace("'", "''").replace("]", r"\]") + r"\x20\x09-\x0D]*$'"
_BOILERPLATE = "'" + "|".join(quality.BOILERPLATE) + "'"
_ONE_SPACE = r"'[\x20\x09-\x0D]+'"
_SYMBOLS = r"'[#*$%&|<>]'"
QUALITY_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, {_ONE_SPACE}), lambda x: x <> '') AS ws FROM d),
wi AS (SELECT doc_id, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2]) AS win FROM w),
g AS (SELECT doc_id, unnest(win) AS g, unnest(range(1, len(win) + 1)) AS i FROM wi),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
f AS (SELECT *, len(list_filter(string_split_regex(line, {_ONE_SPACE}), lambda x: x <> '')) AS n,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l),
r AS (SELECT doc_id, again AND n > 0 AS dup, n, again
    OR len(regexp_extract_all(line, {_NAVIGATION})) * 4 >= n OR len(regexp_extract_all(line, {_SYMBOLS})) * 5 > n
    OR NOT regexp_matches(line, {_ENDED}) OR (len(line) - len(replace(line, '!', ''))) * 3 > n
    OR (n < 30 AND regexp_matches(lower(line), {_BOILERPLATE})) AS fails FROM f WHERE n > 0),
a AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS left_words FROM r GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS word_chars,
    len(regexp_extract_all(t, {_SYMBOLS})) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(left_words, 0) AS left_words
  FROM w LEFT JOIN a USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_words >= 0.5 * n_words AS kept FROM c"""

TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5"""

def _field_sql(column):
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


_HEAD_SQL = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
#: The remainder of crc32 by 2, bit by bit: SQL has no crc32 function.
_ODD_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: list_reduce(
  [xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) & 1"""
MERKLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_HEAD_SQL} || {_field_sql('text')}) AS leaf,
  CASE WHEN {_ODD_CRC_SQL} = 0 THEN sha256({_HEAD_SQL} || {_field_sql("replace(text, chr(10), '')")}) END AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
nodes(s, level, i, n, h) AS (SELECT s, 0, i, n, leaf FROM o UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY s, level, i // 3, n),
tops(level, i, n, h) AS (SELECT 0, s, (SELECT count(DISTINCT s) FROM o), h FROM nodes WHERE n = 1 UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
heights AS (SELECT s, max(level) AS top FROM nodes GROUP BY s),
k AS (SELECT row_number() OVER () AS k, * FROM o JOIN heights USING (s)),
sides AS (
  SELECT k, x.level, x.i, x.h, x.i < k.i // CAST(pow(3, x.level) AS BIGINT) AS earlier FROM k JOIN nodes x ON x.s = k.s AND x.n > 1
    AND x.i // 3 = k.i // CAST(pow(3, x.level + 1) AS BIGINT) AND x.i <> k.i // CAST(pow(3, x.level) AS BIGINT)
  UNION ALL
  SELECT k, k.top + x.level, x.i, x.h, x.i < k.s // CAST(pow(3, x.level) AS BIGINT) FROM k JOIN tops x ON x.n > 1
    AND x.i // 3 = k.s // CAST(pow(3, x.level + 1) AS BIGINT) AND x.i <> k.s // CAST(pow(3, x.level) AS BIGINT)),
proofs AS (SELECT k, sha256(string_agg(h, '' ORDER BY level, i)) AS proof FROM sides GROUP BY k),
steps AS (SELECT k, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (earlier), '') AS a,
  coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT earlier), '') AS b FROM sides GROUP BY k, level),
whole AS (SELECT h AS root, (SELECT max(level) FROM tops) AS high FROM tops WHERE n = 1),
folds(k, level, last, h) AS (SELECT k, 0, top + high, coalesce(other, leaf) FROM k, whole UNION ALL
  SELECT f.k, f.level + 1, last, sha256(coalesce(a, '') || h || coalesce(b, '')) FROM folds f
  LEFT JOIN steps ON steps.k = f.k AND steps.level = f.level WHERE f.level < last)
SELECT k.doc_id, leaf, x.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM k JOIN nodes x ON x.s = k.s AND x.n = 1 JOIN folds f ON f.k = k.k AND f.level = f.last
LEFT JOIN proofs ON proofs.k = k.k, whole"""

QUERIES = {
    "op1_ngram_jaccard_join": (ngram_jaccard_join, NGRAM_JOIN_SQL),
    "op2_toxicity": (toxic_documents, None),
    "op3_quality_rules": (quality_rules, QUALITY_SQL),
    "op4_line_dedup": (deduplicated_lines, None),
    "op5_secret_scans": (secret_scans, None),
    "op7_exact_top_k": (exact_top_k, TOP_K_SQL),
    "op8_sentencepiece": (sentencepiece_round_trip, None),
    "op9_html_extraction": (html_extraction, None),
    "op6_language_id": (language_id, None),
    "op10_best_fit_packing": (best_fit_packing, None),
    "op11_conversation_repair": (conversation_repair, None),
    "op12_token_id_files": (token_id_files, None),
    "op13_merkle_manifest": (merkle_manifest, MERKLE_SQL),
}
