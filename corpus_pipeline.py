"""Corpus pipeline: five of the text operators in a row, from documents to packed sequences."""

import public_tokenizers

from flowgraph_spark.llm import langid, line_dedup, ngram_join, packing, secrets
from flowgraph_spark.llm.common import cut_lineage


def identify_language(spark, docs, sf_dir):
    """Drops documents without letters, without text, or of no language the model is sure of."""
    return langid.keep_identified(docs)


def remove_repeated_lines(spark, docs, sf_dir):
    """Removes lines that repeat across documents, and documents with nothing else."""
    return line_dedup.remove_lines(docs, drop_empty=True)


def remove_near_copies(spark, docs, sf_dir):
    """Keeps one document of each group of near copies."""
    return ngram_join.keep_one(docs)


def mask_secrets(spark, docs, sf_dir):
    """Replaces secrets in the texts; no document goes."""
    return secrets.redact(docs, secrets.fit(docs))


def pack_sequences(spark, docs, sf_dir):
    """Packs the tokenized documents; one row per piece."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return packing.pack(packing.cut_pieces(docs, file.read()))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", remove_near_copies),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and edit distances are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
