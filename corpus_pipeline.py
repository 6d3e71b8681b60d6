"""Corpus pipeline: quality classifier, SimHash near-dedup, PII, mixing, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, which ``run`` writes as Parquet to the shared checkpoint folder and rereads as the
next stage's documents. All but the last stage return the columns of ``documents``.

Nulls, empty and long texts, repeated rows and empty tables have the results that the stages'
operators define; columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from strataplan.llm import common, mixing, packing, pii, quality, simhash


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, common.load(spark, sf_dir, "labels"))


def near_dedup_stage(spark, docs, sf_dir):
    """Of texts near by SimHash of their five-word shingles, or by exact Jaccard >= 0.8 of those, one
    stays, that of smallest id."""
    return simhash.keep_one(docs)


def pii_stage(spark, docs, sf_dir):
    """Personal data and revealing terms are generalised in the text."""
    return pii.sanitise(docs)


def mixing_stage(spark, docs, sf_dir):
    """Sources are cut to their share of four fifths of the tokens, in one epoch."""
    return mixing.mixed_documents(docs, 4, 5)


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, hashes and tokenizer cannot be expressed in SQL; tests/llm/test_pipeline.py holds each stage
#: against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.load(spark, sf_dir, "documents")
    made = common.stored()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if (name, stage) == STAGES[-1]:
            return out
        docs = common.store(out)
        common.sweep(made, docs)
        common.release()  # what the stage's fit took on the driver
