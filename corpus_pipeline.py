"""The corpus pipeline: five operators of ``framesift.llm`` in a row, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. quality classifier: documents whose chance of the best grade is under a half go (rated from the table labels);
2. quality rules: documents that fail the base rules, or that the label model holds bad, go;
3. SimHash near-dedup, verified on five-word shingles: of each group of near copies the one with the smallest doc_id stays;
4. mixing: the sources to target weights, so documents come up to twice or not at all;
5. byte-level BPE: token ids of every copy, and their decoding back.

An empty table passes through all stages as an empty table. SQL can express neither the fitted models nor the
fingerprints, so there is no oracle: ``tests/llm/test_pipeline.py`` holds the rows of every stage against a plain version,
and ``tests/llm/test_near_copies.py`` the near-dedup against brute force at the border of similarity.

Extra columns come through the first four stages as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framesift.llm import bpe, mix, neardup, ordinal, queries, rules
from framesift.plans.staging import shared_path

#: Near copies here have five-word shingles with similarity 0.8 or more, which is verified on the shingles themselves.
#: What is compared is proposed by three fingerprints of word pairs, of which an edit changes fewer bits (at most RADIUS
#: in one and at most TOTAL over all three), and by bands of min-hashes for what lies beyond (``framesift.llm.shingles``).
WIDTH, SEEDS, RADIUS, TOTAL = 2, (42, 43, 44), 5, 25


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose chance of the best grade is a half or more. Null and empty texts are scored as empty ones, repeated rows each;
    without ratings all rows stay."""
    return ordinal.select_good(docs, queries.read(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are good with posterior a half or more. Null, empty and short texts fail the base
    rules; repeated rows are judged alike. The model is fitted on the rows given."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; of repeated rows one. Texts without words are equal to
    each other; unlike texts under one id are different documents; rows without an id stay."""
    return neardup.drop_near_duplicates(docs, WIDTH, SEEDS, RADIUS, TOTAL)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes. A null source is a source; rows without words are taken with the queue around
    them; a source without any words gives none."""
    return mix.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the bytes read back; null and empty texts have no tokens."""
    # executors come here with full heaps from the joins before
    return bpe.digest_documents(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern(), bpe.SMALL)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("bpe encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between two stages the rows are written to the shared folder and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
