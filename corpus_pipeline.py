"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

quality rules, SimHash near-dedup verified by exact Jaccard, suffix-array dedup, benchmark decontamination, byte-level BPE. All
but the last return the columns of documents; each works on all rows that its predecessor kept.

Columns beside doc_id and text may have any names and values and come through as they are (but n_chars, which is counted again
where a text is cut); the last stage gives its own. Texts of any length are treated whole. An empty table gives an empty
one of the same columns. What nulls, ties and repeated rows lead to is said at each stage.
"""

from pyspark.sql import DataFrame, SparkSession

from wayfind.llm import byte_bpe, decontaminate, quality_rules, simhash_dedup, suffix_dedup
from wayfind.llm.common import drop, release, save, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null, empty and blank texts are among them. Each row is judged by itself: repeated
    rows share a verdict, and a null doc_id changes nothing."""
    small_batches(spark)
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of 0.8 or more) the document with the smallest doc_id stays.
    Null, empty and blank texts are copies of each other. Rows that agree in doc_id and text are one document, of which one
    row stays; of different texts with one doc_id in one group the one whose digest is the smallest stays. Rows with a null
    doc_id come first and all stay, and copies of theirs with a doc_id go."""
    small_batches(spark)
    return simhash_dedup.one_of_each(docs)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes go but for their first copy, by doc_id (null first), digest of the text where a doc_id has
    several, and place; documents that lose all their text go. Null and empty texts stay as they are. Rows that agree in
    doc_id and text are one document, and all get the same cut."""
    small_batches(spark)
    return suffix_dedup.deduped_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is similar to a benchmark item go. Null and empty texts match nothing and stay, and items
    without words match nothing. Each row is judged by itself; a null doc_id changes nothing."""
    small_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, decoded again: counts and digests, a row for each row. A null text is empty and has no ids; a null
    doc_id stays null."""
    small_batches(spark)
    return byte_bpe.op8_byte_bpe(spark, sf_dir, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("string_dedup", string_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: MinHash bands, fingerprints and byte pairs are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's table is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release()
        drop(docs)
        docs = done
    return docs
