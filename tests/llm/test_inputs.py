"""What every operator does with nulls, empty and very long texts, repeated rows, empty tables and columns of any name."""

from collections import Counter

import public_tokenizers
import pytest

from wayfind.llm import byte_bpe, decontaminate, license_scan, lm_scoring, paragraph_dedup, quality_rules, simhash_dedup, suffix_dedup

LONG = "the mit license of word " * 30_000
ROWS = [(None, "x mit license"), (None, "x mit license"), (1, None), (2, ""), (3, " \n\t"), (4, LONG), (4, LONG), (5, "mit license " + "w " * 60), (5, "other text of one id")]
NAMES = ["doc_ids", "part", "bucket", "blob", "kind", "label", "score", "labels", "matches", "fp", "rep", "digest", "n", "block", "vertex", "component", "item_id", "kept", "spans", "_n", "_part"]


def bpe(docs):
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def leaks(docs):
    return decontaminate.contaminated(docs, docs.sparkSession.createDataFrame([(1, "mit license w w w w w w"), (None, None)], "item_id long, text string"))


#: Operators that judge each row by itself, and those that need all rows.
SINGLE = {"1": license_scan.scan, "3": leaks, "4": quality_rules.quality, "8": bpe}
WHOLE = {"5": lm_scoring.score, "7": simhash_dedup.near_duplicates, "9": paragraph_dedup.repeats, "9 windows": paragraph_dedup.windows, "10": suffix_dedup.dedup}


def table(spark, rows, odd=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", *[f"'{i}' as {n}" for i, n in enumerate(NAMES)]) if odd else df


def counted(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("name", [*SINGLE, *WHOLE])
def test_columns_of_any_name_and_empty_tables_change_nothing(spark, name):
    run = (SINGLE | WHOLE)[name]
    plain, odd = table(spark, ROWS), table(spark, ROWS, odd=True)
    assert counted(run(plain)) == counted(run(odd))
    empty = run(odd.limit(0))
    assert empty.count() == 0 and empty.columns == run(plain).columns


@pytest.mark.parametrize("name", SINGLE)
def test_repeated_rows_get_a_row_each(spark, name):
    want = Counter()
    for row, n in Counter(ROWS).items():
        for out, m in counted(SINGLE[name](table(spark, [row]))).items():
            want[out] += n * m
    assert counted(SINGLE[name](table(spark, ROWS))) == want


@pytest.mark.parametrize("name", ["5", "7", "10"])
def test_every_row_has_a_row(spark, name):
    got = Counter(r.doc_id for r in WHOLE[name](table(spark, ROWS)).collect())
    assert got == Counter(d for d, _ in ROWS)
