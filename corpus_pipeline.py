"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Every stage takes all rows that the one before kept; each result is written as Parquet and
read again. All but the last return the columns of documents.

Edge cases: a null or empty text has too few words and goes with the quality rules; rows of one
doc_id are judged each by the stages, only as near duplicates they are one document; a null doc_id is linked
with nothing and stays null; a document of which line dedup leaves no word goes, as all of it
stands elsewhere; an empty table gives no rows; further columns pass all stages but the
last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.llm import bpe, decontaminate, line_dedup, minhash_forest, quality_rules
from quartzfolio.llm.common import table, written
from quartzfolio.llm.queries import RANKS

#: The similarity of word shingles from which the pipeline links documents (op6's contract has 85).
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that occur elsewhere before; n_chars follows the text. What is emptied goes."""
    # Written, as a filter that is pushed below the steps of line dedup would hold a copy of each for every place that names it.
    cut = written(line_dedup.rows(docs), "cut_lines")
    changed = F.col("n_removed_chunks") > 0
    row = F.col("row").withField("n_chars", F.length("row.text").cast("long")) if "n_chars" in docs.columns else F.col("row")
    left = cut.filter(~changed | F.col("row.text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(F.when(changed, row).otherwise(F.col("row")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links at a similarity of NEAR_PERCENT or more."""
    return minhash_forest.representatives(docs, NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded texts."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]
#: Links, chunk boundaries and merges can't be expressed in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
