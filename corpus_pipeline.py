"""The training-data pipeline: toxic documents go, near-duplicates go, benchmark passages go, personal data is masked, sources are mixed.

Each stage takes (spark, docs, sf_dir), with docs what the stage before kept, and returns a DataFrame that is
written and read again for the next. All but the last return the columns of documents; the last adds copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitemill.llm import decontaminate, mixing, pii, simhash, toxicity
from sitemill.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity field, learnt from the labels of docs, predicts as toxic.

    Null and empty texts are scored like texts without a toxic word and stay null or empty; texts of any length are
    scored whole; repeated rows go or stay alike; where no document has a label outside the held-out fold, all stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links of five-word Jaccard at least 0.8 join; anchors find a link with probability 0.998 or more.

    Null, empty and blank texts are one group; texts of fewer than five words are alike only if their words are the
    same. Repeated rows of an id that stays stay; rows with a null id stay only if a group has no other."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that overlap with a benchmark item in 13 tokens or more (all of an item of 8 to 12), of which 0.8 agree.

    Null and empty texts, and an empty benchmark, overlap with nothing; rows of one id go or stay together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind; every row stays, null texts stay null, n_chars follows the text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, numbered by copy.

    A null source is one of its own; texts without a word have no size, and are taken as often as the others of
    their source; without any word nothing is. Rows of one id, or of none, are taken alike."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
]

#: Learnt models and components of near-duplicates can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents, rows with all columns of documents and copy; of an empty table none.

    What a stage returns is a written table for the next; what it was made from, and the stage's own tables, are
    deleted as soon as it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with Scratch.made() as own:
            out = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = scratch.keep(out, docs)
                for x in own:
                    x.drop()
    return out
