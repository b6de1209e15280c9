"""A training corpus from documents: toxic documents go, one of each group of near-duplicates stays, documents that hold
benchmark passages go, secrets are masked, and what is left is mixed to the weights of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, mixing, ngram_join, secrets_scan, toxicity
from evigraph.llm.runtime import materialize, table

#: Near-duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more by a model of the labels outside the held-out fold go.

    Null and empty texts score 0 and stay; texts of any length are scored whole; repeated rows score alike. Columns may have
    any other names, and an empty table stays one."""
    weights = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 connect the document with the smallest doc_id stays."""
    return ngram_join.keep_one(docs, n=WORDS, num=NUM, den=DEN)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the text and n_chars follows; every document stays.

    Null and empty texts stay as they are, long texts are read whole, repeated rows are masked alike, columns may have any
    other names, and an empty table stays one."""
    return secrets_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: doc_id, lang, source, n_chars, size, source_size, target, and copies and words taken.

    Null and wordless texts have size 0 and are not in the mix; a null source is one of its own; of an empty table nothing
    comes. Other columns are left behind."""
    sized = docs.select("doc_id", "lang", "source", "n_chars", mixing.text_size(F.col("text")).alias("size"))
    return mixing.mix(sized).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

#: No stage but the last has an SQL form (learned model, prefix tree, forest); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
