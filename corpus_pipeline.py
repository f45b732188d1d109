"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

All stages but the last return the columns of ``documents``:

1. quality rules: documents that fail the base rules or are unlike every language go;
2. language identification: documents without a letter, or whose language is not clear, go; a
   missing ``lang`` is filled in;
3. n-gram Jaccard join: one document of each cluster of near copies stays;
4. personal data: spans are replaced by their kind in brackets;
5. best-fit packing: one row for each piece of a document, placed in a sequence.

What the stages make of odd rows: a null or empty text, and any other of fewer than 50 words, goes in stage 1, so that
later stages of ``run`` don't meet it; met alone, stage 2 drops a text without a letter, stage 3 keeps it, stage 4 leaves it as it is and
stage 5 packs its end token.  Very long texts are judged, scored, compared, masked and packed whole.  Rows whose ``doc_id``,
``lang`` or other columns are null are treated like others; without any labelled row stages 1 and 2 judge by the base rules
alone.  Repeated rows are judged alike, and one of them stays in stage 3.  An empty table gives an empty table.  Extra columns are
kept up to stage 4 as they are, whatever their names: every stage sets aside what it doesn't use.  Ties: the least ``doc_id`` of a cluster stays, else the first row; of
languages equally likely the first by name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixscan.llm import langid, neardup, packing, pii, quality
from helixscan.llm.common import restored, set_aside, written

#: Least mean probability of the predicted language.
CLEAR = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return restored(quality.quality(set_aside(docs, "text", "lang")).where("kept"), docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = set_aside(docs, "doc_id", "text", "lang")
    model = langid.train(langid.training_rows(used))
    if model is None:  # nothing is labelled: no document can be judged
        return docs
    judged = langid.predicted(used, model).where(f"lang_pred != 'und' and score >= {CLEAR}")
    return restored(judged.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return restored(neardup.near_duplicates(set_aside(docs, "doc_id", "text")).where("stays"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counted = [c for c in docs.columns if c == "n_chars"]
    found = pii.personal_data(set_aside(docs, "text", *counted))
    found = found.withColumn("text", pii.masked("text", F.col("found")))
    found = found.withColumns({c: F.length("text").cast(dict(docs.dtypes)[c]) for c in counted})
    return restored(found, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language identification", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The stages train models and pack greedily, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
