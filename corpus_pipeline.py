"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, language_id, mixing, near_dup, toxicity
from sparkloom.llm.frames import fresh, table
from sparkloom.llm.store import crc_bucket, materialize

#: Documents that score as much as this are toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the index is learned from the labelled ones.

    Rows are scored on their own, so repeated rows go or stay together and
    null ids stay rows.  A null or empty text, or one without a known word,
    gets the base rate of such examples.  Without labels of both kinds the
    score is the share of toxic ones, or 0 without any.  An empty table gives
    an empty one.  Columns of any name stay as they are.
    """
    index = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_bucket("k", 5) != 0)
    score, why = fresh(docs, "toxicity"), fresh(docs, "toxicity_evidence")
    return toxicity.score(docs, index, name=score, evidence=why).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that a profile tells; those without letters, or as near to two profiles, go.

    A null or empty text has no letter.  With one known language nothing is as
    near to another, so every text with a letter stays; without any language
    in the table nothing can be told and all rows go.  Repeated rows go or
    stay together, null ids and clashing columns stay as they are, and an
    empty table gives an empty one.
    """
    profiles = language_id.learn_profiles(docs)
    pred, score = fresh(docs, "predicted_lang"), fresh(docs, "predicted_score")
    found = language_id.identify(docs, profiles, pred=pred, score=score)
    told = F.col(pred) != language_id.UNKNOWN
    if len(profiles.languages) > 1:
        told &= F.col(score) > 0.5  # a tie of the two nearest
    return found.where(told).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more: that with the smallest id.

    Texts that are null or have no word are in no group and stay.  Where ids
    repeat or are null, rows are numbered, so of rows that are equal one stays.
    An empty table gives an empty one, and clashing columns stay as they are.
    """
    return near_dup.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item: eight of its words in a row, or all of a shorter one.

    Null and wordless texts have none and stay, as everything does with an
    empty benchmark; items without an id count.  Repeated rows go or stay
    together, null ids and clashing columns stay as they are, and an empty
    table gives an empty one.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes.

    One row for each row of ``docs``: repeated rows are documents of their own.
    A null text has size 0 and nothing of it is taken, a null source is a
    source, null ids stay, other columns are not used, and an empty table gives
    an empty one.
    """
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned scores and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
