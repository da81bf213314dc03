"""The corpus pipeline: language, near duplicates, repeated passages, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is to be written as
Parquet and read again as the docs of the next. All but the last return the columns of documents, and no others: further
columns, whatever their names, end in the first stage. Nulls in any column, empty and very long texts, ties and repeated
rows go through every stage; what each makes of them is said there. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.llm import jaccard, language, mixing, packing, suffix
from spindrift.llm.common import materialise, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Bytes are cut out of texts and rows are drawn at random by hashes; SQL cannot say that.
ORACLE_SQL = None


@stage
def language_id(spark, docs, sf_dir):
    """Documents of a language that the models of all labelled documents accept.

    Goes: null texts, texts without a letter, and texts that no model fits within its limit, which is calibrated on rows
    left out of the models. Repeated rows and null ids are judged like others; with no labels nothing is accepted.
    """
    found = language.identify(docs, docs, columns=("text", "lang", "source", "n_chars"))
    return found.where("accepted").select(*COLUMNS)


@stage
def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates, that with the smallest id, a null id last.

    Rows equal in id and text are one document. Texts without words link with nothing and stay, each row of them.
    """
    return jaccard.representatives(docs).select(*COLUMNS)


@stage
def repeated_passages(spark, docs, sf_dir):
    """All documents, without the passages that one with a smaller id holds; n_chars follows.

    A null text becomes an empty one. Rows of one id do not remove from each other; null ids count as the largest.
    """
    cut = suffix.dedup(docs, columns=("lang", "source"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mixture takes them: up to twice, those without words never; a null source is the last source."""
    return mixing.apply(docs).select(*COLUMNS)


@stage
def pack_sequences(spark, docs, sf_dir):
    """Sequences of power-of-two lengths with their ids; rows that repeat a document are documents of their own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
