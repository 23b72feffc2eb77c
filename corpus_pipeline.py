"""A corpus pipeline: each stage applies one corpus operator to all that its predecessor kept.

``STAGES`` lists (name, function) pairs.  A function takes (spark, docs, sf_dir)
and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of their ``docs``.

1. language ID: documents that it rejects go;
2. SimHash near-dedup: one row of each group stays, the one with the least doc_id, and of repeated rows one;
3. benchmark decontamination: documents that hold passages of two or more benchmark items go, and the words of a
   single item's passage are cut out of the document that holds them;
4. mixing: a document holds the words that the mix takes, repeats included; untaken ones go;
5. token ids: what is left is written as ORC token files, and each document's entry is read back.

Defined cases: null and empty texts, and texts without a letter, go in stage 1; very long texts are read whole; of
repeated rows one stays in stage 2, and rows without doc_id are documents like any other; without benchmark items
stage 3 keeps all; an empty table gives an empty result; extra columns, whatever their names, are kept up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fmindex, langid, mixing, simhash, tokenfile
from quarry.llm.shared import free_name, materialize, quoted, release
from quarry.llm.tables import table


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` whose ``n_chars`` follow their texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "language")
    found = langid.identify(docs, langid.fit(docs), name)
    return found.where(~F.col(f"{name}.rejected")).select(*[F.col(quoted(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "benchmark")
    found = fmindex.find_phrases(docs, table(spark, sf_dir, "benchmark"), name)
    return _measured(fmindex.remove_spans(found.where(~fmindex.contaminated(name)), name))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.mixed_documents(docs))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token-ID output", write_token_files),
]

#: Trained embeddings, XXH64 and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            release(before)  # the stage before, which nothing reads any more
        before = docs
    return docs
