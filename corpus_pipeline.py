"""A training corpus from raw documents: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again as the next stage's documents. All but the last return the columns of documents.
Further columns of the documents stay in all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm.base import exists, remove, store_at, table, written_at
from fathom.llm.jaccard import keep_one
from fathom.llm.mixing import mixed
from fathom.llm.packing import pack
from fathom.llm.pii import redact
from fathom.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels, rejects go.

    Null and empty texts score as texts without hits; rows without an id, repeated rows and rows without a label are
    scored like others; without labels of both kinds all documents stay; an empty table stays empty.
    """
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the least id stays.

    Documents without words and rows without an id stay; rows that share an id stay or go together; an empty table
    stays empty.
    """
    return keep_one(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets; n_chars follows.

    A null text stays null; rows equal in id and text get equal texts; an empty table stays empty.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come in the mixed order of their sources' blocks.

    No row is dropped or repeated; a null source is a source of its own; null ids are spread by their rows' hashes;
    an empty table stays empty.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; partitions, and so sequence ids, follow ranges of the mixing slots.

    A reader of Parquet deals files out by size, so the mixed order is made again: slots depend on the rows alone.
    A null or empty text is its end token; rows without an id and repeated rows are documents of their own; an empty
    table gives no pieces.
    """
    import public_tokenizers

    return pack(mixed(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

# SQL can express neither the learnt classifier nor the tokenizer; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The rows of the last stage. With a ``folder``, stages are kept there, and those that a run before has finished are
    not run again; without one, the tables of all but the last are removed once they are read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if folder is not None:
            path = f"{folder.rstrip('/')}/{k}-{name}"
            if not exists(spark, f"{path}/_SUCCESS"):
                store_at(stage(spark, docs, sf_dir), path)
            docs = spark.read.parquet(path)
            continue
        docs, path = written_at(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = path
    return docs
