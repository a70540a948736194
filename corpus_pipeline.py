"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.line_dedup import dedup_lines
from quillgate.llm.minhash import keep_one
from quillgate.llm.mixing import mixed_documents
from quillgate.llm.packing import pack_documents
from quillgate.llm.scratch import Scratch, small_batches
from quillgate.llm.toxicity import THRESHOLD, toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not call toxic.

    Rows are judged one by one by their whole texts, so repeated rows stay or go
    together. Null, empty and wordless texts get the score of no evidence. No
    labels for a class: the share of toxic labels decides for all. Columns of
    any names pass unchanged; an empty table gives none.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with small_batches(spark):
        return Scratch(spark, "toxic").put(docs.filter(toxicity(model)(F.col("text")) < THRESHOLD), "kept")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many sites share; ``n_chars`` follows where lines went.

    Null, empty and blank texts stay as they are, as do texts of nothing but
    shared lines; repeated rows are treated alike; texts are cut whole. Other
    columns of any names pass unchanged; an empty table gives none.
    """
    lines, gone = "n_lines of this stage", "n_removed of this stage"
    out = dedup_lines(docs, names=(lines, gone))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    changed = lambda: F.when(F.col(f"`{gone}`") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[changed() if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Null, empty and wordless texts are in no group and stay, as do rows without
    a doc_id; rows that repeat a doc_id are one document and stay or go
    together. Texts are compared whole. Columns of any names pass unchanged; an
    empty table gives none.
    """
    with small_batches(spark):
        return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated where it takes them more than once.

    A null source is one of its own; texts without words count nothing and are
    taken as often as their hash says; rows that repeat a doc_id are taken alike.
    Columns of any names pass unchanged; an empty table gives none.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens.

    Null and empty texts are the end id alone; repeated rows are packed each for
    itself; texts of any length are taken whole; an empty table gives no rows.
    """
    with small_batches(spark):
        return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores and genetic packing are outside SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read back before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.put(out, name)
    return docs
