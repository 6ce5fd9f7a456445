"""A training corpus out of raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes every stage's
rows below ``spark.checkpoint.dir`` and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthaudit.llm import queries as q
from synthaudit.llm.common import read_table, scratch_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejected documents go."""
    from synthaudit.llm.quality import keep_good

    return keep_good(docs, q.quality_model(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the first document of each group stays."""
    from synthaudit.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a passage stays in the first document that has it."""
    from synthaudit.llm.substrings import remove_repeats

    kept = remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold benchmark text go."""
    from synthaudit.llm.decontam import drop_contaminated

    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sequences of 1024 tokens, as pieces of documents."""
    from synthaudit.llm.packing import pack_documents

    return q.packing_digest(pack_documents(docs, q.tokenizer_path()))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("substring dedup", repeated_passages), ("benchmark decontamination", decontaminate), ("packing", packing)]

#: Trained models, 64-bit fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
