import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names the
    operators use themselves."""
    from pyspark.sql import functions as F

    def make(rows, parts=3, extra=False):
        df = spark.createDataFrame(rows, DOC).repartition(parts)
        if extra:
            for c in ("part", "fp", "label", "spans", "items", "bucket", "a", "b", "words", "root", "kept_id", "n_words"):
                df = df.withColumn(c, F.lit("own"))
        return df
    return make
