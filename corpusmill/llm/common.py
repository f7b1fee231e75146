"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import importable, read, shared_path
from corpusmill.sources.tables import written as write_cut

__all__ = ["read", "shared_path", "texts_of", "tune", "write_cut"]

#: Rows and bytes of one Arrow batch that a Python worker holds: texts may be long, so both are small.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so that long texts cannot fill a Python worker; let workers find this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
