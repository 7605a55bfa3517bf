"""Page text as it arrives: the batch extraction over a file stream.

Reconciliation itself stays a batch: totals and one-to-one matches are not incremental.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import extract

CACHED = r"([^/]+)_p([0-9]+)\.txt$"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page, text) of page files ``<stem>_pNN.txt`` that arrive in ``folder``."""
    df = spark.readStream.format("text").option("wholetext", True).load(folder)
    path = F.input_file_name()
    return df.select(F.regexp_extract(path, CACHED, 1).alias("file"), F.regexp_extract(path, CACHED, 2).try_cast("int").alias("page"), F.col("value").alias("text")).where("page is not null")


def ingest_receipts(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the receipt rows of all files that are new since the last run to ``out``, each file once."""
    rows = extract.receipt_rows(extract.lines_of(page_stream(spark, folder)))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
