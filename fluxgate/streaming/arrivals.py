"""CDF files as they arrive in a folder, as a stream of rows.

The file source remembers which files it has read, in its checkpoint; each file's
rows are parsed in the micro-batch that brings it.  There is no state over records,
so nothing has to be kept or expired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reader import parse_content


def stream_cdf(spark: SparkSession, folder: str, table: str = "records", variables: Sequence[str] | None = None, files_per_batch: int = 100) -> DataFrame:
    """A streaming table (see ``sources.reader.SCHEMAS``) of the folder's CDF files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parse_content(files.select(F.col("path").alias("file_id"), "content"), table, variables)
