"""An extension: linting documents as they arrive. Each row is one document, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumire.operators.lint import lint
from sumire.plans.config import Config


def lint_folder(spark: SparkSession, folder: str, config: Config | None = None) -> DataFrame:
    """A streaming DataFrame (path, source, diagnostics) of the files that come into a folder."""
    docs = spark.readStream.format("text").option("wholetext", True).load(folder)
    return lint(docs.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source")), config)
