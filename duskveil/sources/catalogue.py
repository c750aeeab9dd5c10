"""A JSON catalogue of datasets and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "name string, versions array<string>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).option("multiLine", True).json(path)


def dataset_names(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("name")


def dataset_versions(catalogue: DataFrame, name: str) -> DataFrame:
    """``version`` rows of one dataset; none if it is unknown."""
    return catalogue.where(F.col("name") == name).select(F.explode("versions").alias("version"))
