"""Files of a fixed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_indicator(spark: SparkSession, path: str, indicator: str, year: int) -> DataFrame:
    """``iso2c, country, year, value`` of one year of a country indicator as downloaded: CSV with a column of the indicator's name."""
    df = spark.read.csv(path, schema=f"iso2c string, country string, year int, `{indicator}` double", header=True)
    return df.where(F.col("year") == year).select("iso2c", "country", "year", F.col(f"`{indicator}`").alias("value"))
