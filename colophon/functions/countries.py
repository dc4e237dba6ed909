"""Country names and their two-letter codes, from the names the Java runtime has for all ISO countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names whose inverted form has no counterpart among the runtime's names.
INVERTED = {"Congo, Democratic Republic of": "CD", "Congo, Republic of": "CG", "Korea, Republic of": "KR", "Korea, Democratic People's Republic of": "KP"}


def country_key(name: Column) -> Column:
    """Letters only, lower case, ``&`` as "and"."""
    return F.regexp_replace(F.lower(F.replace(name, F.lit("&"), F.lit("and"))), r"[^\p{L}]", "")


def country_codes(spark: SparkSession) -> DataFrame:
    """``country_key, iso2``: one row per ISO country and inverted name, about 250."""
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    rows = [(locale("", c), c) for c in locale.getISOCountries()]
    named = [(place.getDisplayCountry(english), code) for place, code in rows] + list(INVERTED.items())
    return spark.createDataFrame(named, "name string, iso2 string").select(country_key(F.col("name")).alias("country_key"), "iso2").dropDuplicates(["country_key"])


def with_country_code(df: DataFrame, country: str, out: str = "iso2") -> DataFrame:
    """``df`` with the code of each country: of the whole name, else of the part before a comma ("Tanzania, United Republic of"); else null."""
    codes = F.broadcast(country_codes(df.sparkSession))
    whole = codes.select(F.col("country_key").alias("_k1"), F.col("iso2").alias("_c1"))
    head = codes.select(F.col("country_key").alias("_k2"), F.col("iso2").alias("_c2"))
    keyed = df.withColumns({"_w": country_key(F.col(country)), "_h": country_key(F.substring_index(country, ",", 1))})
    both = keyed.join(whole, F.col("_w") == F.col("_k1"), "left").join(head, F.col("_h") == F.col("_k2"), "left")
    return both.select(*df.columns, F.coalesce("_c1", "_c2").alias(out))
