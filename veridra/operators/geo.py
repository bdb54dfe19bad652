"""Step 7, cities to one spelling, and the country that a city settles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import lookup, text
from veridra.operators.base import Step, measure
from veridra.rules import ALIAS_TO_CITY, CITY_COUNTRIES, ECOMMERCE_TOKENS, NON_GEOGRAPHIC

UNKNOWN = "UNKNOWN"
KINDS = ("PHYSICAL", "ECOMMERCE", "INTERNAL", "UNKNOWN")


class CityNormalizer(Step):
    name = "geo"

    def apply(self, df: DataFrame) -> DataFrame:
        if "MERCHANT_CITY" not in df.columns:
            return df
        out = df.withColumn("_city", F.upper(text(F.col("MERCHANT_CITY"))))
        out = out.withColumn("MERCHANT_CITY_CLEANED", F.when(F.col("_city") == "", UNKNOWN).otherwise(F.coalesce(lookup(F.col("_city"), ALIAS_TO_CITY), "_city")))
        city = F.col("MERCHANT_CITY_CLEANED")
        out = out.withColumn("LOCATION_TYPE", F.when(city == UNKNOWN, UNKNOWN).otherwise(F.coalesce(lookup(city, NON_GEOGRAPHIC), F.lit("PHYSICAL"))))
        online = city.isin(*ECOMMERCE_TOKENS)
        if "HAS_TERMINAL" in df.columns:
            online = online | ~F.col("HAS_TERMINAL")
        out = out.withColumn("IS_ECOMMERCE", online)
        out = out.withColumn("MERCHANT_COUNTRY_EXPECTED", F.when(F.col("LOCATION_TYPE") == "PHYSICAL", F.coalesce(lookup(city, CITY_COUNTRIES), F.lit(""))).otherwise(""))
        stated = F.upper(text(F.col("MERCHANT_COUNTRY"))) if "MERCHANT_COUNTRY" in df.columns else F.lit("")
        empty = F.lit("")
        return out.withColumn("MERCHANT_COUNTRY_CLEANED", F.coalesce(F.nullif("MERCHANT_COUNTRY_EXPECTED", empty), F.nullif(stated, empty), F.lit(UNKNOWN))).drop("_city")

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        if "MERCHANT_CITY" not in before.columns:
            return []
        kind, expected = F.col("LOCATION_TYPE"), F.col("MERCHANT_COUNTRY_EXPECTED")
        rows = [
            ("cities_distinct_before", F.count_distinct(F.upper(text(F.col("MERCHANT_CITY")))), True),
            ("cities_distinct_after", F.count_distinct("MERCHANT_CITY_CLEANED"), True),
            ("city.unknown", F.count_if(F.col("MERCHANT_CITY_CLEANED") == UNKNOWN), True),
            ("ecommerce_rows", F.count_if("IS_ECOMMERCE"), True),
            *((f"location_type.{x.lower()}", F.count_if(kind == x), False) for x in KINDS),
            ("city.not_in_country_reference", F.count_if((kind == "PHYSICAL") & (expected == "")), True),
            ("country.unknown", F.count_if(F.col("MERCHANT_COUNTRY_CLEANED") == UNKNOWN), True),
        ]
        return [measure(after, rows)]
