"""The standing request set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.schema import REQUEST

# Requests in their established order.
STANDING_REQUESTS = (
    "corrosion active",
    "localised corrosion",
    "efflorescence",
    "original surface",
    "limit of the original surface",
    "markers of the original surface",
    "cracking",
    "mineralised metal",
    "patina",
    "filiform corrosion",
    "cold working",
    "hot working",
    "zinc pest",
    "surface hardening",
    "heterogeneous tarnishing",
    "metal etching",
    "soldering",
    "paint layers",
    "surface enrichment",
    "non corroded metal",
)


def standing_requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STANDING_REQUESTS)), REQUEST)
