"""Column helpers shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names, whatever else ``docs`` carries.

    Operators work on this view, so that extra columns of the caller, of any name,
    can neither clash with their own columns nor be shuffled.
    """
    return docs.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII takes the vectorised built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
