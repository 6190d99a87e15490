"""Projections of single records: aliases, cleaning, derived columns, obfuscation columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.config import CleaningConfig
from siftwright.functions.obfuscation import base64_fragments, decoded_context, obfuscation_types
from siftwright.functions.text import clean_text, recleaned

#: Buckets by highest severity.
SEVERITY_BUCKETS = ((1, 2, "low_1_2"), (3, 4, "moderate_3_4"), (5, 6, "high_5_6"), (7, 10, "critical_7_10"))
TEXT_COLUMNS = ("text_obfuscation_aware", "text_clean", "text")


def text_column(df: DataFrame, *names: str) -> str:
    """The first text column that df has."""
    return next(c for c in names or TEXT_COLUMNS if c in df.columns)


def normalize_fields(df: DataFrame) -> DataFrame:
    """label and intent_label stand in for each other where one column is missing."""
    if "label" in df.columns and "intent_label" not in df.columns:
        return df.withColumn("intent_label", F.col("label"))
    if "intent_label" in df.columns and "label" not in df.columns:
        return df.withColumn("label", F.col("intent_label"))
    return df


def clean_records(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    cleaned = normalize_fields(df).withColumn("text_clean", clean_text(F.col("text"), config))
    return cleaned.withColumns({"text_original": F.coalesce("text", F.lit("")), "text": F.col("text_clean")})


def severity_bucket(severity: Column) -> Column:
    out = F.lit("unknown")
    for low, high, name in SEVERITY_BUCKETS[::-1]:
        out = F.when(severity.between(low, high), F.lit(name)).otherwise(out)
    return out


def truth(df: DataFrame, name: str) -> Column:
    """A column as a boolean: any text but the empty one, and any number but zero, is true; null or no such column is false."""
    if name not in df.columns:
        return F.lit(False)
    kind = dict(df.dtypes)[name]
    if kind == "string":
        found = F.col(name) != ""
    elif kind in ("float", "double"):
        found = F.isnan(name) | (F.col(name) != 0)
    else:
        found = F.col(name).cast("boolean")
    return F.coalesce(found, F.lit(False))


def add_derived_columns(df: DataFrame) -> DataFrame:
    """severity_bucket, and ambiguity as a boolean."""
    found = truth(df, "ambiguity")
    return df.withColumns({"severity_bucket": severity_bucket(F.expr("try_cast(severity as int)")), "ambiguity": found})


def add_obfuscation_columns(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """Flags, decoded fragments and cleaned text of the text column; each array is computed once.

    cleaned: text_clean went through all cleaning steps.
    """
    name = text_column(df, "text_clean", "text")
    text = F.col(name)
    plain = recleaned(text) if cleaned and name == "text_clean" else clean_text(text)
    found = df.withColumns({"_fragments": base64_fragments(text), "_types": obfuscation_types(text), "_cleaned": plain})
    return found.withColumns(
        {
            "text_obfuscation_aware": F.concat("_cleaned", decoded_context(F.col("_fragments"))),
            "obfuscation_detected": F.size("_types") > 0,
            "obfuscation_types": F.array_join("_types", ","),
            "obfuscation_decoded_count": F.size("_fragments"),
        }
    ).drop("_fragments", "_types", "_cleaned")
