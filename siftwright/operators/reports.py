"""Distributions, severity and subset reports, and macro metrics: long tables of grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.operators.records import add_derived_columns
from siftwright.schema import INTENTS

DIMENSIONS = ("intent_label", "intent", "binary_label", "technique", "severity", "ambiguity")


def _shown(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    text = F.col(name).cast("string")
    return F.coalesce(F.initcap(text) if dict(df.dtypes)[name] == "boolean" else text, F.lit("unknown"))


def intent_name(label: Column) -> Column:
    names = F.create_map(*(F.lit(x) for item in INTENTS.items() for x in item))
    return F.coalesce(F.element_at(names, label), label.cast("string"))


def class_distribution(df: DataFrame) -> DataFrame:
    """(split, dimension, value, n) in one pass: row count, six columns, and intent labels by name."""
    label = F.expr("try_cast(intent_label as int)") if "intent_label" in df.columns else F.lit(None).cast("int")
    if "intent_label" not in df.columns and "label" in df.columns:
        df = df.withColumn("intent_label", F.col("label"))
    pairs = [F.struct(F.lit(d).alias("dimension"), _shown(df, d).alias("value")) for d in DIMENSIONS]
    pairs.append(F.struct(F.lit("intent_label_named").alias("dimension"), intent_name(label).alias("value")))
    pairs.append(F.struct(F.lit("row_count").alias("dimension"), F.lit("all").alias("value")))
    spread = df.select("split", F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    return spread.groupBy("split", "dimension", "value").agg(F.count("*").alias("n"))


def severity_report(df: DataFrame) -> DataFrame:
    """(split, intent_label, severity_bucket, n); the label is null in the totals by bucket."""
    derived = add_derived_columns(df).select("split", F.col("intent_label").cast("int").alias("intent_label"), "severity_bucket")
    one = lambda every, label: F.struct(F.lit(every).alias("all"), label.alias("label"))
    both = F.explode(F.array(one(True, F.lit(None).cast("int")), one(False, F.col("intent_label"))))
    spread = derived.select("split", "severity_bucket", both.alias("x")).filter(F.col("x.all") | F.col("x.label").isNotNull())
    return spread.groupBy("split", F.col("x.label").alias("intent_label"), "severity_bucket").agg(F.count("*").alias("n"))


def severity_buckets(df: DataFrame) -> DataFrame:
    return add_derived_columns(df).groupBy("split", "severity_bucket").agg(F.count("*").alias("n"))


def intent_by_severity(df: DataFrame) -> DataFrame:
    return add_derived_columns(df).groupBy("split", "intent_label", "severity_bucket").agg(F.count("*").alias("n"))


def split_report(df: DataFrame, kept: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows of each split before, after dedup and after validation."""
    tag = lambda d, name: d.select("split", F.lit(name).alias("step"))
    every = tag(df, "input").unionAll(tag(kept, "after_dedup")).unionAll(tag(valid, "output"))
    count = lambda name: F.sum((F.col("step") == name).cast("long")).alias(f"{name}_rows")
    out = every.groupBy("split").agg(count("input"), count("after_dedup"), count("output"))
    return out.withColumn("removed", F.col("input_rows") - F.col("after_dedup_rows"))


def ambiguity_subset(df: DataFrame) -> DataFrame:
    return add_derived_columns(df).filter("ambiguity")


def ambiguity_counts(df: DataFrame) -> DataFrame:
    return add_derived_columns(df).groupBy("split").agg(F.sum(F.col("ambiguity").cast("long")).alias("n"))


def macro_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, and unweighted means of precision, recall and F1 over all classes of either column.

    One confusion count, then one row a class; a quotient by zero is zero. Rows with a null are left out.
    """
    cells = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).count()
    right = F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0)
    seen = F.array(
        F.struct(F.col("t").alias("c"), F.col("count").alias("actual"), F.lit(0).cast("long").alias("guessed"), right.alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("count").alias("guessed"), F.lit(0).cast("long").alias("hit")),
    )
    classes = cells.select(F.inline(seen)).groupBy("c").agg(*(F.sum(x).alias(x) for x in ("actual", "guessed", "hit")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    a, g, h = F.col("actual"), F.col("guessed"), F.col("hit")
    scored = classes.select("actual", "hit", ratio(h, g).alias("precision"), ratio(h, a).alias("recall"), ratio(2 * h, a + g).alias("f1"))
    return scored.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )
