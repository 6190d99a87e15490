"""Class balancing by exact oversampling with replacement.

Poisson sampling would miss the wanted number, so rows are numbered within their class by row_idx and draws, hashes of seed,
class and draw number, join them by number. Classes are few; numbering is two-level, so a large class is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright.functions.draws import draw, pick

CAP = 2.0
MAJORITY_SHARE = 0.8
RANGE = 65_536  #: neighbouring row indices of a class that are numbered on their own


def class_counts(df: DataFrame, label: str = "intent_label") -> DataFrame:
    return df.groupBy(F.expr(f"try_cast({label} as int)").alias(label)).agg(F.count("*").alias("n")).dropna()


def balance_targets(df: DataFrame, strategy: str = "oversample_median", label: str = "intent_label", cap: float = CAP) -> DataFrame:
    """(label, n, target): medians or a share of the majority, capped at cap x n but for the majority class.

    The majority is the largest class, the smallest label among equals.
    """
    counts = class_counts(df, label)
    stats = counts.agg(
        F.median("n").cast("long").alias("median"), F.max("n").alias("most"), F.max_by(label, F.struct("n", -F.col(label))).alias("majority")
    )
    wanted = {"oversample_median": F.col("median"), "oversample_max_minority": F.floor(F.col("most") * MAJORITY_SHARE)}
    target = F.greatest("n", wanted[strategy]) if strategy in wanted else F.col("n")
    most = F.floor(F.col("n") * cap)
    capped = F.when((F.col(label) != F.col("majority")) & (target > most), F.greatest("n", most)).otherwise(target)
    return counts.join(F.broadcast(stats)).select(label, "n", capped.cast("long").alias("target"))  # stats is one row


def balance_classes(df: DataFrame, strategy: str = "oversample_median", seed: int = 42, label: str = "intent_label") -> DataFrame:
    """All rows, and target - n drawn rows of each class with is_balanced_duplicate."""
    key = F.expr(f"try_cast({label} as int)")
    part = F.floor(F.col("row_idx") / RANGE)
    marked = df.withColumns({"_label": key, "_part": part})
    sizes = marked.groupBy("_label", "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy("_label").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_label", "_part").orderBy("row_idx"))
    numbered = marked.withColumn("_inside", inside).join(sizes.select("_label", "_part", before.alias("_before")), ["_label", "_part"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_inside"))
    targets = balance_targets(df, strategy, label).filter("target > n")
    draws = targets.select(F.col(label).alias("_label"), "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("target") - F.col("n"))).alias("_draw"))
    draws = draws.withColumn("_number", 1 + pick(F.col("n"), seed, F.col("_label"), F.col("_draw")))
    extra = numbered.join(draws.select("_label", "_number", "_draw"), ["_label", "_number"])
    extra = extra.select(*df.columns, F.lit(True).alias("is_balanced_duplicate"))
    return df.withColumn("is_balanced_duplicate", F.lit(False)).select(*df.columns, "is_balanced_duplicate").unionByName(extra)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """A seeded order for a sink; rows elsewhere have none."""
    return df.orderBy(draw(seed, F.col("row_idx"), F.col("is_balanced_duplicate")), "row_idx")
