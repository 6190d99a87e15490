"""Subsets by technique keywords or intent labels; they may overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.schema import SPLITS

# Keywords (found anywhere in the technique) and labels of each subset.
TECHNIQUE_SUBSETS = {
    "encoding": (("encoding", "obfuscation", "base64", "hex", "unicode", "cipher", "encoded"), (4,)),
    "role_play": (("role", "persona", "character", "roleplay", "role-play", "role_play", "jailbreak"), (3,)),
    "tool_abuse": (("tool", "function", "api", "call", "tool_abuse", "tool-abuse", "plugin"), (5,)),
}


def in_subset(name: str) -> Column:
    keywords, labels = TECHNIQUE_SUBSETS[name]
    technique = F.lower(F.coalesce(F.col("technique"), F.lit("none")))
    found = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(technique, k))
    return found | F.coalesce(F.expr("try_cast(intent_label as int)").isin(*labels), F.lit(False))


def technique_subsets(df: DataFrame) -> DataFrame:
    """df's rows once for each subset they are in, with its name as subset; one pass."""
    names = F.filter(F.array(*(F.when(in_subset(n), F.lit(n)) for n in TECHNIQUE_SUBSETS)), lambda x: x.isNotNull())
    return df.filter(F.col("split").isin(*SPLITS)).withColumn("subset", F.explode(names))


def technique_subset_counts(df: DataFrame) -> DataFrame:
    """(subset, split, n) with zeros for the splits that df has."""
    counts = [F.struct(F.lit(n).alias("subset"), F.sum(in_subset(n).cast("long")).alias("n")) for n in TECHNIQUE_SUBSETS]
    return df.filter(F.col("split").isin(*SPLITS)).groupBy("split").agg(F.array(*counts).alias("x")).select("split", F.inline("x"))
