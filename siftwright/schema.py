"""Names, labels and the record schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels and names of the data format.
INTENTS = {
    0: "benign",
    1: "direct_injection",
    2: "system_extraction",
    3: "role_hijack",
    4: "obfuscation",
    5: "tool_abuse",
    6: "indirect_injection",
}
REQUIRED_FIELDS = ("text", "label", "binary_label", "intent", "intent_label", "technique", "severity")
OPTIONAL_FIELDS = ("technique_label", "surface", "surface_label", "source", "ambiguity")
SPLITS = ("train", "validation", "test")
SEVERITIES = (1, 10)

RECORD = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("intent_label", T.IntegerType()),
        T.StructField("binary_label", T.IntegerType()),
        T.StructField("intent", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("ambiguity", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)
