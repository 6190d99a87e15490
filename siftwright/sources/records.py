"""Sources: snapshots of splits, processed tables, and the adapter from the driver's documents table."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.operators.records import add_derived_columns
from siftwright.schema import INTENTS, SPLITS

ODD_TEXT = " ＡＢＣ ﬁ %41%42 слово"
SPLIT_BYTES = 32 << 20  #: of a table, for each core, from which on its row groups are enough tasks
TRAIN_SOURCES = ("train_augmented", "train_balanced", "train")


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: str
    dataset_name: str
    dataset_config: str
    dataset_url: str
    dataset_license: str
    seed: int
    created_at_utc: str
    splits: dict[str, int]
    schema_fields: list[str]

    def to_dict(self) -> dict:
        return asdict(self)


def snapshot_id(name: str, config: str, seed: int, counts: dict[str, int]) -> str:
    """Deterministic id of a data set's identity and sizes."""
    payload = json.dumps({"dataset_name": name, "dataset_config": config, "seed": seed, "split_counts": counts}, sort_keys=True)
    return f"tm-{hashlib.sha256(payload.encode('utf-8')).hexdigest()[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; FileNotFoundError if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is too small for that by itself: a table of a few row groups is read by as many tasks."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def ingest(
    records: DataFrame, *, name: str, config: str = "multiclass", seed: int = 42, url: str = "", licence: str = ""
) -> tuple[DataFrame, Snapshot]:
    """The known splits of records and their snapshot; one grouped count."""
    rows = records.filter(F.col("split").isin(*SPLITS))
    counted = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    counts = {s: counted[s] for s in SPLITS if s in counted}
    fields = sorted(c for c in rows.columns if c not in ("split", "row_idx")) if counts else []
    made = Snapshot(snapshot_id(name, config, seed, counts), name, config, url, licence, seed, datetime.now(UTC).isoformat(), counts, fields)
    return rows, made


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """The splits that a stage wrote, with derived columns; FileNotFoundError if none."""
    rows = read_table(spark, path).filter(F.col("split").isin(*SPLITS))
    return add_derived_columns(rows)


def train_source(spark: SparkSession, folder: str) -> str:
    """The path of the first training table that is there."""
    for name in TRAIN_SOURCES:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no training table in {folder}")


def records_from_documents(documents: DataFrame) -> DataFrame:
    """Labelled records from the driver's documents: labels and defects follow from the id.

    Texts stay but for one in 73, which gets what the documents lack: full-width letters, a ligature, url encoding, Cyrillic.
    """
    i = F.col("doc_id")
    b = F.expr("(doc_id div 10) % 20")
    label = F.when(b < 8, 0).when(b < 12, 1).when(b < 15, 2).when(b < 17, 3).otherwise(b - 13).cast("int")
    names = F.create_map(*(F.lit(x) for item in INTENTS.items() for x in item))
    techniques = ("none", "instruction_override", "prompt_leak", "role-play", "encoding", "tool_abuse", "context_injection")
    benign = F.col("intent_label") == 0
    rows = documents.select(
        i.alias("row_idx"),
        F.when(i % 10 < 8, "train").when(i % 10 == 8, "validation").otherwise("test").alias("split"),
        F.when(i % 73 == 0, F.concat("text", F.lit(ODD_TEXT))).otherwise(F.col("text")).alias("text"),
        label.alias("intent_label"),
        "source",
    )
    i = F.col("row_idx")
    rows = rows.withColumns(
        {
            "binary_label": F.when(i % 67 == 0, 3).when((i % 41 == 0), F.when(benign, 1).otherwise(0)).otherwise(F.when(benign, 0).otherwise(1)).cast("int"),
            "intent": F.when(i % 43 == 0, F.lit("invalid")).otherwise(F.element_at(names, F.col("intent_label"))),
            "severity": F.when(i % 47 == 0, 0).when(benign & (i % 59 == 0), 5).when(benign, 1 + i % 2).otherwise(3 + i % 8).cast("int"),
            "technique": F.when(i % 61 == 0, F.lit("")).otherwise(F.element_at(F.array(*map(F.lit, techniques)), F.col("intent_label") + 1)),
            "ambiguity": i % 7 == 0,
        }
    )
    known = F.when(i % 53 == 0, 9).otherwise(F.col("intent_label")).cast("int")
    rows = rows.withColumns({"intent_label": known, "label": known})
    return rows.select("row_idx", "split", "text", "label", "intent_label", "binary_label", "intent", "technique", "severity", "ambiguity", "source")
