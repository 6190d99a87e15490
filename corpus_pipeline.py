"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir), calls one operator and returns its documents; all but the last return the
columns of docs. run() writes each stage's rows as Parquet to the shared folder and reads them again, so a lost
executor costs the stage at hand at most, and with a folder of its own a lost driver too. Nulls, empty tables and extra
columns are as the operators define them.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import decontam, langid, mixing, passages, simhash
from siftwright.shared import write_once, written
from siftwright.sources.files import Files
from siftwright.sources.records import exists

#: Posterior below which a document's language counts as unknown.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model is sure of, go."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("whole"))
    told = langid.identify(rows, langid.fit(docs), text="whole", into="told")
    return told.filter((F.col("told.lang_pred") != langid.UND) & (F.col("told.score") >= SURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document without any other word goes."""
    return passages.drop_passages(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: the columns of docs, and the copy's number as mix_copy."""
    return mixing.taken_rows_of(docs, "mix_copy")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: SQL can't express naive Bayes, components and chaining; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of what the stages' tables depend on: the input's files (path, length, time), parameters and the code."""
    code = hashlib.sha256()
    for file in sorted([Path(__file__), *Path(mixing.__file__).parent.glob("*.py")]):
        code.update(file.read_bytes())
    tables = [f"{sf_dir}/{name}.parquet" for name in ("documents", "benchmark")]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tables)
    of = listed.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{code.hexdigest()}|{of['n']}|{of['s']}".encode()).hexdigest()


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows.

    With a folder (a shared one), each stage's table stays there with a ledger beside it, committed after the table. A run
    that is started again reads the stages whose ledger has the state of this input and this code, and makes the others
    anew. Without a folder, tables have paths of their own and go when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files, now = Files(spark), folder and state(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        if folder is None:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            continue
        path, ledger = f"{folder.rstrip('/')}/{name}", f"{folder.rstrip('/')}/{name}.json"
        if not exists(spark, f"{path}/_SUCCESS") or files.read_json(ledger).get("state") != now:
            files.write_json({}, ledger)
            write_once(stage(spark, docs, sf_dir), path, "overwrite")
            files.write_json({"stage": name, "state": now}, ledger)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
