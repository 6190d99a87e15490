"""Tables that a run makes once: a ledger beside them says of what input, parameters and code they are.

An entry is committed after its table, so a table without one is made anew, and a run that was killed goes on from the tables
that are whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.sources.files import Files
from siftwright.sources.records import exists


def state_of(*parts: object) -> str:
    return hashlib.sha256("|".join(map(repr, parts)).encode("utf-8")).hexdigest()


def files_state(spark: SparkSession, *paths: str) -> str:
    """Path, length and time of all files below paths; listed and summed by Spark."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    of = listed.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    return state_of(of["n"], of["s"])


def code_state() -> str:
    """The code of the modules that make tables."""
    package = Path(__file__).parent.parent
    return state_of(*(f.read_bytes() for part in ("functions", "operators", "plans", "sources") for f in sorted((package / part).glob("*.py"))))


def source_state(source: DataFrame) -> str | None:
    """The files that source reads and what it does with them; None if it isn't made of files alone."""
    plan = source._jdf.queryExecution().analyzed()
    leaves, paths = plan.collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or "HadoopFsRelation" not in leaf.relation().getClass().getName():
            return None
        roots = leaf.relation().location().rootPaths()
        paths += [roots.apply(k).toString() for k in range(roots.size())]
    if not paths:
        return None
    return state_of(files_state(source.sparkSession, *paths), re.sub(r"#\d+L?", "", plan.toString()))


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._files, self._folder = spark, Files(spark), folder

    def made(self, path: str, state: str | None, write: Callable[[str], object], always: bool = True) -> bool:
        """Whether write(path) was called: it is unless the ledger has path in that state. Without a state it always is.

        always: write leaves a table whatever the rows, so that a missing one is made anew.
        """
        entry = f"{self._folder}/{path.rstrip('/').rpartition('/')[2]}.json"
        if state is not None and self._files.read_json(entry).get("state") == state and (not always or exists(self._spark, path)):
            return False
        self._files.write_json({}, entry)
        write(path)
        self._files.write_json({"path": path, "state": state}, entry)
        return True
