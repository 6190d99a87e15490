"""URL filters by host and path prefix, from a memory-mapped sorted digest array.

Rules are keyed by the 64-bit xxhash of host and path prefix. The sorted keys are an NPY file that every executor
gets once (``SparkContext.addFile``) and memory-maps; its workers share the pages. For a batch of urls the keys of
all host suffixes and path prefixes that rules can have are probed by one vectorised binary search; each hit is
confirmed on the stored full string, and runs of equal keys are walked, so collisions change nothing.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the default verdict. Of
the rules that fit, the one with the longest text wins, then the one with the longest host. A rule stated twice
counts once; where two statements of a rule differ, block wins.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """'block net/' or 'allow example.net/en/': a verdict, and a host with a path prefix."""
    verdict, _, rest = line.strip().partition(" ")
    host, slash, path = rest.strip().partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(verdict, host.translate(_UPPER_TO_LOWER), slash + path)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url as it stands: no port, user or escape is taken apart."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end].translate(_UPPER_TO_LOWER), rest[end:]
    end = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    return host, rest[:end]


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8"))


class DigestRules:
    """The rules as files: sorted keys, and the strings in the keys' order."""

    def __init__(self, rules: Iterable[Rule], default: str = "allow"):
        best: dict[str, Rule] = {}
        for rule in rules:
            text = f"{rule.host}\n{rule.path}"
            if text not in best or rule.verdict == "block":
                best[text] = rule
        ordered = sorted(best.values(), key=lambda r: (_key(f"{r.host}\n{r.path}"), r.text))
        self.keys = np.array([_key(f"{r.host}\n{r.path}") for r in ordered], np.uint64)
        self.rules, self.default = ordered, default
        self.labels = max((r.host.count(".") + 1 for r in ordered), default=0)
        self.prefixes = sorted({len(r.path) for r in ordered})

    @property
    def body(self) -> list[bytes]:
        return [f"{r.host}\n{r.path}\n{r.verdict}".encode() for r in self.rules]

    @property
    def digest(self) -> str:
        return hashlib.sha256(b"\0".join(self.body)).hexdigest()[:16]

    def write(self, folder: str) -> str:
        """Flat NPY files: the keys, and each rule's host, path and verdict with their ends."""
        body, digest = self.body, self.digest
        ends = np.cumsum([0] + [len(b) for b in body], dtype=np.int64)
        os.makedirs(path := os.path.join(folder, f"rules-{digest}"), exist_ok=True)
        np.save(f"{path}/keys-{digest}.npy", self.keys)
        np.save(f"{path}/ends-{digest}.npy", ends)
        np.save(f"{path}/text-{digest}.npy", np.frombuffer(b"".join(body), np.uint8))
        return path


class Mapped:
    """Opened in a worker: memory-mapped keys and strings."""

    def __init__(self, keys: str, ends: str, text: str):
        self.keys, self.ends, self.body = (np.load(p, mmap_mode="r") if os.path.getsize(p) > 128 else np.load(p) for p in (keys, ends, text))

    def at(self, i: int) -> tuple[str, str, str]:
        host, path, verdict = bytes(self.body[self.ends[i] : self.ends[i + 1]]).decode().split("\n")
        return host, path, verdict


def judge(urls: Iterable[str | None], table: Mapped, labels: int, prefixes: list[int], default: str) -> list[tuple]:
    """(host, path, rule or None, verdict) of each url, by one binary search for the batch."""
    parts = [split_url(u) for u in urls]
    probes: list[tuple[int, str, str]] = []
    for row, (host, path) in enumerate(parts):
        ends, at = [0] if labels and host else [], len(host)
        tails = []
        for _ in range(labels):
            at = host.rfind(".", 0, at)
            if at < 0:
                break
            tails.append(at + 1)
        if len(tails) == labels and labels:
            ends = []  # the whole host has more labels than any rule
        for start in ends + tails:
            probes += [(row, host[start:], path[:n]) for n in prefixes if n <= len(path)]
    best: dict[int, tuple] = {}
    if probes and len(table.keys):
        wanted = np.array([_key(f"{h}\n{p}") for _, h, p in probes], np.uint64)
        first = np.searchsorted(table.keys, wanted)
        hit = (first < len(table.keys)) & (table.keys[np.minimum(first, len(table.keys) - 1)] == wanted)
        for i in np.flatnonzero(hit):
            row, host, path = probes[i]
            at = int(first[i])
            while at < len(table.keys) and table.keys[at] == wanted[i]:
                stored = table.at(at)
                if stored[:2] == (host, path):
                    rank = (len(host) + len(path), len(host))
                    if row not in best or rank > best[row][0]:
                        best[row] = (rank, host + path, stored[2])
                at += 1
    return [(*parts[i], *(best[i][1:] if i in best else (None, default))) for i in range(len(parts))]


#: File names by application and digest: a file is registered once, under one path.
_SHIPPED: dict[tuple[str, str], dict[str, str]] = {}


def _ship(spark: SparkSession, rules: DigestRules) -> dict[str, str]:
    """Send the rules' files to the executors; names by kind."""
    key = spark.sparkContext.applicationId, rules.digest
    if key not in _SHIPPED:
        folder = rules.write(tempfile.mkdtemp(prefix="siftwright-rules-"))
        names = sorted(os.listdir(folder))
        for name in names:
            spark.sparkContext.addFile(os.path.join(folder, name))
        _SHIPPED[key] = {name.split("-")[0]: name for name in names}
    return _SHIPPED[key]


def filter_urls(
    df: DataFrame, rules: Iterable[Rule], *, page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row's url."""
    spark: SparkSession = df.sparkSession
    made = DigestRules(rules, default)
    by_kind = _ship(spark, made)
    labels, prefixes = made.labels, made.prefixes

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Mapped(*(SparkFiles.get(by_kind[k]) for k in ("keys", "ends", "text")))
        for batch in urls:
            yield pd.DataFrame(
                judge(batch, table, labels, prefixes, default), columns=["host", "path", "rule", "verdict"], dtype=object
            )

    rows = df.select(F.col(page_id), F.col(url).cast("string").alias("_sw_url"))
    told = rows.withColumn("_sw_told", judged.asNondeterministic()(F.col("_sw_url")))
    return told.select(page_id, "_sw_told.*")
