"""Record validation: an ordered array of issues for each row, no row loop.

Null quirks kept from the format's rules: intent and technique are compared as text, null being the text "None", so a
null technique of a malicious row is missing but not empty, and a null intent never equals a label's name. The inverse
name check never fires beside the name check and is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwright.functions.text import strip
from siftwright.schema import INTENTS, REQUIRED_FIELDS, SEVERITIES

ERROR, WARNING = "error", "warning"
REPORTED = 100
ISSUES = "array<struct<field:string,message:string,severity:string>>"


def as_int(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` as int)")


def _first(df: DataFrame, *names: str) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def issues(df: DataFrame) -> Column:
    """array<struct<field, message, severity>> in rule order."""
    has = df.columns
    text = F.coalesce(_first(df, "text_clean", "text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in has else F.lit("")
    label = as_int("intent_label") if "intent_label" in has else F.lit(None).cast("int")
    if "label" in has:
        label = F.coalesce(label, as_int("label"))
    raw_label = as_int("intent_label") if "intent_label" in has else F.lit(None).cast("int")
    binary = as_int("binary_label") if "binary_label" in has else F.lit(None).cast("int")
    severity = as_int("severity") if "severity" in has else F.lit(None).cast("int")

    def issue(when: Column, field: str, message: Column | str, level: str = ERROR) -> Column:
        said = message if isinstance(message, Column) else F.lit(message)
        return F.when(when, F.struct(F.lit(field).alias("field"), said.alias("message"), F.lit(level).alias("severity")))

    rules = []
    for field in REQUIRED_FIELDS:
        missing = (F.col(field).isNull() | (F.col(field).cast("string") == "")) if field in has else F.lit(True)
        if field == "technique":
            missing = missing & ~F.coalesce(raw_label == 0, F.lit(False))
        rules.append(issue(missing, field, f"required field '{field}' is missing"))
    known = F.coalesce(label.between(min(INTENTS), max(INTENTS)), F.lit(False))
    wanted = F.element_at(F.create_map(*(F.lit(x) for item in INTENTS.items() for x in item)), label)
    benign, malicious = F.coalesce(label == 0, F.lit(False)), F.coalesce(label != 0, F.lit(False))
    expected = F.when(benign, 0).otherwise(1)
    rules += [
        issue(strip(text) == "", "text", "text is empty after cleaning"),
        issue(~known, "intent_label", "intent_label is not one of the known labels"),
        issue(F.when(known, (name("intent") != "") & (name("intent") != wanted)).otherwise(F.lit(False)), "intent", "intent does not match intent_label"),
        issue(~F.coalesce(binary.isin(0, 1), F.lit(False)), "binary_label", "binary_label is not 0 or 1"),
        issue(label.isNotNull() & F.coalesce(binary.isin(0, 1) & (binary != expected), F.lit(False)), "binary_label", "binary_label is inconsistent with intent_label"),
        issue(~F.coalesce(severity.between(*SEVERITIES), F.lit(False)), "severity", "severity is out of range"),
        issue(benign & F.coalesce(severity > 2, F.lit(False)), "severity", "benign record with a high severity", WARNING),
        issue(malicious & (strip(name("technique")) == ""), "technique", "malicious record without a technique"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def with_issues(df: DataFrame) -> DataFrame:
    """df with its issues; a table that has them keeps them."""
    return df if dict(df.dtypes).get("issues") == ISSUES else df.withColumn("issues", issues(df))


def row_positions(df: DataFrame) -> DataFrame:
    """(split, row_idx, row_index): place within the split from 0, after whatever was dropped.

    Counted in two levels, so that no split is sorted in one task: rows before in their range of row_idx, plus the
    sizes of the ranges before.
    """
    ranged = df.select("split", "row_idx", F.floor(F.col("row_idx") / 65536).alias("range"))
    sizes = ranged.groupBy("split", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("split").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("split", "range", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("split", "range").orderBy("row_idx")) - 1
    placed = ranged.withColumn("inside", inside).join(offsets, ["split", "range"])
    return placed.select("split", "row_idx", (F.col("before") + F.col("inside")).cast("long").alias("row_index"))


def issue_table(df: DataFrame) -> DataFrame:
    """A row for each issue: split, row_idx, row_index, place among the row's issues, field, message, severity."""
    found = with_issues(df).select("split", "row_idx", F.posexplode("issues").alias("place", "issue"))
    return found.join(row_positions(df), ["split", "row_idx"]).select("split", "row_idx", "row_index", "place", "issue.*")


def _valid() -> Column:
    return ~F.exists("issues", lambda i: i["severity"] == ERROR)


def valid_records(df: DataFrame) -> DataFrame:
    """Rows without an error; warnings stay."""
    return with_issues(df).filter(_valid()).drop("issues")


def validation_report(df: DataFrame) -> DataFrame:
    """split, total_rows, valid_rows, invalid_rows, issue_count."""
    marked = with_issues(df).select("split", _valid().cast("long").alias("valid"), F.size("issues").alias("n"))
    counted = marked.groupBy("split").agg(F.count("*").alias("total_rows"), F.sum("valid").alias("valid_rows"), F.sum("n").alias("issue_count"))
    return counted.withColumn("invalid_rows", F.col("total_rows") - F.col("valid_rows"))


@dataclass(frozen=True)
class ValidationSummary:
    total_rows: int
    valid_rows: int
    invalid_rows: int
    issue_count: int
    issues: list[dict]

    def to_dict(self) -> dict:
        return dict(self.__dict__)


def summarize(df: DataFrame, split: str, most: int = REPORTED) -> ValidationSummary:
    """A split's report for JSON: all issues counted, the first hundred listed."""
    own = df.filter(F.col("split") == split)
    counts = validation_report(own).drop("split").first()
    listed = issue_table(own).orderBy("row_index", "place").limit(most).select("row_index", "field", "message", "severity").collect()
    if counts is None:
        return ValidationSummary(0, 0, 0, 0, [])
    return ValidationSummary(counts["total_rows"], counts["valid_rows"], counts["invalid_rows"], counts["issue_count"], [r.asDict() for r in listed])
