"""Scans by declared schema, with contract checks on the header and bad-line reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.errors import AnalysisException

from portledger.session import scratch_path


class ContractError(ValueError):
    """A source does not have the columns it must have."""


def check_columns(found: Sequence[str], required: Sequence[str], *, exact: bool = False) -> None:
    missing = sorted(set(required) - set(found))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    if exact and list(found) != list(required):
        raise ContractError("unexpected columns or column order")


def scan_csv(
    spark: SparkSession, path: str, required: Sequence[str], *, exact: bool = False
) -> DataFrame:
    """Header CSV, all text; columns are read by name, so their order is free unless exact."""
    header = spark.read.option("header", True).csv(path)
    check_columns(header.columns, required, exact=exact)
    schema = StructType([StructField(c, StringType()) for c in header.columns])
    # The header is known now: the scan needs no second look at the data.
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("emptyValue", "")
        .option("multiLine", False)
        .csv(path)
    )


def scan_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV scan; a missing path is an empty table of the same schema."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


BAD = "_bad_line"


def scan_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by schema; lines that do not parse keep their text in ``_bad_line``."""
    full = StructType([*schema.fields, StructField(BAD, StringType())])
    return (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .json(path)
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank ones counted) and value of every line of text files, whatever splits read them.

    A split's lines are numbered as it reads them; what the splits before it hold, by where they start in the
    file, is added from one small row a split.
    """
    at = "_metadata.file_path", "_metadata.file_block_start"
    lines = spark.read.text(path).select(
        F.col(at[0]).alias("file"), F.col(at[1]).alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    # The same files are read twice: once for the counts, once for the lines.
    joined = lines.join(splits, ["file", "_start"])
    return joined.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def scan_numbered_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by schema with file and line; lines that do not parse keep their text in ``_bad_line``."""
    full = StructType([*schema.fields, StructField(BAD, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.withColumn("_r", F.from_json("value", full, options)).select("file", "line", "_r.*")


def bad_lines(scanned: DataFrame) -> DataFrame:
    """Lines that did not parse, with file and line number where these are known."""
    where = [c for c in ("file", "line") if c in scanned.columns]
    return scanned.filter(F.col(BAD).isNotNull()).select(*where, F.col(BAD).alias("text"))


def rescan_json(df: DataFrame, name: str) -> DataFrame:
    """Write documents as JSON lines in the shared folder and scan them by schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return scan_jsonl(df.sparkSession, path, df.schema).drop(BAD)
