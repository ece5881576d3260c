"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six white-space bytes of the contracts; ``bytes.split()`` splits on the same set.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: Rows handled at a time inside a task, so that a batch of long texts stays small.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in fields)])


def doc_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def release(spark: SparkSession) -> None:
    """Run the collectors, so that Spark's cleaner drops the shuffle files of steps that are over."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table written by ``staged`` once everything that reads it has been written itself."""
    spark = df.sparkSession
    release(spark)
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
