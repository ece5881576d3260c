"""A keyed table that micro-batches read and rewrite a few buckets at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Buckets of a table: what a batch with few keys leaves alone, and the most numbers that the driver sees.
BUCKETS = 64


class KeyedTable:
    """Rows by key, in buckets of the key's hash. A batch reads the buckets of its keys and writes these anew.

    Each batch writes a folder of its own, so one that is run again after a failure reads what it read before. The
    driver knows, for each bucket, the last batches that wrote it; ``path`` may hold a table of an earlier run.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.written: dict[int, list[int]] = {}
        self._load()

    def _load(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return
        batches = (status.getPath() for status in files.listStatus(folder))
        for number, batch in sorted((int(b.getName().removeprefix("batch=")), b) for b in batches):
            # A folder without its mark was not finished.
            names = [status.getPath().getName() for status in files.listStatus(batch)]
            if "_SUCCESS" in names:
                self._note(number, [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")])

    def _note(self, number: int, buckets: list[int]) -> None:
        for bucket in buckets:
            kept = [n for n in self.written.get(bucket, []) if n < number]
            self.written[bucket] = [*kept[-1:], number]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias("_b")).distinct().collect())

    def around(self, rows: DataFrame, number: int) -> DataFrame:
        """All stored rows of the buckets that the keys of ``rows`` fall into, as before batch ``number``."""
        paths = []
        for bucket in self.touched(rows):
            earlier = [n for n in self.written.get(bucket, []) if n < number]
            paths += [f"{self.path}/batch={n}/bucket={bucket}" for n in earlier[-1:]]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, rows: DataFrame, number: int) -> None:
        """Write whole buckets: everything that ``around`` gave, as it is after batch ``number``."""
        placed = rows.withColumn("bucket", self.bucket())
        out = placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
        out.partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        self._note(number, self.touched(rows))
