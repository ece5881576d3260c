"""Writing an intermediate result once, for plans that pass over it several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from portledger.session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends at the files, which survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
