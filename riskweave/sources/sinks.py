"""The CSV export (replaceable tables: riskweave.sources.versions).

* ``export_csv`` is the analyst download: header row, UTF-8, one file per
  partition (``single_file=True`` coalesces small results to one file;
  never use it for large frames, it funnels everything through one task).
* ``read_export`` reads such an export back with the original schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.sources.loans import CSV_STANDARD

def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Header CSV export of the whole frame (no index column)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8")
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def read_export(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a CSV export back with the schema of the exported frame."""
    return (spark.read.schema(schema).options(header=True, **CSV_STANDARD)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
