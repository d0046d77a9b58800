"""Reading the tables; what the library has for cutting lineage, skewed joins and connected pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.graph import BROADCAST_ROWS, HOT, attach, components, join_skewed
from ..sources.readers import counted, stored

__all__ = ["BROADCAST_ROWS", "HOT", "attach", "bounded_batches", "components", "counted", "free_name", "join_skewed", "read", "stored"]

ROWS_PER_BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the number of rows in an Arrow batch, unless somebody has set it: documents are long, and a Python
    worker holds a batch several times over. The setting is the session's, so later jobs see it too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
