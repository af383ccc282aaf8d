"""Where lineage is cut: the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint, shared_folder

__all__ = ["checkpoint", "stored"]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a columnar table in the shared folder; smaller than a checkpoint, and read column by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
