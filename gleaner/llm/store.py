"""Intermediate tables in the shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from gleaner.session import checkpoint_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read from there.

    Cuts the lineage like a checkpoint, but compressed and with column pruning.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
