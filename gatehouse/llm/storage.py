"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from gatehouse.session import shared_folder


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into a new folder of the shared folder, and read again.

    Cuts lineage: what follows re-reads files that survive lost executors instead of running ``df`` again.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
