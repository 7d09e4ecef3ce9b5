"""Spreading of inputs too small for the reader to split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomstone.session import source_files


def spread(df: DataFrame, path: str, at_most: int = 128 << 20) -> DataFrame:
    """Deal the rows of a table of at most ``at_most`` bytes out to all cores.

    One Parquet row group is one split, so heavy per-row work on a small file
    would keep to one core. What is shuffled for it never passes ``at_most``;
    larger tables are left to the reader's split size.
    """
    if sum(size for _, size, _ in source_files(df.sparkSession, path)) > at_most:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
