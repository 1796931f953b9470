"""What the operators need from the cluster they run on: a shared folder to cut lineage into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.plans.lineage import shared

__all__ = ["cut", "few", "narrow", "shared"]

#: Rows of two numbers that are sent to all tasks at most (1.6 MB of them), where each join by a shuffle is one exchange more.
SENT = 100_000


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Writes df to the shared folder of spark.checkpoint.dir and returns what reads it back.

    Where the session names no folder (tests, a laptop) a temporary one is set; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager)


def narrow(df: DataFrame, rows: int = 2000) -> DataFrame:
    """cut(df) in no more partitions than one for each `rows` rows, so that few rows don't pass through many files."""
    return counted(df, rows)[0]


def counted(df: DataFrame, rows: int = 2000) -> tuple[DataFrame, int]:
    """narrow(df), and its number of rows."""
    df = cut(df)
    n = df.count()
    return df.coalesce(-(-n // rows) or 1), n


def few(df: DataFrame) -> DataFrame:
    """narrow(df), which joins send to all tasks where it has at most SENT rows."""
    df, n = counted(df)
    return F.broadcast(df) if n <= SENT else df
