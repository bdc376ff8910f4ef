"""Sides of joins that are small in practice, checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it is counted to have at most `ROWS` rows; beyond that Spark shuffles it.

    Where Spark's own estimate is under its threshold it is not counted: Spark decides by itself then.
    Meant for tables of samples, populations and their pairs, whose rows are short.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if estimate <= limit or df.limit(ROWS + 1).count() > ROWS:
        return df
    return F.broadcast(df)
