"""Plans that adaptive execution can split where a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_apart(df: DataFrame, *keys: str) -> DataFrame:
    """An aggregate in an exchange of its own, before it is joined back on its keys.

    Without it the aggregate and the join are one stage, which adaptive execution
    does not split; behind it the other side of the join is split.
    """
    return df.repartition(F.xxhash64(*keys))
