"""Row-local helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_known(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which rows without a whole key don't gather: they match nothing, and are spread by their other columns."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    others = [c for c, kind in left.dtypes if c not in keys and kind in ("bigint", "int", "string", "date")]
    spread = left.withColumn("_spread", F.when(whole, 0).otherwise(1 + F.pmod(F.xxhash64(*others), F.lit(1 << 16)).cast("int")))
    return spread.join(right.withColumn("_spread", F.lit(0)), [*keys, "_spread"], "left").drop("_spread")


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are computed exactly once per row.

    The optimizer merges neighbouring projections and pushes filters through them, repeating
    an expression wherever its column is used. For long parsing expressions built on one another
    that multiplies the work and the plan. A generator over a one-element array stops both; it is
    a narrow, code-generated operator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
