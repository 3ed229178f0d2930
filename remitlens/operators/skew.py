"""Hot join keys: find them, and split both sides of a join over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.config import SkewPolicy


def hot_keys(df: DataFrame, keys: list[str], policy: SkewPolicy, pieces: str) -> DataFrame:
    """Keys that hold too many rows of ``df``, with the number of pieces to cut each into.

    At most ``policy.max_keys`` rows (see ``SkewPolicy``). Costs one map-side-combined count.
    """
    sizes = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_total")).scalar()
    limit = F.greatest(F.lit(policy.min_rows).cast("bigint"), F.ceil(total / F.lit(policy.max_keys)))
    return sizes.where(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias(pieces))


def grid(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, policy: SkewPolicy,
) -> tuple[DataFrame, DataFrame]:
    """Salt both sides of a join so that one hot key becomes a grid of ``left x right`` cells.

    Adds ``_l`` and ``_r`` (the cell, to be used as further join keys) and ``_r_pieces`` (how many
    cells a left row is spread over; 1 for nearly all). A row of a hot key is copied once for each
    piece of the other side; all other rows pass through as they are.
    """
    hot_left, hot_right = hot_keys(left, keys, policy, "_l_pieces"), hot_keys(right, keys, policy, "_r_pieces")
    one = F.lit(1)

    def split(df: DataFrame, own: str, own_id: str, mine: str, other: str) -> DataFrame:
        # both tables of hot keys hold at most max_keys rows
        joined = df.join(F.broadcast(hot_left), keys, "left").join(F.broadcast(hot_right), keys, "left").withColumns({
            "_l_pieces": F.coalesce("_l_pieces", one), "_r_pieces": F.coalesce("_r_pieces", one)})
        return joined.withColumns({
            own: F.pmod(F.hash(own_id), F.col(mine)),
            "_copies": F.sequence(F.lit(0), F.col(other) - 1),
        })

    cells_left = split(left, "_l", left_id, "_l_pieces", "_r_pieces").withColumn("_r", F.explode("_copies")).drop("_copies", "_l_pieces")
    cells_right = split(right, "_r", right_id, "_r_pieces", "_l_pieces").withColumn("_l", F.explode("_copies")).drop(
        "_copies", "_l_pieces", "_r_pieces")
    return cells_left, cells_right
