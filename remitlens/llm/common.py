"""Helpers of the corpus operators: text expressions, document keys, written tables and joins that stand hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

#: the characters [\x20\x09-\x0D]
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[ \t\n\x0B\x0C\r]+"

#: a lookup table of at most so many rows and bytes of files may be broadcast; larger ones are shuffled
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: keys holding more than 1 / HOT_SHARE of all rows are hot; there can be at most HOT_SHARE of them
HOT_SHARE = 1_000


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    for ch in WHITE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside WHITE."""
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digest(*parts: Column) -> Column:
    """16 bytes that stand for the parts. Null and empty differ."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts])))


def plain_lines(text: Column) -> Column:
    """Lines in lower case, inner blanks as one space, trimmed; positions are those of ``split(text, '\\n')``."""
    odd = F.contains(text, F.lit("  "))
    for ch in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(ch))
    joined = F.when(odd, F.regexp_replace(F.lower(text), r"[ \t\x0B\x0C\r]+", " ")).otherwise(F.lower(text))
    return F.transform(F.split(joined, "\n"), F.trim)


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whole again after a lost executor. ``keep``: see ``scratch``."""
    return cut_lineage(df, keep)


def _bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", weight: str = "n", spread: str | None = None) -> DataFrame:
    """Join ``rows`` with a staged ``table`` that has one row per key; no key of ``rows`` gathers in one task.

    ``weight`` is the column of ``table`` that says how many rows share the key; it is dropped. A table of at most
    BROADCAST_ROWS rows and BROADCAST_BYTES bytes (of its files) is broadcast. Beyond that its hot keys, at most HOT_SHARE of them
    because their weights add up to no more than all, are broadcast and the others meet in a sort-merge join, where rows of
    hot keys are spread by the column ``spread`` over a salt that nothing answers to.
    """
    values = [c for c in table.columns if c not in (*keys, weight)]
    if table.count() <= BROADCAST_ROWS and _bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.select(*keys, *values)), keys, how)
    total = table.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * F.lit(HOT_SHARE) > total
    hot = table.where(is_hot).select(*keys, F.struct(F.lit(True).alias("_is"), *values).alias("_hot"))
    cold = table.where(~is_hot).select(*keys, F.lit(0).alias("_salt"), F.struct(F.lit(True).alias("_is"), *values).alias("_cold"))
    salt = F.pmod(F.xxhash64(spread or rows.columns[0]), F.lit(1 << 20)).cast("int") + 1
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(salt))
    met = marked.join(cold, [*keys, "_salt"], "left")
    if how == "inner":
        met = met.where(F.coalesce("_hot._is", "_cold._is"))
    return met.select(*rows.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])
