"""Tenant tables: company-partitioned parquet, read with pruning and appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, companies: list | None = None) -> DataFrame:
    """A tenant table. With ``companies`` only those partitions are listed and read."""
    table = spark.read.parquet(path)
    return table if companies is None else table.where(F.col("company_id").isin(companies))


def append_table(df: DataFrame, path: str, slices: int | None = None) -> None:
    """Append rows, one directory per company.

    Each company's rows are spread over ``slices`` tasks by a hash of their ids (by default as many as the session shuffles into), so
    the largest company is written by as many tasks as the cluster is set up for; tasks are merged where they hold little.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in _id_columns(df)]), F.lit(slices)))
    spread.repartition("company_id", "_slice").drop("_slice").write.mode("append").partitionBy("company_id").parquet(path)


def _id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_id") and c != "company_id"] or df.columns[:1]


def replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one numbered batch; writing it again replaces it, so retries leave no duplicates."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def payload(df: DataFrame, exclude: tuple[str, ...] = ("evaluated_at",)) -> DataFrame:
    """Rows as JSON payloads next to their company and payment; clock columns are left out."""
    fields = [c for c in df.columns if c not in exclude]
    return df.select("company_id", "payment_id", F.to_json(F.struct(*fields)).alias("payload"))
