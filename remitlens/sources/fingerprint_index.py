"""Fingerprints of all stored transactions, in slots by hash, so that a batch reads only the slots it can meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

KEY = ["company_id", "deduplication_hash"]
#: keys of a batch are broadcast to the history up to so many; each takes less than a hundred bytes
BROADCAST_KEYS = 200_000


def met_by(history: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct written ``keys`` that ``history`` holds. A small batch goes to the history and not the other way round, so the history is
    read and not shuffled; a large one meets it in a sort-merge join."""
    asked = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")
    return history.select(*KEY).join(asked, KEY, "left_semi").distinct()


class FingerprintIndex:
    """Folders ``slot=/batch=`` under ``path``. ``slots`` and the type of company ids are fixed when the index is made and kept in a file beside them.

    A batch has a name. Adding a batch again replaces what it added before, and a batch never meets its own entries, so a job that failed after
    its fingerprints were written can be run again with the same outcome.
    """

    def __init__(self, spark: SparkSession, path: str, slots: int = 256, company_type: str = "string"):
        self.spark, self.path = spark, path
        if not self._exists(f"{path}/settings"):
            spark.createDataFrame([(slots, company_type)], "slots int, company_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        self.slots, self.company_type = spark.read.parquet(f"{path}/settings").first()

    def _exists(self, path: str) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)

    def _slotted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.pmod(F.xxhash64("deduplication_hash"), F.lit(self.slots)).cast("int"))

    def entries(self) -> DataFrame | None:
        """All entries, or None before the first batch."""
        if not self._exists(f"{self.path}/entries"):
            return None
        # partition values as they are written, whatever they look like
        schema = f"company_id {self.company_type}, deduplication_hash string, slot int, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/entries")

    def known(self, keys: DataFrame, batch: str) -> DataFrame:
        """The distinct ``keys`` (company_id, deduplication_hash) that other batches have stored; slots that hold none of them aren't read."""
        keys = cut_lineage(self._slotted(keys.select(*KEY).distinct()))
        entries = self.entries()
        if entries is None:
            return keys.select(*KEY).limit(0)
        slots = [r.slot for r in keys.select("slot").distinct().collect()]  # at most ``slots`` numbers
        return met_by(entries.where(F.col("slot").isin(slots) & (F.col("batch") != batch)), keys.select(*KEY))

    def add(self, keys: DataFrame, batch: str) -> None:
        """Store the fingerprints of a batch, one file per slot."""
        rows = self._slotted(keys.select(*KEY).distinct()).withColumn("batch", F.lit(batch))
        rows.repartition("slot").sortWithinPartitions("slot", "deduplication_hash").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(f"{self.path}/entries")

    def compacted(self, path: str, slots: int | None = None) -> FingerprintIndex:
        """A new index at ``path`` with the same fingerprints under one batch name: many batches leave many small files."""
        fresh = FingerprintIndex(self.spark, path, slots or self.slots, self.company_type)
        entries = self.entries()
        if entries is not None:
            fresh.add(entries, "compacted")
        return fresh
