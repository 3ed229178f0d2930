"""The statement import as a file stream.

Each micro-batch of new files goes through the batch import against an index of the fingerprints stored so far, of which it reads the
slots it can meet, so a fingerprint is never imported twice, however far apart its copies arrive. Batches are written to
numbered folders: one that is run again after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from remitlens.operators.imports import payments_from_transactions
from remitlens.plans.statement_import import import_statements
from remitlens.sources.fingerprint_index import FingerprintIndex
from remitlens.sources.tables import replace_batch

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_stored(spark: SparkSession, path: str, before_batch: int) -> DataFrame | None:
    """What earlier batches stored; NULL before the first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return None
    return spark.read.parquet(path).where(F.col("batch") < before_batch)


def import_stream(
    spark: SparkSession, landing: str, out: str, checkpoint: str, company_of, account_of=None,
    max_files: int = 1000, default_currency: str = "INR", slots: int = 256,
) -> StreamingQuery:
    """Import statement files as they land under ``landing``.

    ``company_of`` and ``account_of`` turn the file path column into the company and the account.
    Results go to ``out/transactions``, ``out/payments`` and ``out/report``, fingerprints to ``out/fingerprints``.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", max_files).load(landing)
    named = files.select(
        F.col("path").alias("file_name"), "content", company_of(F.col("path")).alias("company_id"),
        (F.lit(None).cast("string") if account_of is None else account_of(F.col("path"))).alias("bank_account_number"))

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        reports = read_stored(session, f"{out}/report", batch_id)
        index = FingerprintIndex(session, f"{out}/fingerprints", slots, batch.schema["company_id"].dataType.simpleString())
        result = import_statements(batch, reports, index, default_currency, batch=str(batch_id))
        replace_batch(result.transactions, f"{out}/transactions", batch_id)
        written = session.read.parquet(f"{out}/transactions/batch={batch_id}")
        index.add(written, str(batch_id))
        replace_batch(payments_from_transactions(written), f"{out}/payments", batch_id)
        replace_batch(result.report, f"{out}/report", batch_id)

    return named.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
