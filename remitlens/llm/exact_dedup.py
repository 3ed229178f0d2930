"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import look_up, staged, text_of, without_white
from remitlens.session import run_dir


class DigestIndex:
    """Digests of every text seen so far, with the document that stands for each.

    The index is a Parquet table at ``path``, bucketed and sorted by digest, so new data meets it in a sort-merge join for which
    only the new data's digests are shuffled. It outlives the session: opening a ``path`` that holds an index goes on
    with it. ``buckets`` is fixed when the index is made; take about one per 128 MB expected.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.path = path or f"{run_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} (digest binary, keep_id {id_type}, code_points bigint, batch string) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def compacted(self, path: str | None = None) -> DigestIndex:
        """A new index with the same entries, one sorted file per bucket: many appends leave many files."""
        kind = self.entries().schema["keep_id"].dataType.simpleString()
        fresh = DigestIndex(self.spark, path, self.buckets, kind)
        self._stored("").drop("own").select("digest", "keep_id", "code_points", "batch").repartition(self.buckets, "digest").write.insertInto(fresh.table)
        return fresh

    def _stored(self, batch: str) -> DataFrame:
        """One entry per digest, those of other batches than ``batch`` first; the files are bucketed by digest, so nothing is shuffled."""
        one = F.min(F.struct((F.col("batch") == batch).alias("own"), "batch", "keep_id", "code_points")).alias("e")
        return self.entries().groupBy("digest").agg(one).select("digest", "e.*")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` against the index and within themselves, append what is new, and tell the fate of each row.

        Texts are equal when they agree after dropping white space. Of equal texts new to the index the row with the
        most code points stays, then the smallest id (null last), then one of identical rows. A text the index knows is
        dropped whatever its length, and ``keep_id`` names the indexed document. A null text counts as empty; empty texts
        equal each other. Other columns are ignored. One row per row of ``docs``: the id, ``keep_id``, ``group_size`` (rows of
        ``docs`` with the text), ``kept``, ``known`` (indexed before), ``text_sha256``. Empty ``docs`` give no rows.

        ``batch`` names the data: what an earlier run under the same name has indexed is not known to this one, so a job that failed after
        its entries were written can be run again and keeps the same rows. Two writers that add one text at once both keep theirs; later
        batches find one entry.
        """
        batch = batch or uuid.uuid4().hex
        text = text_of(text_col)
        marked = staged(docs.select(
            F.col(id_col).alias("id"), F.length(text).cast("bigint").alias("code_points"), F.unhex(F.sha2(without_white(text), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row")))
        first = F.min(F.struct((-F.col("code_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row"))
        groups = staged(marked.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")))
        fresh = groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("first.id").alias("keep_id"), (-F.col("first.less")).alias("code_points"), F.lit(batch).alias("batch")) \
            .repartition(self.buckets, "digest").write.insertInto(self.table)
        stored = self._stored(batch).select("digest", "keep_id", (~F.col("own")).alias("known")).hint("merge")
        fates = staged(groups.join(stored, "digest").select("digest", "keep_id", "known", F.col("first.row").alias("keep_row"), F.col("n").alias("group_size"), "n"))
        return look_up(marked.select("id", "digest", "row"), fates, ["digest"], "inner", spread="row").select(
            F.col("id").alias(id_col), "keep_id", "group_size", (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"), "known",
            F.lower(F.hex("digest")).alias("text_sha256"))
