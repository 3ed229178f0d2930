"""Target-distribution importance resampling: documents drawn by how much more their words belong to a target corpus.

Words are hashed into buckets; the log ratio of a bucket's share in the target and in the corpus is its gain. A document's weight is the
mean gain of its features, read off the array of gains; Gumbel noise makes the highest scores a draw without replacement. The cutoff is
bracketed by a quantile sketch, the bracket is checked by exact counts outside it and widened until it holds the cutoff, and only
the rows inside are sorted to find it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import staged, text_of

#: bytes to words: A-Z become a-z, digits, a-z and all bytes of other letters stay, anything else is a blank
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: a long text goes by pieces of so many bytes, cut at blanks
PIECE = 1 << 20


@dataclass(frozen=True)
class Resampling:
    """Draw floor(``percent`` * N / 100) of the N documents with at least ``min_words`` words; features are runs of 1 to ``max_run`` words."""

    max_run: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024
    #: how far the sketch may err, as a share of all rows
    sketch_error: float = 0.001


def _pieces(text: str) -> Iterator[bytes]:
    data = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    at = 0
    while len(data) - at > PIECE:
        cut = data.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def bucket_runs(text: str, policy: Resampling) -> Iterator[tuple[int, np.ndarray]]:
    """Words and the buckets of the features that end in each piece of a text, repeats included."""
    before: list[bytes] = []
    for piece in _pieces(text):
        words = piece.split()
        crcs = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        whole = before + words
        for run in range(2, policy.max_run + 1):
            ends = range(max(len(before), run - 1), len(whole))
            crcs.append(np.fromiter((zlib.crc32(b" ".join(whole[e - run + 1 : e + 1])) for e in ends), np.uint32, len(ends)))
        if policy.max_run > 1:
            before = whole[-(policy.max_run - 1):]
        yield len(words), np.concatenate(crcs) % policy.buckets


def bucket_counts(texts: DataFrame, policy: Resampling, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows. A task hands on one row for each bucket it met, so what is shuffled and collected
    is bounded by the number of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(policy.buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, found in bucket_runs(text.as_py(), policy):
                    total += np.bincount(found, minlength=policy.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = texts.select(text_of(text_col).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(policy.buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of shares, bucket by bucket."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.astype(float), target.astype(float))], np.int64)


def gumbel(seed: int, ident: object) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, policy: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                words = features = total = 0
                for n, found in bucket_runs(text.as_py(), policy):
                    words, features, total = words + n, features + len(found), total + int(gains[found].sum())
                weight = total // features if features else 0
                out.append((words, features, weight, weight + gumbel(policy.seed, ident)))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], ["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _order() -> list[Column]:
    """The order of the draw; ``row`` numbers the written rows, so that repeated ids have an order too."""
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of the draw. Sorted by ranges: each partition counts its own rows, and the driver
    adds up one count per partition."""
    low = (1 << 33) - 1
    placed = staged(rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted(counts):
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return placed.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_part")).withColumn(
        "rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit(low)) + 1).drop("_at", "_part", "_start")


@dataclass(frozen=True)
class Bracket:
    """Scores from ``low`` to ``high`` (None: open) and the exact number of rows above and inside."""

    low: int | None
    high: int | None
    above: int
    inside: int


def bracket(pool: DataFrame, drawn: int, total: int, policy: Resampling) -> Bracket:
    """A range of scores that holds the ``drawn``-th highest, from a quantile sketch and checked by exact counts.

    Where the counts say that the cutoff lies outside, the range is widened on that side, twice as far each time, to no end at last.
    """
    def at(share: float) -> Column:
        return F.percentile_approx("score", F.lit(min(max(share, 0.0), 1.0)), F.lit(max(10_000, round(2 / policy.sketch_error))))

    margin, share = policy.sketch_error, 1 - drawn / total
    while True:
        low, high = (r for r in pool.agg(at(share - margin).alias("low"), at(share + margin).alias("high")).first())
        low, high = (None if share - margin <= 0 else low), (None if share + margin >= 1 else high)
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        above, inside = pool.agg(F.count_if(over), F.count_if(~over & ~under)).first()
        if above < drawn <= above + inside:
            return Bracket(low, high, above, inside)
        margin *= 2


def resample(docs: DataFrame, target: DataFrame, policy: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Every document's id, ``n_features``, ``weight``, ``score`` and, where it is drawn, its ``rank`` from 1 (else null).

    A null text counts as empty; an empty one has weight 0. Ties go to the smaller id, null ids last; the noise of a null id is
    that of an empty one. Repeated rows are each a document, and of rows alike in score and id which come first is settled once, when
    they are written. An empty target makes all gains depend on the corpus alone. Other columns are ignored. No documents give no rows.
    """
    gains = bucket_gains(bucket_counts(docs, policy, text_col), bucket_counts(target, policy, target_col))
    # numbered on the way to the file: equal rows must keep their order from here on
    rows = staged(scored(docs, gains, policy, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    pool = rows.where(F.col("n_words") >= policy.min_words)
    total = pool.count()
    drawn = policy.percent * total // 100
    names = ["id", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*names, F.lit(None).cast("bigint").alias("rank")).withColumnRenamed("id", id_col)
    held = bracket(pool, drawn, total, policy)
    over = F.lit(False) if held.high is None else F.col("score") > held.high
    under = F.lit(False) if held.low is None else F.col("score") < held.low
    last = ranked(pool.where(~over & ~under).select("score", "id", "row")).where(F.col("rank") == drawn - held.above).first()
    same = F.col("score") == last.score
    before = F.col("id").isNotNull() if last.id is None else F.coalesce(F.col("id") < F.lit(last.id), F.lit(False))
    tied = F.col("id").eqNullSafe(F.lit(last.id)) & (F.col("row") <= last.row)
    taken = (F.col("n_words") >= policy.min_words) & ((F.col("score") > last.score) | (same & (before | tied)))
    out = ranked(rows.where(taken)).select(*names, "rank").unionByName(rows.where(~taken).select(*names, F.lit(None).cast("bigint").alias("rank")))
    return out.withColumnRenamed("id", id_col)
