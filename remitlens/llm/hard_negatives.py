"""Hard negatives for contrastive training: a secondary-sort shuffle of pair scores, read as a stream.

Pairs of anchors and rows are scored in blocks of numpy products. A score and what it belongs to become one binary key (anchor,
descending score, positive before negative, id); ``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts each
partition, spilling where it must. One pass over a partition then holds the open windows of the anchor at hand, one for each
positive, and nothing else. Before the shuffle each task drops the pairs that its own better ones already shut out, which no
window can miss: the positives are settled first, so the windows are known when negatives are scored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import staged

LONG = 1 << 63
NONE = -LONG  # no score is that low
KEY = struct.Struct(">QQBQ")  # anchor, score descending, 0 positive or 1 negative, id; as bytes they sort like the tuple
#: rows and pairs scored at once
BLOCK_ROWS, BLOCK_PAIRS = 1 << 13, 1 << 21


@dataclass(frozen=True)
class NegativePolicy:
    """The first ``positives`` rows of the anchor's label open a window each; the first ``negatives`` rows of other labels with
    ``low`` * positive_score <= ``high`` * negative_score <= ``high`` * positive_score fill it (``low`` <= ``high``). Components count as
    floor(``scale`` * x). At most ``round_bytes`` of anchors are broadcast at a time."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    round_bytes: int = 16 << 20


def key_of(anchor: int, score: int, negative: bool, ident: int) -> bytes:
    return KEY.pack(anchor + LONG, LONG - score, negative, ident + LONG)


def parts_of(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, ident = KEY.unpack(key)
    return anchor - LONG, LONG - score, bool(negative), ident - LONG


def first_positives(keys: Iterator[bytes], n: int) -> Iterator[tuple[int, int, int]]:
    """The first ``n`` of each anchor's sorted keys as (anchor, score, id)."""
    at, seen = None, 0
    for anchor, score, _, ident in map(parts_of, keys):
        seen = seen + 1 if anchor == at else 1
        at = anchor
        if seen <= n:
            yield anchor, score, ident


def windows(keys: Iterator[bytes], policy: NegativePolicy) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Sorted keys to (anchor, positive, rank, negative, positive score, negative score), holding one anchor's open windows only."""
    at, opened = None, []
    for anchor, score, negative, ident in map(parts_of, keys):
        if anchor != at:
            at, opened = anchor, []
        if not negative:
            opened.append([ident, score, 0])
            continue
        # scores only fall: a window left below stays left
        opened = [w for w in opened if w[2] < policy.negatives and policy.low * w[1] <= policy.high * score]
        for window in opened:
            window[2] += 1
            yield anchor, window[0], window[2], ident, window[1], score


def whole_vectors(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of finite numbers, and their components as whole numbers in doubles; short vectors end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum())) if len(vectors) else vectors.values
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # nulls are NaN here
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = np.ones(len(sizes), bool)
    good[owner[~np.isfinite(values)]] = False
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[owner, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * values)
    return good, out[good]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers; one that doesn't fit becomes the nearest that does."""
    width = max(left.shape[1], right.shape[1])
    left, right = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (left, right))
    most = width * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if most < 1 << 24:  # so every partial sum is exact in single precision
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (left @ right.T).astype(np.int64)
    whole = np.vectorize(lambda x: int(min(max(x, -1e300), 1e300)), otypes=[object])
    exact = whole(left).dot(whole(right).T)
    return np.clip(exact, NONE + 1, LONG - 1).astype(np.int64).reshape(len(left), len(right))


class Best:
    """The ``n`` highest (score, then smallest id) rows of each of ``size`` groups, kept up as blocks of rows come by."""

    def __init__(self, size: int, n: int):
        self.n = n
        self.score, self.id, self.row = np.full((size, n), NONE), np.zeros((size, n), np.int64), np.zeros((size, n), np.int64)

    def add(self, groups: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` has a row for each of ``groups`` and a column for each of ``ids``, which rise."""
        if not allowed.any():
            return
        columns, k = scores.shape[1], min(self.n, scores.shape[1])
        least, most = int(np.min(scores, where=allowed, initial=LONG - 1)), int(np.max(scores, where=allowed, initial=NONE))
        if (most - least + 1) * columns < LONG:  # a score and a column in one number
            order = np.where(allowed, (np.maximum(scores, least) - least) * columns + np.arange(columns)[::-1], -1)
            top = np.argpartition(order, columns - k, axis=1)[:, columns - k:]
        else:
            top = np.argsort(~np.where(allowed, scores, NONE), axis=1, kind="stable")[:, :k]
        taken = np.take_along_axis(np.where(allowed, scores, NONE), top, 1)
        score = np.concatenate([self.score[groups], taken], 1)
        ident = np.concatenate([self.id[groups], ids[top]], 1)
        row = np.concatenate([self.row[groups], rows[top]], 1)
        first = np.lexsort((ident, ~score), axis=1)[:, : self.n]  # ~ turns the order round without overflow
        self.score[groups], self.id[groups], self.row[groups] = (np.take_along_axis(a, first, 1) for a in (score, ident, row))


@dataclass
class Anchors:
    """One round of anchors; ``found`` holds the scores of each one's positives, NONE beyond the last."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    found: np.ndarray | None = None


def _scored(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: int):
    """Blocks of pairs: which anchors, scores, same label and other label, ids and ordinals of the rows."""
    seen = 0
    for batch in batches:
        for piece in (batch.slice(i, BLOCK_ROWS) for i in range(0, batch.num_rows, BLOCK_ROWS)):
            good, vectors = whole_vectors(piece.column("vector"), scale)
            ids, labels = (piece.column(c).to_numpy(zero_copy_only=False)[good] for c in ("id", "label"))
            order = np.argsort(ids, kind="stable")  # columns rise with the id: ties go to the smaller one
            ids, labels, vectors, rows = ids[order], labels[order], vectors[order], seen + order
            seen += len(ids)
            step = max(1, BLOCK_PAIRS // max(1, len(ids)))
            for at in range(0, len(anchors.ids) if len(ids) else 0, step):
                chosen = slice(at, at + step)
                scores = products(anchors.vectors[chosen], vectors)
                other_row = anchors.ids[chosen, None] != ids
                same = anchors.labels[chosen, None] == labels
                yield chosen, scores, same & other_row, ~same & other_row, ids, rows


def _keys(anchors: np.ndarray, best: Best, per_anchor: int, negative: bool) -> pa.RecordBatch:
    """Keys of all that ``best`` kept; a row that several windows of an anchor kept has one key."""
    group, _ = found = np.nonzero(best.score != NONE)
    pairs = np.stack([group // per_anchor, best.row[found]])
    _, once = np.unique(pairs, axis=1, return_index=True)
    keys = [key_of(int(a), int(s), negative, int(i)) for a, s, i in zip(anchors[pairs[0, once]], best.score[found][once], best.id[found][once])]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])


def _sorted_keys(rows: DataFrame) -> RDD:
    """The secondary sort: keys dealt by anchor, each partition in key order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8])).keys()


def _rounds(anchors: DataFrame, policy: NegativePolicy) -> list[DataFrame]:
    """Anchors cut by hash into parts of at most ``round_bytes`` each (or one anchor)."""
    once = staged(anchors.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.*"))
    weight, pieces = F.sum(F.lit(64) + 8 * F.size("vector")).alias("bytes"), 1
    while True:
        part = F.pmod(F.xxhash64("id"), F.lit(pieces))
        sizes = once.groupBy(part.alias("part"), "id").agg(weight).groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        if all(s.bytes <= policy.round_bytes or s.n == 1 for s in sizes):
            return [once.where(part == s.part) for s in sizes]
        pieces *= 2


def _round(rows: DataFrame, chosen: DataFrame, policy: NegativePolicy) -> RDD | None:
    """Windows of one round of anchors."""
    spark = rows.sparkSession
    table = chosen.toArrow().combine_chunks()
    good, vectors = whole_vectors(table.column("vector").chunk(0), policy.scale) if table.num_rows else (np.zeros(0, bool), np.zeros((0, 0)))
    if not good.any():
        return None
    anchors = Anchors(*(table.column(c).to_numpy()[good] for c in ("id", "label")), vectors)
    known = spark.sparkContext.broadcast(anchors)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = known.value
        best = Best(len(ours.ids), policy.positives)
        for at, scores, same, _, ids, ordinals in _scored(batches, ours, policy.scale):
            best.add(at, scores, same, ids, ordinals)
        yield _keys(ours.ids, best, 1, False)

    ranked = _sorted_keys(rows.mapInArrow(positives, "key binary")).mapPartitions(lambda keys: first_positives(keys, policy.positives))
    settled = staged(spark.createDataFrame(ranked, "anchor bigint, score bigint, id bigint", verifySchema=False))
    at = {int(a): i for i, a in enumerate(anchors.ids)}
    anchors.found = np.full((len(anchors.ids), policy.positives), NONE)
    filled = np.zeros(len(anchors.ids), int)
    for anchor, score in zip(*(settled.select("anchor", "score").toArrow().column(c).to_pylist() for c in ("anchor", "score"))):
        anchors.found[at[anchor], filled[at[anchor]]] = score
        filled[at[anchor]] += 1
    opened = spark.sparkContext.broadcast(anchors)

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, per = opened.value, policy.positives
        best = Best(len(ours.ids) * per, policy.negatives)
        least = np.array([[-(-policy.low * int(p) // policy.high) for p in ps] for ps in ours.found])
        for at, scores, _, other, ids, ordinals in _scored(batches, ours, policy.scale):
            for k in range(per):
                top, low = ours.found[at, k, None], least[at, k, None]
                window = slice(at.start * per + k, min(at.stop, len(ours.ids)) * per, per)
                best.add(window, scores, other & (top != NONE) & (scores <= top) & (scores >= low), ids, ordinals)
        yield _keys(ours.ids, best, per, True)

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(*pair) for pair in zip(batch.column("anchor").to_pylist(), batch.column("score").to_pylist(), [False] * batch.num_rows, batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    both = rows.mapInArrow(negatives, "key binary").unionByName(settled.mapInArrow(opening, "key binary"))
    return _sorted_keys(both).mapPartitions(lambda keys: windows(keys, policy))


def hard_negatives(rows: DataFrame, is_anchor: Column, policy: NegativePolicy = NegativePolicy(), id_col: str = "vec_id",
                   label: Column | str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives, the negatives that lie at most just below the positive.

    Rows score by the inner product of their whole-number vectors; higher scores come first, ties by smaller id. Returns ``anchor_id``,
    ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    All rows are scored against all anchors, a bounded block at a time. Anchors come in rounds of at most ``round_bytes``; each round reads
    the rows twice, and a task hands on at most ``positives`` * (1 + ``negatives``) keys for an anchor, however many rows it read.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. An empty vector scores 0; a shorter vector
    counts as ending in zeros. A repeated row counts each time. Rows with an anchor's own id are never its positives or negatives; of
    several anchor rows with one id the least (label, vector) counts. A score beyond 64 bits counts as the nearest that fits. Other
    columns are ignored. No rows, no anchors or no positives give no result rows.
    """
    spark, one = rows.sparkSession, F.col(label) if isinstance(label, str) else label
    usable = rows.select(F.col(id_col).cast("bigint").alias("id"), one.cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
                         F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).where("id is not null and label is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = [_round(usable.select("id", "label", "vector"), part, policy) for part in _rounds(usable.where(F.col("is_anchor") & finite).drop("is_anchor"), policy)]
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    made = [spark.createDataFrame(f, schema, verifySchema=False) for f in found if f is not None]
    out = made[0] if made else spark.createDataFrame([], schema)
    for more in made[1:]:
        out = out.unionByName(more)
    return out
