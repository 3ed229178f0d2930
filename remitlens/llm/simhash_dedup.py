"""SimHash near-dedup: 64-bit fingerprints compared exactly in tiles of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import digest, look_up, staged, text_of
from remitlens.llm.components import components
from remitlens.session import scratch

SEED = 42
BITS = 64


def fingerprint(text: str, size: int = 3, chunk: int = 1 << 16) -> int:
    """Bit i is set if it is set in over half the XXH64 hashes of the word shingles (repeats count); 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six white-space characters
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    ones, total, hash_of = np.zeros(BITS, np.int64), 0, xxhash.xxh64_intdigest
    while True:
        part = np.fromiter((hash_of(s, SEED) for s in islice(shingles, chunk)), np.uint64)
        if not len(part):
            break
        total += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, ``key`` (of id and text), fingerprint (as a signed long) and row number of every document; whole texts, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(prints, pa.int64())], ["id", "key", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key binary, fp bigint").withColumn("row", F.monotonically_increasing_id())


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``radius`` bits of each other: a star for each group, not every pair.

    Compares all of ``left`` with all of ``right``, ``rows`` at a time, by exclusive-or and bit counts.
    """
    pairs = []
    for i in range(0, len(left), rows):
        a, b = np.nonzero(np.bitwise_count(left[i : i + rows, None] ^ right[None, :]) <= radius)
        pairs.append((a.astype(np.int32) + np.int32(i), b.astype(np.int32)))
    at, to = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    values, place = np.unique(np.concatenate([left[at], right[to]]), return_inverse=True)
    at, to, label = place[: len(at)], place[len(at) :], np.arange(len(values))
    while True:
        low = np.minimum(label[at], label[to])
        new = label.copy()
        np.minimum.at(new, at, low)
        np.minimum.at(new, to, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(values))
    return values[far], values[label[far]]


def _counts(blocks: int) -> list[Column]:
    width = BITS // blocks
    if blocks == 1:
        return [F.bit_count("fp").cast("int")]
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask).cast("bigint"))).cast("int") for k in range(blocks)]


def near_links(prints: DataFrame, radius: int = 2, tile: int = 2048, blocks: int = 4) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) at most ``radius`` bits apart, enough to connect all that belong together.

    Fingerprints are cut into tiles by the population counts of their ``blocks`` equal parts. Flipping a bit changes one of those
    counts by one, so tiles whose counts differ by more than ``radius`` in sum hold no link and are never paired; the others
    are compared in full. Parts narrow what is compared (4 parts: about 1 pair in 100); use 8 from some 10^8 fingerprints on.
    A tile holds about ``tile`` values, so a task's memory is bounded however many fall into one class of counts.
    """
    base = BITS // blocks + 1
    key = sum((c * base**k for k, c in enumerate(_counts(blocks))), F.lit(0)).cast("bigint")
    cells = prints.select("fp", key.alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    cells = look_up(cells, staged(sizes.withColumn("n", F.col("parts"))), ["cell"], "inner", spread="fp")
    tiles = staged(cells.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
                   .groupBy("cell", "part").agg(F.collect_list("fp").alias("values")).withColumn("tile", F.monotonically_increasing_id()))
    # each unordered pair of neighbouring classes once: the class itself and the steps whose first non-zero count is positive
    steps = [s for s in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, s)) <= radius and (not any(s) or next(x for x in reversed(s) if x) > 0)]
    digits = [F.floor(F.col("cell") / F.lit(base**k)) % base for k in range(blocks)]
    inside = lambda s: [(digits[k] + s[k]).between(0, base - 1) for k in range(blocks) if s[k]]
    jumps = F.array(*[F.when(_all(inside(s)), F.lit(sum(s[k] * base**k for k in range(blocks))).cast("bigint")) for s in steps])
    ids = tiles.select("cell", "tile")
    pairs = ids.select(F.col("tile").alias("t1"), F.col("cell").alias("c1"), F.explode(F.filter(jumps, lambda j: j.isNotNull())).alias("jump")) \
        .select("t1", "c1", (F.col("c1") + F.col("jump")).alias("c2")) \
        .join(ids.select(F.col("cell").alias("c2"), F.col("tile").alias("t2")), "c2").where("c1 <> c2 or t1 <= t2").select("t1", "t2")
    work = pairs.join(tiles.select(F.col("tile").alias("t1"), F.col("values").alias("left")), "t1") \
        .join(tiles.select(F.col("tile").alias("t2"), F.col("values").alias("right")), "t2").select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = tile_links(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right)), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return work.mapInArrow(run, "a bigint, b bigint")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


@scratch()
def without_near_copies(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that ``near_dedup`` finds, that of the smallest id; the columns of ``docs``.

    Nulls and empty texts are grouped as there; of rows that repeat each other one stays.
    """
    return keep_one(docs, near_dedup(docs, radius, size, id_col, text_col), id_col, text_col)


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows that ``groups`` (``key``, ``kept``, a row per row of ``docs``) doesn't keep."""
    # rows of one id and text have one key; only keys that lose a row are looked up
    losing = staged(groups.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("kept").alias("stays")).where("not stays or n > 1"), keep=True)
    rows = docs.select(F.struct("*").alias("doc"), row_key(id_col, text_col).alias("key"))
    met = look_up(rows, losing, ["key"], "left", spread="key")
    whole = met.where("stays is null").select("doc.*")
    if losing.where("stays").isEmpty():
        return whole
    return whole.union(met.where("stays").groupBy("key").agg(F.first("doc").alias("doc")).select("doc.*"))


def row_key(id_col: str, text_col: str) -> Column:
    return digest(F.col(id_col), digest(text_of(text_col)))


def near_dedup(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = 2048, blocks: int = 4) -> DataFrame:
    """Groups of documents whose fingerprints are connected by links of at most ``radius`` bits.

    One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id of the group; null only if
    all its ids are null) and ``kept``: true for one row of each group, that of the smallest id; ``key`` (of id and text). A null text counts as empty, and texts
    without words have fingerprint zero, which links like any other. Rows with equal text are linked; repeated rows come
    back as often as they came. Other columns are ignored. Empty ``docs`` give no rows.
    """
    rows = staged(fingerprints(docs, id_col, text_col, size))
    prints = staged(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("low")))
    links = staged(near_links(prints.select("fp"), radius, tile, blocks))
    roots = prints.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = roots.groupBy("root").agg(F.min("low").alias("lowest"))
    groups = staged(roots.join(lows, "root").select("fp", "n", F.col("lowest.id").alias("component_id"), F.col("lowest.row").alias("keep_row")))
    return look_up(rows, groups, ["fp"], "inner", spread="row").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row") == F.col("keep_row")).alias("kept"), "key")
