"""Token ids in files: canonical Huffman codes of limited length, decoded by table in independent blocks.

The format. A folder holds ``codebook``, one row with the code length of every id, and ``segments``, whose rows are runs of whole documents:
``part`` and ``first`` (where the run starts: its part, and the ids before it there), ``ids`` and ``sizes`` of its documents, the bit stream
``data``, and ``checkpoints``, the bit offset of every ``BLOCK``-th id as little-endian 64-bit numbers. Codes are canonical: they follow from the
lengths alone, shorter first and smaller ids first within a length, and are written from the highest bit down. A block is BLOCK ids
(the last of a segment fewer) and can be decoded by itself from its checkpoint. The parts are in order, so are the segments of a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import staged, text_of
from remitlens.llm.word_pieces import encoder

#: ids between checkpoints
BLOCK = 256
#: a segment ends with the document that fills it
SEGMENT_IDS = 1 << 18
#: longest code; a table of 2^20 entries decodes any of them in one step
MAX_BITS = 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol (0: never seen) of the least total size with no code over ``max_bits``: package-merge.

    Each of the ``max_bits`` levels pairs what the level below chose and merges the pairs with the symbols; walking back down, the
    symbols among a level's chosen items get one bit more.
    """
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(seen) > 1 << max_bits:
        raise ValueError(f"{len(seen)} symbols don't fit into codes of {max_bits} bits")
    if len(seen) < 2:
        out[seen] = 1
        return out
    order = seen[np.argsort(counts[seen], kind="stable")]
    weights = counts[order].astype(object if counts.sum() > 1 << 55 else np.int64)
    levels, packages = [], weights[:0]
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < len(weights))  # which items are symbols
        merged = merged[by_weight]
        packages = merged[0 : len(merged) - 1 : 2] + merged[1::2]
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes that follow from the lengths."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order].astype(np.int64)
    longest = int(sizes.max(initial=0))
    starts = np.concatenate([[0], np.cumsum(1 << (longest - sizes))])[:-1] if len(sizes) else np.zeros(0, np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (starts >> (longest - sizes)).astype(np.uint64)
    return codes


class Codec:
    """Writes and reads bit streams of one codebook."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.uint64), canonical_codes(lengths)
        self.bits = int(lengths.max(initial=1))
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        # every value of the next bits: the symbol it starts with and that symbol's length
        table = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order].astype(np.uint32), spans)
        self.table = np.concatenate([table, np.zeros((1 << self.bits) - len(table), np.uint32)])

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every BLOCK-th id."""
        sizes = self.lengths[ids]
        if len(ids) and not sizes.min():
            raise ValueError("an id that the codebook doesn't know")
        ends = np.cumsum(sizes)
        at = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros((total >> 5) + 3, np.uint64)
        word, shift = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
        wide = self.codes[ids] << (np.uint64(64) - sizes - shift)  # a code spans at most two words of 32 bits
        if len(ids):
            runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))  # codes don't overlap, so a sum is an "or"
            words[word[runs]] += np.add.reduceat(wide >> np.uint64(32), runs)
            words[word[runs] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), runs)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::BLOCK].astype("<u8")

    def read(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a stream, all blocks at once: a step reads one id of every block."""
        out = np.zeros((len(checkpoints), BLOCK), np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32)
        if not n:
            return out.reshape(-1)[:0]
        padded = np.frombuffer(data + bytes(-len(data) % 4 + 8), ">u4").astype(np.uint64)
        pairs = padded[:-1] << np.uint64(32) | padded[1:]
        at, low, five = checkpoints.astype(np.uint64), np.uint64(31), np.uint64(5)
        down, steps = np.uint64(64 - self.bits), min(BLOCK, n)
        last = n - (len(checkpoints) - 1) * BLOCK
        for step in range(steps):
            if step == last:
                at = at[:-1]  # the last block is shorter
            entry = self.table[(pairs[at >> five] << (at & low)) >> down]
            out[: len(at), step] = entry >> 5
            at = at + (entry & np.uint32(31))
        return out.reshape(-1)[:n]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` and ``ids`` (16-bit little-endian bytes) of every row, with the end id."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encode(t.as_py()).astype("<u2").tobytes() + end for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, ids binary")


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs. A task hands on one row for each id it met; what is collected is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for ident, n in rows.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():
        out[ident] = n
    return out


@lru_cache(maxsize=2)
def _codec(lengths: bytes) -> Codec:
    return Codec(np.frombuffer(lengths, np.uint8))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, end it with ``end_id`` and write all ids to a new folder ``path``, in ascending order of the id column.

    Texts are encoded once. The ids, not the texts, are dealt by ranges of the id and sorted; counting reads them from the files. Segments
    hold whole documents. A null text counts as empty and is one end id. Null ids come first; repeated ids are documents of their own,
    in any order that then stays. Other columns are ignored. Without documents the folder has a codebook and no segment.
    """
    size = 1 << 16
    rows = staged(encoded(docs, tokenizer_path, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    lengths = code_lengths(id_counts(rows, size))
    spark, kind, known = docs.sparkSession, rows.schema["id"].dataType, lengths.tobytes()
    spark.createDataFrame([(bytearray(known),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    names = ["part", "first", "ids", "sizes", "data", "checkpoints"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, first = _codec(known), TaskContext.get().partitionId(), 0
        held: list[tuple[object, np.ndarray]] = []
        waiting, id_type = 0, None

        def segment() -> pa.RecordBatch:
            nonlocal first
            ids = np.concatenate([i for _, i in held])
            data, checkpoints = codec.write(ids)
            values = [[part], [first], [[d for d, _ in held]], [[len(i) for _, i in held]], [data], [checkpoints.tobytes()]]
            first += len(ids)
            types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

        for batch in batches:
            id_type = batch.column("id").type
            for ident, ids in zip(batch.column("id").to_pylist(), batch.column("ids")):
                held.append((ident, np.frombuffer(ids.as_py(), "<u2")))
                waiting += len(held[-1][1])
                if waiting >= SEGMENT_IDS:
                    yield segment()
                    held, waiting = [], 0
        if held:
            yield segment()

    in_order = [F.col("id").asc_nulls_first(), F.col("row").asc()]
    ordered = rows.repartitionByRange(*in_order).sortWithinPartitions(*in_order).select("id", "ids")
    made = ordered.mapInArrow(segments, f"part bigint, first bigint, ids array<{kind.simpleString()}>, sizes array<bigint>, data binary, checkpoints binary")
    made.write.option("compression", "none").parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files of ``write_token_files``: one row per document with ``id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of its ids as little-endian 32-bit numbers) and, with ``with_ids``, its ids.

    Each segment is decoded by itself; only one number per part goes through the driver.
    """
    known = bytes(spark.read.parquet(f"{path}/codebook").first().lengths)
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    counts = segments.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, n: s + n)).alias("n"))
    starts, total = [], 0
    for part, n in sorted(counts.collect()):
        starts.append((part, total))
        total += n
    names = ["id", "start", "n_tokens", "ids_crc32", *["token_ids"] * with_ids]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(known)
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in ("first", "ids", "sizes", "data", "checkpoints")}
                sizes = np.array(one["sizes"].as_py(), np.int64)
                ids = codec.read(one["data"].as_py(), np.frombuffer(one["checkpoints"].as_py(), "<u8"), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                each = [ids[e - n : e] for e, n in zip(ends, sizes)]
                columns = [one["ids"].values, pa.array(one["first"].as_py() + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(i) for i in each], pa.int64())]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("part")[row].as_py()] * len(sizes), pa.int64()), *columns], ["part", *names])

    rows = segments.mapInArrow(decoded, f"part bigint, id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids)
    offsets = spark.createDataFrame(starts, "part bigint, before bigint")
    placed = rows.join(F.broadcast(offsets), "part")
    return placed.select("id", (F.col("start") + F.col("before")).alias("start"), *names[2:])
