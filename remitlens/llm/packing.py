"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import text_of
from remitlens.llm.word_pieces import CACHE_BYTES, encoder

TIERS = (2048, 1024, 512, 256)
#: sequences of a partition are numbered within so many bits
CUT_ID_BITS = 33
#: documents packed before their windows are handed on
BATCH_DOCS = 1_000

Piece = tuple[int, int, int]  # document, start, length
Window = tuple[int, list[Piece]]  # tier, pieces from offset 0


class Tiers:
    """Packs documents of known lengths into windows of several sizes.

    Whole windows of the longest tier are cut off long documents. What is left goes to the shortest tier that holds
    it. Windows are opened from the longest tier down, each by its longest waiting document; the gap takes the longest document
    that fits, from this tier or a shorter one, again and again, and where nothing fits a waiting document is cut to the gap. So each
    window is full, and a document is cut only where no whole one fits. ``rest`` is called once at the end: what is left then
    is laid end to end and cut at powers of two, which need no padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        if any(t < 1 or t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.waiting: dict[int, list[Piece]] = defaultdict(list)  # by length
        self.lengths = 0  # bit n is set if a piece of length n waits
        self.tokens = 0

    def _put(self, piece: Piece) -> None:
        self.waiting[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]
        self.tokens += piece[2]

    def _take(self, length: int) -> Piece:
        stack = self.waiting[length]
        piece = stack.pop()
        if not stack:
            self.lengths &= ~(1 << length)
        self.tokens -= length
        return piece

    def add(self, doc: int, length: int) -> Iterator[Window]:
        top, at = self.tiers[0], 0
        while length - at >= top:
            yield top, [(doc, at, top)]
            at += top
        if length > at:
            self._put((doc, at, length - at))

    def _fill(self, tier: int, pieces: list[Piece]) -> list[Piece]:
        gap = tier - sum(p[2] for p in pieces)
        while gap:
            fit = (self.lengths & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if fit > 0:
                pieces.append(self._take(fit))
            else:
                shortest = (self.lengths & -self.lengths).bit_length() - 1
                doc, start, length = self._take(shortest)
                pieces.append((doc, start, gap))
                self._put((doc, start + gap, length - gap))
            gap = tier - sum(p[2] for p in pieces)
        return pieces

    def pack(self) -> Iterator[Window]:
        """Full windows from what waits, longest tier first, while a tier's own documents and shorter ones can fill them."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.tokens >= tier:
                longest = (self.lengths & ((1 << (tier + 1)) - 1)).bit_length() - 1
                if longest <= below:
                    break  # none of this tier waits: the others belong to shorter windows
                yield tier, self._fill(tier, [self._take(longest)])

    def rest(self) -> Iterator[Window]:
        left = [p for stack in self.waiting.values() for p in stack]
        self.waiting.clear()
        self.lengths = self.tokens = 0
        total, tier = sum(p[2] for p in left), self.tiers[0]
        while total:
            while tier > total:
                tier //= 2
            pieces, gap = [], tier
            while gap:
                doc, start, length = left.pop()
                used = min(gap, length)
                pieces.append((doc, start, used))
                if used < length:
                    left.append((doc, start + used, length - used))
                gap -= used
            total -= tier
            yield tier, pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Tokenize every document, end it with ``end_id`` and pack all into sequences of ``tiers`` tokens, without padding.

    Each partition is packed by itself as it streams through, so nothing is shuffled and a task holds BATCH_DOCS documents and those that wait; a
    partition's last tokens make at most one window of each power of two. A retried task gives the same rows. One row per piece:
    the id, ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of little-endian 32-bit ids), ``doc_tokens`` (with the
    end), ``sequence_id`` (unique; the partition's number in its high bits), ``offset`` in the sequence, ``window`` (its size) and
    ``step`` (windows of one size and one step of a
    partition make a step group; each holds ``step_tokens`` tokens, but for the last of its size). With ``with_ids`` also the ids.
    A worker keeps known words in two caches of ``cache_bytes`` each; smaller ones take more time and give the same rows.
    Every row is packed: a null text counts as empty and is one end id; a null id stays null; repeated rows are packed each.
    Other columns are ignored. Empty ``docs`` give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = encoder(tokenizer_path, cache_bytes).encode, TaskContext.get().partitionId() << CUT_ID_BITS, 0
        per_tier: dict[int, int] = defaultdict(int)
        packer, held = Tiers(tiers), {}

        def table(windows: list[Window]) -> pa.RecordBatch:
            nonlocal made
            out: dict[str, list] = {n: [] for n in names}
            for tier, pieces in windows:
                offset, per = 0, max(1, step_tokens // tier)
                for doc, start, length in pieces:
                    ident, ids = held[doc]
                    part = ids[start : start + length].astype("<u4")
                    values = (ident, start, length, zlib.crc32(part), len(ids), base + made, offset, tier, per_tier[tier] // per)
                    for n, v in zip(names, values):
                        out[n].append(v)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                    offset += length
                made, per_tier[tier] = made + 1, per_tier[tier] + 1
            types = [id_type, *[pa.int64()] * 8, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)

        doc, id_type = 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in (batch.slice(at, BATCH_DOCS) for at in range(0, batch.num_rows, BATCH_DOCS)):
                windows = []
                for ident, text in zip(part.column("id"), part.column("text")):
                    ids = np.append(encode(text.as_py()), np.uint16(end_id))
                    held[doc] = (ident.as_py(), ids)
                    windows += packer.add(doc, len(ids))
                    doc += 1
                windows += packer.pack()
                yield table(windows)
                waiting = {p[0] for stack in packer.waiting.values() for p in stack}
                held = {k: v for k, v in held.items() if k in waiting}
        if id_type is not None:
            yield table(list(packer.rest()))

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
