"""SentencePiece encoding and decoding with a BPE model, by forward scores shared between words with a common prefix."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from remitlens.llm.common import text_of

MARK = "▁"
#: entries kept of words and of pairs of pieces
CACHE_WORDS, CACHE_FITS = 400_000, 1_000_000


class PrefixViterbi:
    """Encodes sorted words depth-first over the trie of their prefixes.

    The forward score of a prefix is the last piece of its encoding, with the prefix before it as back pointer. A piece may
    end a prefix if merging it with the piece before it by the model's ranks gives the two back; exactly one candidate
    passes, and the path of such pieces is what the merges give for the whole word. (The model is a BPE
    model: the path of the highest score sum is a different one.) Going from a word to the next in sorted order keeps the scores
    of the common prefix.
    """

    def __init__(self, path: str):
        self.processor = SentencePieceProcessor(model_file=path)
        sp, size = self.processor, self.processor.get_piece_size()
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special(i)}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # the longest piece for each three characters that a piece ends with
        self.tails: dict[str, int] = {}
        for p in self.ids:
            if len(p) >= 3:
                self.tails[p[-3:]] = max(len(p), self.tails.get(p[-3:], 0))
        if size > 1 << 16 or any(MARK in p.lstrip(MARK) for p in self.ids) or {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError(f"{path}: pieces that go over words or hold characters without a piece, or ids over 16 bits")
        # no piece holds a line end or a mark after other characters, so no merge goes over these cuts
        self.cuts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if not any("\n" in p for p in self.ids) else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.out = [b"" if sp.is_control(i) else bytes([self.bytes.index(i)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i)
                    else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]

    def merged(self, text: str) -> list[str]:
        """The model's merges of a short text, the best score first, the leftmost of equals."""
        parts, get, none = list(text), self.scores.get, -np.inf
        pairs = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def fit(self, before: int, piece: int) -> bool:
        """Whether merging the two pieces' text gives them back. ``before`` is -1 at the start and after a character without a piece."""
        key = (before + 1) << 16 | piece
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE_FITS:
                self.fits.clear()
            first = self.pieces.get(before, "")
            known = self.fits[key] = self.merged(first + self.pieces[piece]) == [*[first] * bool(first), self.pieces[piece]]
        return known

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Words, to be given in sorted order, with their ids as 16-bit numbers."""
        last, size = [-1], [0]  # of the piece that ends the first i characters: its id (-1: a character without one), its length
        previous, ids, fits, tails = "", self.ids, self.fits, self.tails
        for word in words:
            common, most = 0, min(len(previous), len(word))
            while common < most and previous[common] == word[common]:
                common += 1
            del last[common + 1 :], size[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                longest = tails.get(word[end - 3 : end], 2) if end >= 3 else end
                for start in range(end - longest if end > longest else 0, end):
                    piece = ids.get(word[start:end])
                    if piece is None:
                        continue
                    fitting = fits.get((last[start] + 1) << 16 | piece)
                    if fitting or (fitting is None and self.fit(last[start], piece)):
                        last.append(piece)
                        size.append(end - start)
                        break
                else:  # no piece holds the character, so no merge does
                    last.append(-1)
                    size.append(1)
            previous, at, out = word, len(word), array("H")
            while at:
                if last[at] >= 0:
                    out.append(last[at])
                else:
                    out.extend([self.bytes[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))])
                at -= size[at]
            out.reverse()
            yield word, out.tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; words of the batch that the cache lacks are sorted and encoded together."""
        cut = [self.cuts.findall(self.processor.normalize(t)) for t in texts]
        new = {w for words in cut for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = {w for words in cut for w in words}
        self.words.update(self.encode_words(sorted(new)))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint16) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: pieces joined, bytes read as UTF-8, the mark before the first word taken off."""
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and len(ids) and out[ids[0]].startswith(b" ") else text


def by_size(texts: pa.Array, most: int = 1 << 21) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters, so that the words held at once don't grow with the batch."""
    part, size = [], 0
    for value in texts:
        text = value.as_py()
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def codec(path: str) -> PrefixViterbi:
    return PrefixViterbi(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """The id and ``ids`` of every row, the same as the sentencepiece library's; with ``verify`` also ``round_trip``, whether decoding them gives the text back.

    A null or empty text has no ids; null ids and repeated rows come back as they are; other columns are ignored; empty ``docs`` give
    no rows. Nothing is shuffled: each task sorts the new words of a part of a batch, and hands parts on as they are done.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    names = ["id", "ids", *["round_trip"] * verify]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            at = 0
            for part in by_size(batch.column("text")):
                found = own.encode_batch(part)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns = [batch.column("id").slice(at, len(part)), pa.ListArray.from_arrays(offsets, np.concatenate(found).astype(np.int32))]
                if verify:
                    columns.append(pa.array([own.decode(ids) == text for ids, text in zip(found, part)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(part)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", round_trip boolean" * verify
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``text`` of every row; null ids count as none and give an empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(model_path).decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
