"""Greedy word-piece counts by a longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import text_of
from remitlens.llm.word_pieces import WordEncoder

END = "</w>"
NONE = -1


#: counts of words kept by a worker
CACHE_WORDS = 400_000


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation in one pass over a string.

    A trie of the vocabulary has for each node a failure link and the number of pieces that following it gives off: if the
    string read so far is the node's, then ``popped`` longest-match pieces are final and the rest of it is the string of ``link``.
    A step that the trie lacks follows links, adding up their pieces, so the work is linear and no piece is built.
    """

    def __init__(self, vocabulary: list[tuple[str, ...]]):
        self.steps: list[dict[str, int]] = [{}]
        is_piece = [False]
        parent: list[tuple[int, str]] = [(0, "")]
        for piece in vocabulary:
            node = 0
            for symbol in piece:
                to = self.steps[node].get(symbol)
                if to is None:
                    to = self.steps[node][symbol] = len(self.steps)
                    self.steps.append({})
                    is_piece.append(False)
                    parent.append((node, symbol))
                node = to
            is_piece[node] = True
        self.link, self.popped = [NONE] * len(self.steps), [0] * len(self.steps)
        level = [0]
        while level:
            below = []
            for node in level:
                for to in self.steps[node].values():
                    below.append(to)
                    self._link(to, is_piece[to], *parent[to])
            level = below

    def _link(self, node: int, is_piece: bool, parent: int, symbol: str) -> None:
        if is_piece:
            self.link[node], self.popped[node] = 0, 1
            return
        at, popped = self.link[parent], self.popped[parent]
        while at != NONE and symbol not in self.steps[at]:
            popped += self.popped[at]
            at = self.link[at]
        if at != NONE:
            self.link[node], self.popped[node] = self.steps[at][symbol], popped

    def count(self, symbols: tuple[str, ...]) -> int | None:
        """Pieces of the string; None where no segmentation by longest matches exists."""
        node, total, steps, link, popped = 0, 0, self.steps, self.link, self.popped
        for symbol in symbols:
            while (to := steps[node].get(symbol)) is None:
                total += popped[node]
                node = link[node]
                if node == NONE:
                    return None
            node = to
        while node:
            total += popped[node]
            node = link[node]
            if node == NONE:
                return None
        return total


class WordCounter:
    """Greedy piece counts of words over a word-end vocabulary: a word's last symbol carries the end mark."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        self.model = LongestMatch([self.symbols(piece) for piece in self.words.tokenizer.get_vocab(with_added_tokens=False)])
        self.counts: dict[str, tuple[int, int, int]] = {}

    @staticmethod
    def symbols(piece: str) -> tuple[str, ...]:
        return (*piece[: -len(END) - 1], piece[-len(END) - 1] + END) if piece.endswith(END) and len(piece) > len(END) else tuple(piece)

    def count_word(self, word: str) -> int | None:
        return self.model.count(self.symbols(self.words.symbols(word) + END))

    def _run(self, run: str) -> tuple[int, int, int]:
        """Words, pieces and words without a segmentation, each of which counts as one unknown piece."""
        found = [self.count_word(w) for w in self.words.pattern.findall(run)]
        out = len(found), sum(1 if n is None else n for n in found), sum(n is None for n in found)
        if len(run) <= 64:
            if len(self.counts) >= CACHE_WORDS:
                self.counts.clear()
            self.counts[run] = out
        return out

    def count(self, text: str) -> tuple[int, int, int]:
        known, new = self.counts.get, self._run
        found = [known(r) or new(r) for r in self.words.runs_of(text)]
        return tuple(map(sum, zip(*found))) if found else (0, 0, 0)


@lru_cache(maxsize=4)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_words``, ``n_tokens`` (greedy longest-match pieces) and ``n_unknown`` (words without a segmentation, one token each) of every row.

    Words are the tokenizer's own. A null or empty text has no words; null ids and repeated rows come back as they are; other columns are
    ignored; empty ``docs`` give no rows. Nothing is shuffled; each distinct word is counted once per worker while its cache holds it.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path).count
        for batch in batches:
            found = np.array([count(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(found[:, k]) for k in range(3)]], ["id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)
