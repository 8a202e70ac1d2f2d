"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. A node that no vocabulary entry extends to the next character fails to the node of what is
left after the longest pieces are taken off its string; how many pieces that takes off is worked out beforehand, so
a word's pieces are counted in one pass without being built. Words begin with the mark ``▁``; a
character that is no entry counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

MARK = "▁"
DEFAULT = "piece_bpe_32k.model"


class Automaton:
    def __init__(self, vocabulary: set[str]):
        self.next: list[dict[str, int]] = [{}]
        weight = [0]

        def add(word: str, n: int) -> None:
            at = 0
            for c in word:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                at = to
            weight[at] = n

        for word in vocabulary:
            if word:
                add(word, 1)
        for c in {c for word in vocabulary for c in word}.difference(vocabulary):
            add(c, len(c.encode()))
        self.fail = [0] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if weight[v]:
                    self.popped[v] = weight[v]  # the whole string is one entry: nothing is left
                    continue
                # take pieces off the parent's string until what is left goes on with c
                n, at = self.popped[u], self.fail[u]
                while c not in self.next[at]:
                    n, at = n + self.popped[at], self.fail[at]
                self.popped[v], self.fail[v] = n, self.next[at][c]

    def count(self, word: str) -> int:
        follow, fail, popped, at, n = self.next, self.fail, self.popped, 0, 0
        for c in word:
            to = follow[at].get(c)
            while to is None and at:
                n += popped[at]
                at = fail[at]
                to = follow[at].get(c)
            if to is None:
                n += len(c.encode())
            else:
                at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class Counter:
    """Counts of words that a worker has met, at most ``room`` of them."""

    def __init__(self, path: str, room: int = 700_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.automaton = Automaton({model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.memo: dict[bytes, int] = {}
        self.room = room

    def count(self, text: bytes) -> tuple[int, int]:
        words, memo = text.split(), self.memo
        distinct = set(words)
        if new := distinct.difference(memo):
            if len(memo) + len(new) > self.room:
                memo.clear()
                new = distinct
            of = self.automaton.count
            memo.update((w, of(MARK + w.decode())) for w in new)
        return len(words), sum(map(memo.__getitem__, words))


_counters: dict[str, Counter] = {}


def model_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_bytes and n_tokens of every row, by greedy longest match.

    Null and empty texts have none; rows that repeat are counted each; an empty table gives no rows; other columns are ignored. Very long texts and
    words are counted whole, in time in proportion to their length.
    """
    path = path or model_path()

    def run(batches):
        if path not in _counters:
            _counters[path] = Counter(path)
        for b in batches:
            texts = text_bytes(b.column(1))
            counts = np.array([_counters[path].count(t) for t in texts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts[:, 0].copy()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts[:, 1].copy())], names=["doc_id", "n_words", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_bytes long, n_tokens long")
