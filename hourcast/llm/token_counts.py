"""Token counts under a unigram model, with the dynamic programme shared along a trie of words.

The distinct words of a batch are walked in sorted order, which is the preorder of their trie: the
forward scores of a prefix stay on a stack while words below it are visited, so each trie node is scored
once. A terminal keeps its number of tokens; texts then only look up and add.

The vocabulary is a public piece list in frequency order. Piece number r has the weight ln(r + 3); the best
segmentation has the least total weight, then the fewest pieces. A word gets the model's word mark in
front. Characters no piece covers cost one byte piece for each UTF-8 byte.

Defined results: null, empty and all-space texts have 0 tokens; repeated rows count each by itself; a
word or text of any length is counted whole (words above ``MAX_KEPT`` characters are scored by the same
walk, but not remembered). The memory of known words is a cache: when it is full it starts anew.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches, worker_memory

MARK = "▁"
MAX_KEPT = 64
CACHE = 800_000


@lru_cache(maxsize=4)
def piece_weights(path: str) -> tuple[dict[str, float | None], float]:
    """Weights of the pieces of a sentencepiece file (None: only the end of a piece), and that of a byte."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights, byte = {}, 0.0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte = max(byte, math.log(i + 3))
        elif not (model.is_control(i) or model.is_unknown(i)):
            weights[model.id_to_piece(i)] = math.log(i + 3)
    # A byte is the last resort: dearer than any piece.
    byte = max([byte, *weights.values()]) + 1.0
    return dict.fromkeys(p[k:] for p in weights for k in range(len(p))) | weights, byte


class TrieCounter:
    """Forward scores along the trie of the words given so far; ``counts`` holds its terminals."""

    def __init__(self, weights: dict[str, float | None], byte: float):
        self.weights, self.byte = weights, byte
        self.counts: dict[str, int] = {}
        self.nodes = 0

    def add(self, words: set[str]) -> None:
        weights, byte = self.weights, self.byte
        before, best = "", [(0.0, 0)]  # best[i]: weight and pieces of the first i characters
        for word in sorted(words):
            text = MARK + word
            same, most = 0, min(len(before), len(text))
            while same < most and before[same] == text[same]:
                same += 1
            del best[same + 1:]
            for end in range(same + 1, len(text) + 1):
                w, n = best[end - 1]
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                weight, pieces = w + byte * size, n + size
                start = end - 1
                while start >= 0 and (part := text[start:end]) in weights:
                    piece = weights[part]
                    if piece is not None:
                        w, n = best[start]
                        w += piece
                        if w < weight or w == weight and n + 1 < pieces:
                            weight, pieces = w, n + 1
                    start -= 1
                best.append((weight, pieces))
            self.nodes += len(text) - same
            before = text
            self.counts[word] = best[-1][1]

    def lookup(self, words: list[str]) -> np.ndarray:
        """Tokens of each of some different words."""
        if len(self.counts) > CACHE:
            self.counts = {}
        new = set(words).difference(self.counts)
        self.add(new)
        out = np.fromiter(map(self.counts.__getitem__, words), "int64", len(words))
        for w in [w for w in new if len(w) > MAX_KEPT]:
            del self.counts[w]
        return out


def count_tokens(df: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``n_tokens`` of every row; no shuffle."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_memory(("counts", model), lambda: TrieCounter(*piece_weights(model)))
        for part, words in text_batches(it):
            counts = words.sums(counter.lookup(words.vocab))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], ["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key))
