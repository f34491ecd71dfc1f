"""Language of a text by segmentation-marginalised unigrams over a fixed public piece vocabulary.

Each language has a probability for every piece of the vocabulary (counts of the tokenizer's own pieces,
smoothed). A word's probability under a language is the sum over all ways to cut it into pieces, which a
forward pass along the trie of the words computes: every prefix once, for all languages together, in logs.
A text's score is the posterior of its best language under equal priors. Beside it stands the gain: how much more
likely, in nats a character, the best language makes the text than a background that gives every piece the same
probability. A posterior only compares the learned languages; noise and other languages have a gain below 0,
since most of their pieces were seldom or never seen. A model of a few hundred words has gains near 0: it knows too
little to doubt anything.

Bound on the fit: about ``per_language`` different labelled texts of each language, chosen by hash; each is read
whole. Prediction reads every text whole and knows neither label, source nor id.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing
was learned; their gain is 0. Equal scores go to the language first by code point. Repeated rows are judged alike.
Workers remember words of up to ``MAX_KEPT`` characters; longer ones are scored anew each time.
"""
from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, staged, text_batches, worker_memory

MARK, UND = "▁", "und"
CACHE, MAX_KEPT = 400_000, 64
BATCH = 6 << 20  # bytes of text whose words are held at once
WALK = 40_000  # words whose trie is in memory at once
FALLBACK = -18.0  # log probability of a character that no piece covers, alike in every language


@dataclass
class LanguageModel:
    """``log_p[piece]`` per language; ``pieces`` numbers the pieces, -1 is the end of a longer one only."""
    languages: list[str]
    log_p: np.ndarray
    pieces: dict[str, int]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _walk(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (sorted, different) under each language and, last, the background."""
        pieces, columns = self.pieces, len(self.languages) + 1
        log_p = np.hstack([self.log_p, np.full((len(self.log_p), 1), -np.log(max(len(self.log_p), 1)))])
        node_of, depth_of = array("l", [0]), array("l", [0])
        edge_node, edge_from, edge_piece = array("l"), array("l"), array("l")
        terminals, stack, before = array("l"), [0], ""
        for word in words:
            text = MARK + word
            same, most = 0, min(len(before), len(text))
            while same < most and before[same] == text[same]:
                same += 1
            del stack[same + 1:]
            for end in range(same + 1, len(text) + 1):
                node = len(depth_of)
                depth_of.append(end)
                start = end - 1
                edge_node.append(node), edge_from.append(stack[start]), edge_piece.append(-1)
                while start >= 0 and (piece := pieces.get(text[start:end])) is not None:
                    if piece >= 0:
                        edge_node.append(node), edge_from.append(stack[start]), edge_piece.append(piece)
                    start -= 1
                stack.append(node)
            before = text
            terminals.append(stack[-1])
        depth, node = np.array(depth_of), np.array(edge_node)
        came, piece = np.array(edge_from), np.array(edge_piece)
        forward = np.zeros((len(depth), columns))
        order = np.argsort(depth[node], kind="stable")
        node, came, piece = node[order], came[order], piece[order]
        weight = np.vstack([log_p, np.full((1, columns), FALLBACK)])  # row -1 is the fallback
        ends = np.searchsorted(depth[node], np.arange(1, depth.max() + 2))
        for lo, hi in zip(ends, ends[1:]):
            part = forward[came[lo:hi]] + weight[piece[lo:hi]]
            first = np.flatnonzero(np.diff(node[lo:hi], prepend=-1))
            top = np.maximum.reduceat(part, first, axis=0)
            counts = np.diff(np.append(first, hi - lo))
            total = np.add.reduceat(np.exp(part - np.repeat(top, counts, axis=0)), first, axis=0)
            forward[node[lo:hi][first]] = top + np.log(total)
        return forward[np.array(terminals)]

    def _scored(self, words: list[str]) -> list[np.ndarray]:
        """``_walk`` over sorted words, with one part's trie in memory at a time."""
        return [self._walk(words[i:i + WALK]).astype("float32") for i in range(0, len(words), WALK)]

    def words(self, vocab: list[str]) -> np.ndarray:
        """A row for each word: its log probability under each language and, last, the background."""
        known = worker_memory(("language", self.name),
                              lambda: {"at": {}, "table": np.empty((0, len(self.languages) + 1), "float32")})
        if len(known["at"]) > CACHE:
            known["at"], known["table"] = {}, known["table"][:0]
        new = sorted(w for w in set(vocab).difference(known["at"]) if len(w) <= MAX_KEPT)
        at = len(known["table"])
        known["table"] = np.concatenate([known["table"], *self._scored(new)])
        known["at"].update(zip(new, range(at, at + len(new))))
        place = np.fromiter((known["at"].get(w, -1) for w in vocab), "int64", len(vocab))
        out = np.empty((len(vocab), len(self.languages) + 1))
        out[place >= 0] = known["table"][place[place >= 0]]
        long = sorted({vocab[i] for i in np.flatnonzero(place < 0)})
        if long:
            table, number = np.concatenate(self._scored(long)), {w: i for i, w in enumerate(long)}
            out[place < 0] = table[[number[vocab[i]] for i in np.flatnonzero(place < 0)]]
        return out

    def predict(self, words: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its posterior and its gain over the background, of each text."""
        n = len(words.offsets) - 1
        if not self.languages or not words.vocab:
            return [UND] * n, np.zeros(n), np.zeros(n)
        letters = words.sums(np.array([any(map(str.isalpha, w)) for w in words.vocab], "int64"))
        length = words.sums(np.array([len(w) + 1 for w in words.vocab], "int64"))
        both = words.sums(self.words(words.vocab))
        total, background = both[:, :-1], both[:, -1]
        best, row = total.argmax(axis=1), np.arange(n)
        gain = (total[row, best] - background) / np.maximum(length, 1)
        total = total - total.max(axis=1, keepdims=True)
        post = np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)
        names = [self.languages[b] if k else UND for b, k in zip(best, letters)]
        return names, np.where(letters > 0, post[row, best], 0.0), np.where(letters > 0, gain, 0.0)


def vocabulary(path: str) -> tuple[object, list[str]]:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(model.get_piece_size())]
    return model, [None if s else model.id_to_piece(i) for i, s in enumerate(skip)]


def sample_rows(df: DataFrame, label: str, text: str, per_label: int) -> DataFrame:
    """About ``per_label`` different texts of each label: those whose hash lies below the label's share. Different
    hashes of texts are counted, copies once; nothing is ranked, so a label with most rows is no burden."""
    # Written, so that the join knows how small it is before it would shuffle texts.
    texts = df.select(label, F.xxhash64(text).alias("_hash")).distinct()
    counts = staged(texts.groupBy(label).agg(F.least(F.lit(1.0), per_label / F.count("*")).alias("_share")), "language-counts")
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(text), F.lit(1 << 31)))
    return (hashed.join(counts, label).where(F.col("_hash") < F.col("_share") * (1 << 31))
            .select(label, text).dropDuplicates())


def fit(df: DataFrame, vocab: str, text: str = "text", lang: str = "lang", per_language: int = 1500,
        alpha: float = 0.1) -> LanguageModel:
    """Learn from rows with a text and a label. What reaches the driver is one count for each piece seen of each
    language, bounded by the sample."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = sample_rows(rows, "lang", "text", per_language)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = vocabulary(vocab)
        for part, words in text_batches(it, size=BATCH):
            ids = model.encode(words.vocab, num_threads=1)
            names = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
            owner = np.repeat(np.arange(len(names)), np.diff(words.offsets))
            for name in sorted(set(names)):
                uses = np.bincount(words.codes[names[owner] == name], minlength=len(words.vocab))
                sizes = np.fromiter(map(len, ids), "int64", len(ids))
                flat = np.fromiter((i for x in ids for i in x), "int64", int(sizes.sum()))
                total = np.bincount(flat, np.repeat(uses, sizes)).astype("int64")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(seen), pa.string()),
                                                  "piece": pa.array(seen), "n": pa.array(total[seen])})

    counts = (rows.select("lang", "text").mapInArrow(count, "lang string, piece bigint, n bigint")
              .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow())
    names = vocabulary(vocab)[1]
    lang = counts["lang"].to_pylist()
    languages = sorted(set(lang))
    total = np.zeros((len(names), len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    total[counts["piece"].to_numpy(), np.array([place[x] for x in lang], "int64")] = counts["n"].to_numpy()
    kept = [i for i, p in enumerate(names) if p is not None]
    total = total[kept] + alpha
    number = {names[i]: k for k, i in enumerate(kept)}
    pieces = dict.fromkeys((p[k:] for p in number for k in range(1, len(p))), -1) | number
    return LanguageModel(list(languages), np.log(total / total.sum(axis=0)) if languages else total, pieces)


def predict(df: DataFrame, model: LanguageModel, text: str = "text",
            names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the columns ``names`` (best language, its posterior and, if a third is named, its gain) to every row, in
    place of any so called; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = tuple(names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in text_batches(it, text, BATCH):
            best, *figures = shared.value.predict(words)
            added = [pa.array(best, pa.string()), *map(pa.array, figures)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added[:len(names)]], [*part.schema.names, *names])

    kept = df.drop(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    kinds = [f"`{name}` {kind}" for name, kind in zip(names, ("string", "double", "double"))]
    return kept.mapInArrow(run, ", ".join(fields + kinds))
