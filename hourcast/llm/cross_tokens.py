"""Alignment of two tokenizers' tokens over the same bytes by diagonal run skipping.

Both tokenizers cut the same byte string; their token ends are two ascending arrays with the same last entry. At
a place where both end, the arrays are compared at the current index shift: a probe of doubling length jumps
over a stretch of tokens that are the same in both, halving finds where it ends. The irregular group behind it is
walked end by end until both end together again, which gives the new shift. Ends that both share cut the tokens
into groups; the steps inside a group are the links, one for each pair of tokens that share bytes.

Each text is encoded in parts cut at a single space between visible Latin characters. There neither tokenizer
joins bytes across the space, so a part has the same ids alone as within the text, and a worker remembers those of
recent parts. The memory is a cache; when full it starts anew.

Defined results: a null or empty text, and one whose tokens do not spell it, has no tokens, groups or links;
repeated rows count each by itself; a null id stays a null id; texts of any length are aligned whole; an empty table
gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import require, staged, worker_memory

# A space between two visible characters of ASCII or the Latin blocks behind it.
CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
PLAIN = re.compile("[!-~À-ɏ](?:[\\t-\\r -~À-ɏ]*[!-~À-ɏ])?")
CACHE, MAX_KEPT, LINE = 150_000, 64, 500
BATCH = 2 << 20


def align(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (indices into a and into b, those of one-to-one stretches first) and the number of tokens of a and of
    b up to the end of each group, of two ascending lists that end alike."""
    from_a, from_b, runs = [], [], []  # one-to-one stretches
    odd_a, odd_b, last = [], [], []  # links of irregular groups, and where in them a group ends
    i, j, n, m = 0, 0, len(ends_a), len(ends_b)
    while i < n:
        a, b = ends_a[i], ends_b[j]
        if a == b:
            left, run, step = min(n - i, m - j), 1, 1
            while run < left and ends_a[i + run:i + run + step] == ends_b[j + run:j + run + step]:
                run += step
                step *= 2
            run = min(run, left)
            while step > 1:  # the run ends inside the last probe
                step //= 2
                if run + step <= left and ends_a[i + run:i + run + step] == ends_b[j + run:j + run + step]:
                    run += step
            from_a.append(i)
            from_b.append(j)
            runs.append(run)
            i += run
            j += run
            continue
        while a != b:
            odd_a.append(i)
            odd_b.append(j)
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        last.append(len(odd_a))
        odd_a.append(i)
        odd_b.append(j)
        i += 1
        j += 1
    size, out = np.array(runs, "int64"), []
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    for start, odd in ((from_a, odd_a), (from_b, odd_b)):
        even, odd = np.repeat(np.array(start, "int64"), size) + inside, np.array(odd, "int64")
        ends = np.concatenate([even, odd[np.array(last, "int64")]]) + 1
        ends.sort(kind="stable")
        out.append((np.concatenate([even, odd]), ends))
    (link_a, upto_a), (link_b, upto_b) = out
    return link_a, link_b, upto_a, upto_b


def _byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: visible Latin-1 characters are themselves, the
    other bytes take the letters from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    """A byte-level tokenizer and the bytes of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = _byte_of_letter()
    spelled = [str(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return tokenizer, [bytes(of[c] for c in s) if all(c in of for c in s) else s.encode() for s in spelled]


@lru_cache(maxsize=2)
def piece_tokenizer(path: str):
    """A sentencepiece model and the bytes of its ids."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                   else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def rank_tokenizer(path: str):
    """The byte-level tokenizer of a file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class PartEncoder:
    """Ids of both tokenizers for parts of texts. The recently used are remembered (two generations: a full one
    becomes the old one, and parts found there move up)."""

    def __init__(self, path_a: str, path_b: str, ranks: str | None = None):
        (self.a, self.bytes_a), (self.b, self.bytes_b) = byte_tokenizer(path_a), piece_tokenizer(path_b)
        self.plain_a = rank_tokenizer(ranks).encode_ordinary if ranks else self._ids_a
        self.size_a, self.size_b = (np.fromiter(map(len, t), "int64", len(t)) for t in (self.bytes_a, self.bytes_b))
        na, nb = len(self.bytes_a), len(self.bytes_b)
        # Ids in decimal with what may follow them: "," or "|" for a, "," or ";" for b.
        self.decimal = pa.array([f"{i}{end}" for n, ends in ((na, ",|"), (nb, ",;")) for end in ends for i in range(n)])
        self.offset_b = 2 * na
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _ids_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str, encode) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a and b of a text; None if they do not spell it."""
        a, b, raw = encode(" " + text), self.b.encode(text), b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, "<u4"), np.array(b, "<u4")

    def _learn_one(self, part: str) -> None:
        ids = self._ids(part, self._ids_a)
        self.known[part] = None if ids is None else (ids[0].tobytes(), ids[1].tobytes())

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts: plain ones several in one line, whose ids are cut where the parts end."""
        plain = [p for p in parts if PLAIN.fullmatch(p)]
        for p in set(parts).difference(plain):
            self._learn_one(p)
        for lo in range(0, len(plain), LINE):
            some = plain[lo:lo + LINE]
            ids = self._ids(" ".join(some), self.plain_a)
            if ids is None:
                for p in some:
                    self._learn_one(p)
                continue
            ends = np.cumsum([len(p.encode()) + 1 for p in some])
            cut = [(4 * (np.searchsorted(np.cumsum(size[x]), ends) + 1)).tolist()
                   for x, size in zip(ids, (self.size_a, self.size_b))]
            a, b = (x.tobytes() for x in ids)
            self.known.update((p, (a[i:j], b[k:n])) for p, i, j, k, n in zip(
                some, [0, *cut[0]], cut[0], [0, *cut[1]], cut[1]))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a and b of a text cut into parts; None if they do not spell it."""
        known = self.known
        found = list(map(known.get, parts))
        if None in found:  # a long part, or one that is not spelled
            new = {p for p, f in zip(parts, found) if f is None and p not in known}
            self._learn(list(new))
            found = list(map(known.__getitem__, parts))
            for p in new:
                if len(p) > MAX_KEPT:
                    del known[p]
            if None in found:
                return None
        return tuple(np.frombuffer(b"".join([f[k] for f in found]), "<u4") for k in (0, 1))

    def teach(self, texts: list[str | None]) -> list[list[str]]:
        """The parts of the texts; short ones that are new are learned together."""
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        parts = [CUT.split(t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        back = new.intersection(self.old)
        self.known.update((p, self.old[p]) for p in back)
        self._learn([p for p in new.difference(back) if len(p) <= MAX_KEPT])
        return parts

    def spelled(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> memoryview:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        last_a, last_b = np.zeros(len(a), "int64"), np.zeros(len(b), "int64")
        last_a[upto_a - 1] = len(self.bytes_a)
        last_b[upto_b - 1] = len(self.bytes_b)
        out = np.empty(len(a) + len(b), "int64")
        out[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = a + last_a
        out[np.arange(len(b)) + np.repeat(upto_a, size_b)] = b + last_b + self.offset_b
        line = self.decimal.take(pa.array(out))  # its strings lie one behind the other
        return memoryview(line.buffers()[2])[:int(np.frombuffer(line.buffers()[1], "int32")[len(out)]) - 1]


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH`` bytes; a longer text stays whole."""
    for batch in it:
        size, start = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            if size and size + n > BATCH:
                yield batch.slice(start, i - start)
                size, start = 0, i
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id",
            ranks: str | None = None) -> DataFrame:
    """One row a text: ``key, n_a, n_b, n_groups, n_links, groups_sha256`` and ``links``, each an id of a times the
    number of ids of b, plus an id of b. ``ranks`` is the vocabulary of a as a file of ranks, which
    encodes plain parts to the same ids in a third of the time."""
    require(df, [key, text])
    n_b = len(piece_tokenizer(path_b)[1])
    link = "int" if len(byte_tokenizer(path_a)[1]) * n_b < 2 ** 31 else "bigint"
    numpy_link, arrow_link = ("int32", pa.int32()) if link == "int" else ("int64", pa.int64())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_memory(("parts", path_a, path_b), lambda: PartEncoder(path_a, path_b, ranks))
        for batch in _slices(it):
            texts = batch.column(1).to_pylist()
            numbers, digests, links = [], [], []
            for parts in encoder.teach(texts):
                ids = encoder.encode(parts) if parts else None
                if ids is None:
                    numbers.append((0, 0, 0, 0))
                    digests.append("")
                    links.append(np.empty(0, numpy_link))
                    continue
                a, b = (x.astype("int64") for x in ids)
                link_a, link_b, upto_a, upto_b = align(
                    np.cumsum(encoder.size_a[a]).tolist(), np.cumsum(encoder.size_b[b]).tolist())
                numbers.append((len(a), len(b), len(upto_a), len(link_a)))
                digests.append(hashlib.sha256(encoder.spelled(a, b, upto_a, upto_b)).hexdigest())
                links.append((a[link_a] * n_b + b[link_b]).astype(numpy_link))
            sizes = np.cumsum([0, *map(len, links)])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()),
                                             pa.array(np.concatenate([np.empty(0, numpy_link), *links]), arrow_link))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in zip(*numbers)), pa.array(digests), lists],
                ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                             f"groups_sha256 string, links array<{link}>").withColumnRenamed("key", key))


def link_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """``link, count, best`` over all rows: how often two ids are linked, and whether no id of a is linked to the
    same id of b more often. An id of b has at most as many links as a has ids, so the window is bounded."""
    counts = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("link") % n_b))
    return counts.select("link", "count", (F.col("count") == most).cast("bigint").alias("best"))


def alignment(df: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id",
              ranks: str | None = None) -> DataFrame:
    """``aligned`` without its links, but with ``n_best`` and ``count_sum`` of the links over the whole table."""
    plain = aligned(df, path_a, path_b, text, key, ranks)
    rows = staged(plain.withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = staged(link_counts(rows, len(piece_tokenizer(path_b)[1])), "link-counts")
    # Spark broadcasts the counts if they are small and shuffles both sides if not.
    sums = (rows.select("rid", F.explode("links").alias("link")).join(counts, "link")
            .groupBy("rid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")))
    whole = rows.drop("links").join(sums, "rid", "left")
    return whole.select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
