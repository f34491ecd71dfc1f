"""Benchmark decontamination by templates: numbers, units and names become typed placeholders.

A text is read as tokens: words, numbers and units. Two templates of it are hashed in windows: ``plain`` (runs of
numbers and units replaced, words in lower case) finds copies in any case and with other figures, ``named`` (runs of
capitalised words replaced too) finds copies with other names. A run is one placeholder, so '1 200' may stand for
'12', '5' for '5 kg' and 'Mary Ann' for 'Anna'.

Windows of documents are looked up among those of the benchmark by hash. Hits of one item at one place (shifts between
document and item that differ by ``drift`` of the item's windows at most) are put in order: the longest chain that
goes forward in both, so words that were put in or left out only cost the windows they are in. A document is
contaminated by an item if a chain covers ``coverage`` of the item's windows and the slots are consistent: along the
chain equal values of the item have equal values in the document, and different names stay different (figures may meet
by chance), so a re-parameterised question counts and a chance likeness of templates does not. Placeholders at the ends of an item may belong to longer runs of the
document, so they are not compared.

Windows are ``width`` tokens, or ``short`` for items of fewer than 3 * ``width`` - 1, so one changed word
leaves half of the windows. A window needs ``literals`` different tokens that are no placeholders (short ones: more
than half of their tokens). Items shorter than a window are one window of their own length.

Items without such a window under either template are searched verbatim (``exact``: all tokens in lower case, values
too), whole and without a gap; one or two tokens match documents that hold nothing else. Scripts without spaces
between words are read by character.

Documents and items are paired by rare windows first: of n windows of which ``least`` must be found, any n - ``least`` + 1
hold one that is, so an item looks for documents by its n - ``least`` + 1 windows that fewest documents have, and only
pairs found so are looked up in full. A phrase that many items share pairs nothing unless an item is made of such.

The benchmark's windows are broadcast up to ``BROADCAST_WINDOWS`` of them (16 bytes each); a larger benchmark
is joined by a shuffle of hashes. Either way the same rows come out.

Defined results: null texts and texts without a token match nothing, as documents and as items; a null id is a
group like any other; repeated rows of a document or an item count once; texts of any length are read whole.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Words, staged, text_batches, worker_memory
from .shingles import mix

# Unit words and signs that become a placeholder right after a number.
UNITS = frozenset("% € $ £ cm mm m km g kg mg t l ml s sec min h hr day days hour hours minute minutes second seconds week "
                  "weeks month months year years meter meters metre metres mile miles foot feet inch inches pound pounds "
                  "dollar dollars euro euros cent cents percent degree degrees liter liters litre litres gram grams "
                  "kilogram kilograms ton tons".split())
# Fixed value: Thai to Myanmar, Khmer, kana and Han letters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[{UNSPACED}]|[^\W\d_{UNSPACED}]+(?:['’][^\W\d_{UNSPACED}]+)*|[%€$£]")
WORD_KIND, NUMBER, UNIT, NAME = 0, 1, 2, 3
HELD = {"plain": (NUMBER, UNIT), "named": (NUMBER, UNIT, NAME), "exact": ()}  # what becomes a placeholder
BROADCAST_WINDOWS = 2_000_000
LONGEST = 64
READ = 4 << 20  # bytes of text whose tokens are held at once
_MARKS = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<{k}>")) for k in (NUMBER, NAME)}
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEED = {"plain": np.uint64(0x1F83D9ABFB41BD6B), "named": np.uint64(0x5BE0CD19137E2179),
         "exact": np.uint64(0xA54FF53A5F1D36F1)}


class _Tokens:
    """Hashes (8 bytes each) and kinds (1 byte each; 8 is added if it may be a unit) of the tokens of a word;
    remembers a bounded number of words, none longer than ``LONGEST``."""

    def __init__(self):
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def of(self, word: str) -> tuple[bytes, bytes]:
        found = self.known.get(word)
        if found is None:
            hashes, kinds = [], []
            for token in TOKEN.findall(word):
                low = token.lower()
                kind = NUMBER if token[0].isdigit() else NAME if token[0].isupper() else WORD_KIND
                hashes.append(xxhash.xxh3_64_intdigest(low))
                kinds.append(kind + (8 if low in UNITS else 0))
            found = np.array(hashes, "<u8").tobytes(), bytes(kinds)
            if len(word) <= LONGEST:
                if len(self.known) > 500_000:
                    self.known = {}
                self.known[word] = found
        return found


@dataclass
class Template:
    """Texts under one template: the first token of each place (and the number of tokens), hashes of the places, offsets
    of the texts among them."""
    first: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


@dataclass
class Templates:
    """Texts as tokens: offsets of the texts, kinds, both templates, and each token's word and place in it."""
    words: Words
    offsets: np.ndarray
    kind: np.ndarray
    of: dict[str, Template]
    code: np.ndarray
    place: np.ndarray
    spans: dict[int, np.ndarray] = field(default_factory=dict)  # of the words that were asked for

    def token(self, i: int) -> str:
        code = int(self.code[i])
        word, spans = self.words.vocab[code], self.spans.get(code)
        if spans is None:
            spans = self.spans[code] = np.fromiter((x for m in TOKEN.finditer(word) for x in m.span()), "int32").reshape(-1, 2)
        begin, end = spans[self.place[i]]
        return word[begin:end].lower()

    def slots(self, at: int, width: int, template: str) -> list[str]:
        """The values in a window's placeholders, in order."""
        first = self.of[template].first
        return [" ".join(map(self.token, range(first[i], first[i + 1])))
                for i in range(at, at + width) if self.kind[first[i]] in HELD[template]]


def templates(words: Words) -> Templates:
    known = worker_memory("templates", _Tokens)
    found = [known.of(w) for w in words.vocab]
    size = np.fromiter((len(k) for _, k in found), "int64", len(found))
    start = np.cumsum(size) - size
    sizes = size[words.codes]
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    code = np.repeat(words.codes, sizes)
    source = start[code] + place
    plain = np.frombuffer(b"".join(h for h, _ in found), "<u8")[source]
    kind = np.frombuffer(b"".join(k for _, k in found), "i1")[source]
    offsets = np.concatenate([[0], ends])[words.offsets]
    maybe_unit, kind = kind >= 8, kind & 7
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = kind[:-1] == NUMBER
    after_number[offsets[:-1][offsets[:-1] < len(kind)]] = False
    kind[maybe_unit & after_number] = UNIT
    begins = np.zeros(len(kind) + 1, bool)
    begins[offsets] = True
    figure = (kind == NUMBER) | (kind == UNIT)
    exact, plain = plain, np.where(figure, _MARKS[NUMBER], plain)

    def template(hashes: np.ndarray, *runs: np.ndarray) -> Template:
        within = np.zeros(len(kind) + 1, bool)
        for run in runs:
            within[1:-1] |= run[1:] & run[:-1]
        first = np.flatnonzero(~within | begins)
        return Template(first, hashes[first[:-1]], np.searchsorted(first, offsets))

    name = kind == NAME
    return Templates(words, offsets, kind, {"plain": template(plain, figure),
                                            "named": template(np.where(name, _MARKS[NAME], plain), figure, name),
                                            "exact": template(exact)}, code, place)


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` tokens within a text, and its first token."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, "uint64"), np.empty(0, "int64")
    total = np.full(n, seed + np.uint64(width))
    for k in range(width):
        total *= _STEP
        total += hashes[k:k + n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.flatnonzero(np.arange(n) + width <= ends)
    return mix(total[inside]), inside


def benchmark_windows(items: list[tuple[object, str | None]], width: int, short: int, literals: int) -> pd.DataFrame:
    """``item_id, template, at, n_windows, width, h, item_pos, item_slots`` of the items that have enough literals; a
    slot that is not compared is null."""
    out = []
    for item, text in items:
        t = templates(Words(pa.array([text], pa.string())))
        searched = False
        for name, one in t.of.items():  # exact comes last
            n = len(one.hashes)
            if name == "exact" and searched:
                continue
            size = min(width if n >= 3 * width - 1 else short, n)
            if not size:
                continue
            least = min(literals, size // 2 + 1) if size == short else literals
            free = ~np.isin(t.kind[one.first[:-1]], HELD[name])
            got, at = windows(one.hashes, one.offsets, size, _SEED[name])
            rich = [len({x for x, f in zip(one.hashes[a:a + size].tolist(), free[a:a + size]) if f}) >= least for a in at]
            if name == "exact":
                size = min(short, n)
                got, at = windows(one.hashes, one.offsets, size, _SEED[name])
                rich = [True] * len(at)
            searched |= any(rich)
            for x, a, ok in zip(got, at, rich):
                if ok:
                    slots = t.slots(a, size, name)
                    if slots and a == 0 and not free[0]:
                        slots[0] = None
                    if slots and a + size == n and not free[n - 1]:
                        slots[-1] = None
                    out.append((item, name, int(a), sum(rich), size, int(np.int64(x.view("int64"))), int(one.first[a]), slots))
    return pd.DataFrame(out, columns=["item_id", "template", "at", "n_windows", "width", "h", "item_pos", "item_slots"])


def _document_windows(it: Iterator[pa.RecordBatch], sizes: list[tuple[str, int]],
                      wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of documents that are wanted (all, if None), as ``doc_id, template, place, pos, h, slots``: the place among
    those of the template, and the first token."""
    for part, words in text_batches(it, size=READ):
        t, ids = templates(words), part.column(0)
        for name, size in sizes:
            one = t.of[name]
            got, at = windows(one.hashes, one.offsets, size, _SEED[name])
            if wanted is not None and len(got):
                place = np.searchsorted(wanted, got)
                hit = wanted[np.minimum(place, len(wanted) - 1)] == got
                got, at = got[hit], at[hit]
            owner = np.searchsorted(one.offsets, at, side="right") - 1
            if name == "exact" and size < 3:
                alone = np.diff(one.offsets)[owner] == size
                got, at, owner = got[alone], at[alone], owner[alone]
            if len(got):
                slots = pa.array([t.slots(a, size, name) for a in at.tolist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array([name] * len(got)), pa.array(at - one.offsets[owner]),
                     pa.array(one.first[at] - t.offsets[owner]), pa.array(got.view("int64")), slots],
                    ["doc_id", "template", "place", "pos", "h", "slots"])


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, literals: int = 4,
                 key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 broadcast_windows: int = BROADCAST_WINDOWS, short: int = 5, drift: float = 0.25) -> DataFrame:
    """``doc_id, item_id, n_hits, n_windows, start`` of every document and item that it contains, with the first
    token of the place that covers most."""
    spark = docs.sparkSession
    kinds = {"doc_id": docs.schema[key].dataType.simpleString(), "item_id": benchmark.schema[item].dataType.simpleString()}

    def item_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield benchmark_windows(list(zip(pdf["item_id"], pdf["text"])), width, short, literals)

    bench = staged(benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).dropDuplicates()
                   .mapInPandas(item_rows, f"item_id {kinds['item_id']}, template string, at bigint, n_windows bigint, "
                                           "width int, h bigint, item_pos bigint, item_slots array<string>"), "bench-windows")
    # At most ``width`` numbers a template.
    sizes = sorted((r[0], r[1]) for r in bench.select("template", "width").distinct().collect())
    wanted = None
    if bench.count() <= broadcast_windows:
        hashes = bench.select("h").distinct().toArrow()["h"].to_numpy().astype("int64").view("uint64")
        wanted = spark.sparkContext.broadcast(np.sort(hashes))

    def doc_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        if known is None or len(known):
            yield from _document_windows(it, sizes, known)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        doc_rows, f"doc_id {kinds['doc_id']}, template string, place bigint, pos bigint, h bigint, slots array<string>")
    if wanted is None:  # only those that the benchmark has are written
        rows = rows.join(bench.select("h", "template").distinct(), ["h", "template"], "left_semi")
    rows = staged(rows, "bench-hits")
    pairs = staged(_pairs(rows, bench, coverage), "bench-pairs").withColumnsRenamed({"doc_id": "of", "template": "by"})
    # By the window too, so a document or an id of many rows is spread.
    asked = pairs.join(bench, pairs["item_id"].eqNullSafe(bench["item_id"]) & (pairs["by"] == bench["template"])).drop(
        pairs["item_id"], bench["template"]).withColumnRenamed("h", "window")
    hits = rows.join(asked, rows["doc_id"].eqNullSafe(asked["of"]) & (rows["template"] == asked["by"]) & (rows["h"] == asked["window"]))
    return _judged(hits.drop("of", "by", "window"), coverage, drift)


def _least(coverage: float) -> Column:
    """How many of an item's windows must be found."""
    return F.when(F.col("template") == "exact", F.lit(1.0)).otherwise(F.lit(coverage)) * F.col("n_windows")


def _pairs(rows: DataFrame, bench: DataFrame, coverage: float) -> DataFrame:
    """``doc_id, item_id, template`` of documents that hold one of the item's rarest windows, as many as any contaminated
    document must hold one of."""
    often = rows.groupBy("h", "template").agg(F.count("*").alias("often"))
    item = Window.partitionBy("item_id", "template", "n_windows")
    rarest = bench.drop("item_slots").join(often, ["h", "template"], "left").fillna(0, ["often"]).withColumn(
        "rank", F.row_number().over(item.orderBy("often", "at"))).withColumn("all", F.count("*").over(item))
    spare = F.col("all") - F.greatest(F.ceil(_least(coverage)), F.lit(1))
    keys = rarest.where((F.col("rank") <= spare + 1) & (F.col("often") > 0)).select("h", "template", "item_id").distinct()
    return rows.select("doc_id", "h", "template").join(keys, ["h", "template"]).select("doc_id", "item_id", "template").distinct()


def _chain(hits: list[tuple[int, int]]) -> list[int]:
    """The longest run of (at, place), sorted by at and then by place backwards, that goes forward in both."""
    ends, tops, before = [], [], []
    for i, (_, place) in enumerate(hits):
        k = bisect_left(tops, place)
        before.append(ends[k - 1] if k else -1)
        tops[k:k + 1], ends[k:k + 1] = [place], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _consistent(hits: list[dict]) -> bool:
    held: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(held.setdefault(i, d) == d and (i[:1].isdigit() or back.setdefault(d, i) == i)
               for x in hits for i, d in zip(x["item_slots"], x["slots"]) if i is not None)


def _best(hits: list[dict], least: float, whole: bool) -> list[dict]:
    """The longest consistent chain of at least ``least`` hits: over all shifts (unless ``whole``), else on one."""
    hits = sorted(hits, key=lambda x: (x["at"], -x["place"]))
    if len({x["at"] for x in hits}) < least:
        return []
    chain = [hits[i] for i in _chain([(x["at"], x["place"]) for x in hits])]
    if len(chain) < least:
        return []
    if not whole and _consistent(chain):
        return chain
    shifts: dict[int, list[dict]] = {}
    for x in hits:
        shifts.setdefault(x["place"] - x["at"], []).append(x)
    return max((x for x in shifts.values() if len({h["at"] for h in x}) >= least and _consistent(x)), key=len, default=[])


def _judged(hits: DataFrame, coverage: float, drift: float) -> DataFrame:
    hits = hits.where(F.size("slots") == F.size("item_slots"))
    # Shifts that differ by less than ``reach`` are together in one of two bands; so what is held at once is bounded by
    # the item, however long the document.
    reach = F.greatest(F.lit(4), F.ceil(drift * F.col("n_windows")))
    band = F.floor((F.col("place") - F.col("at")) / reach)
    rows = hits.withColumn("band", F.explode(F.array(band, band - 1)))
    sets = rows.groupBy("doc_id", "item_id", "template", "n_windows", "band").agg(F.collect_set(
        F.struct("at", "place", "pos", "item_pos", "slots", "item_slots")).alias("hits"))
    whole = F.col("template") == "exact"
    sets = sets.withColumn("least", _least(coverage)).where(F.size("hits") >= F.col("least"))
    ids = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in ("doc_id", "item_id"))

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = batch.column(3)
            kept, n_hits, start = [], [], []
            for i, (least, one) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                chain = _best(found[i].as_py(), least, one)
                if chain:
                    kept.append(i), n_hits.append(len({x["at"] for x in chain}))
                    start.append(chain[0]["pos"] - chain[0]["item_pos"])
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in range(3)), pa.array(n_hits, pa.int64()), pa.array(start, pa.int64())],
                ["doc_id", "item_id", "n_windows", "n_hits", "start"])

    good = sets.select("doc_id", "item_id", "n_windows", "hits", "least", whole.alias("whole")).mapInArrow(
        judge, f"{ids}, n_windows bigint, n_hits bigint, start bigint")
    best = F.max(F.struct((F.col("n_hits") / F.col("n_windows")).alias("share"), "n_hits", "n_windows",
                          (-F.col("start")).alias("back"))).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.n_hits").alias("n_hits"), F.col("best.n_windows").alias("n_windows"),
        (-F.col("best.back")).alias("start"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = contaminated(docs, benchmark, key=key, **options).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["_found"]), "left_anti")
