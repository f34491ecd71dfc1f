"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes (tag, class and id along the path from the root).
How much a node matters follows from how much it varies: for a node that holds text, one minus the mean entropy
of its texts over the host's pages (a text on every page has entropy 1); for a node with branches, the entropy of
its presentation styles and, weighing more the fewer styles there are, the importance of the text below it.
Branches of low importance are cut from each page. Copies and near copies of a page say nothing about what a
site repeats: pages of a host that agree in ``SKETCH`` minima over the shingles of their text count as one. On few
pages nothing can be said, so a node is judged from ``min_pages`` such pages on, if they are worth ``least_different``
even ones (exponential of the entropy of a page's class, which many near copies of one article do not reach).

Independently of the host, fixed names cut what is never main text however much it varies (scripts, menus, forms,
reader comments, adverts ...): elements, and classes, ids and roles made of such words alone (``share-buttons``). A
name that holds such a word beside others (``search-engines``, ``notice-period``) may as well be the article's, so the
tree decides, by the higher ``doubtful``; where it cannot tell, the text stays. A page with a ``main`` is only read
there. If nothing but low branches is left, the site serves one text everywhere, and it stays.

Low nodes on ``min_share`` of a host's pages are few, at most (nodes on a page) / ``min_share``, and go to its pages as
one list; rarer ones are joined to the pages that have them, so a block is cut on a host of any size.

Only hashes are shuffled to score nodes, counted before the shuffle; a host with a third of all pages is spread
by its texts and pages. Defined results: null, empty and text-free html give an empty text; a null url or one without a
host is judged by names alone; repeated rows come out each; long pages are read whole; unclosed and cut-off
markup is read as far as it goes.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Words, staged
from .shingles import mix, shingle_hashes
from .url_rules import host_of

# Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video map select option textarea "
                  "button input form fieldset nav footer aside menu dialog label title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary "
                  "table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - frozenset("html body caption dd dt li tbody tfoot thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
# Words in classes, ids and roles of what is no main text.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising advertorial banner banners sponsor sponsored sponsors promo promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside complementary contentinfo cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments commentlist respond reply replies disqus discussion pagination pager "
    "toolbar widget widgets search alert skip".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
NOT_NOISE = frozenset("has with no without is".split())
# Words that are never an article's, whatever stands beside them, and words that say nothing of their own.
SURE_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored sponsors promo nav navbar breadcrumb "
                       "breadcrumbs footer sidebar sidebars cookie cookies gdpr newsletter signup disqus pagination pager popup".split())
PLAIN_WORDS = frozenset("a area article articles bar block body bottom box btn button buttons col column container content form "
                        "global group header holder icon icons inner item items left link links list main module news outer page "
                        "panel post posts primary right row secondary section site slot sticky text title top unit user wrap "
                        "wrapper x".split())

DEPTH = 64  # elements below share the style node there; their text counts all the same
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                     r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[^a-z]+")
_hash = xxhash.xxh3_64_intdigest
SKETCH = 2
READ = 4 << 20  # characters of pages whose observations are held at once


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Element:
    __slots__ = ("tag", "node", "path", "noise", "zone", "children", "before")

    def __init__(self, tag, node, path, noise, zone, before=()):
        self.tag, self.node, self.path, self.noise, self.zone, self.children = tag, node, path, noise, zone, []
        self.before = before  # what its line held when an element inside the line began


# What names say of an element. Zones are sums: inside of an article, of the main element.
CLEAN, DOUBTFUL, NOISE = 0, 1, 2
IN_ARTICLE, IN_MAIN = 1, 2


def _named(tag: str, attributes: dict[str, str], zone: int) -> int:
    if tag in NEVER or tag == "header" and not zone:
        return NOISE
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attributes.get("style", "")):
        return NOISE
    if tag in ("html", "body", "article", "main") and not {"comment", "comments"} & set(attributes.get("class", "").lower().split()):
        return CLEAN
    found = CLEAN
    for name in " ".join((attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", ""))).lower().split():
        words = set(_PARTS.split(name)) - {""}
        noise = words & NOISE_WORDS or not zone and words & HEAD_WORDS
        if noise and not words & NOT_NOISE:
            if words & SURE_WORDS or words <= NOISE_WORDS | HEAD_WORDS | PLAIN_WORDS:
                return NOISE
            found = DOUBTFUL
    return found


_known: dict[tuple, tuple] = {}


def _style(parent: int, tag: str, raw: str, zone: int) -> tuple[int, str, int, bool]:
    """Style node, look, what its names say and whether it is the main element, of an element under a style node;
    remembers a bounded number, since pages of a site are built alike."""
    key = (parent, tag, raw, zone)
    found = _known.get(key)
    if found is None:
        attributes: dict[str, str] = {}
        for n, a, b, c in _ATTRIBUTE.findall(raw):  # in order, so no value is taken for a name; the first of a name counts
            attributes.setdefault(n.lower(), html.unescape(a or b or c))
        look = _DIGITS.sub("0", f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}")
        found = (_signed(_hash(f"{parent}/{look}")), look, _named(tag, attributes, zone),
                 tag == "main" or attributes.get("role", "").lower() == "main")
        if len(_known) > 50_000:
            _known.clear()
        if len(raw) <= 1000:
            _known[key] = found
    return found


def parse(page: str, styled: bool = True) -> tuple[list[tuple[tuple[int, ...], bool, int, str]], set[tuple[int, int]], set[int]]:
    """Blocks of text in page order (style path, noise, zone, text), the (style node, presentation) pairs of the page,
    and its style nodes of doubtful names."""
    root = _Element("", 0, (), False, 0)
    stack, blocks, styles, buffer, doubts = [root], [], set(), [], set()

    def flush() -> None:
        if not buffer:
            return
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            top = stack[-1]
            blocks.append((top.path, top.noise, top.zone, text))

    def pop() -> None:
        flush()
        e = stack.pop()
        buffer.extend(e.before)  # the line goes on
        if not styled:
            return
        runs = [c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]]
        styles.add((e.node, _signed(_hash(repr(runs)))))

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                buffer.append(" ")
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK or tag in NEVER or any(e.tag == tag for e in stack[-3:]):
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth:
                    while len(stack) > depth:
                        pop()
            continue
        if tag in VOID:
            if tag in ("br", "img"):
                buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        raw = m[3] or m[6] or ""
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            buffer.append(" ")
            continue
        if tag not in BLOCK and tag not in NEVER:
            top = stack[-1]
            if tag in ("td", "th"):
                buffer.append(" ")
            if top.noise or not raw or _style(top.node, tag, raw, top.zone)[2] != NOISE:
                continue
        before = ()
        if tag in BLOCK:
            flush()
        else:  # unwanted inside a line
            before = tuple(buffer)
            buffer.clear()
        if tag in ENDS_P:
            while stack[-1].tag == "p":
                pop()
        if tag in SIBLINGS and stack[-1].tag in SIBLINGS[tag]:
            pop()
        elif tag in SIBLINGS and stack[-1].tag == "p" and len(stack) > 2 and stack[-2].tag in SIBLINGS[tag]:
            pop()
            pop()
        top = stack[-1]
        if raw.rstrip().endswith("/") and tag not in BLOCK:
            buffer.extend(before)
            continue
        node, look, named, is_main = _style(top.node, tag, raw, top.zone)
        top.children.append(look)
        noise = top.noise or named == NOISE
        zone = top.zone if noise else top.zone | IN_ARTICLE * (tag == "article") | IN_MAIN * is_main
        deep = len(top.path) >= DEPTH
        if named == DOUBTFUL and not deep:
            doubts.add(node)
        stack.append(_Element(tag, top.node if deep else node, top.path if deep else (*top.path, node), noise, zone, before))
    while len(stack) > 1:
        pop()
    flush()
    return blocks, styles, doubts


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The text of one page without its noise and without the branches of ``low`` style nodes."""
    blocks = [b for b in parse(page or "", styled=False)[0] if not b[1]]
    blocks = [b for b in blocks if b[2] & IN_MAIN] or blocks
    kept = [b for b in blocks if not low.intersection(b[0])] if low else blocks
    return "\n".join(b[3] for b in kept or blocks)


def page_classes(texts: list[str]) -> list[int]:
    """A number for each text, the same for copies and, with a chance of their likeness to the power of ``SKETCH``,
    for near copies."""
    h, offsets = shingle_hashes(Words(pa.array(texts, pa.string())))
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros(len(texts), "uint64")
    if len(full):
        for k in range(SKETCH):
            least = np.minimum.reduceat(mix(h + np.uint64(k)), offsets[:-1][full])
            out[full] = mix(out[full] + least)
    return out.view("int64").tolist()


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    """Rows of (host, html), about ``READ`` characters at a time; a longer page is alone."""
    held, size = [], 0
    for batch in it:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((host, page or ""))
            size += len(held[-1][1])
            if size >= READ:
                yield held
                held, size = [], 0
    yield held


def _observations(pages: DataFrame) -> DataFrame:
    """``host, node, kind, value, page, n, path``: that pages of a class (``page``) have a text at a style node (kind 0) or
    show a presentation of it (kind 1) or have the node (kind 2; its value says if its names are doubtful), and how many
    rows of a slice do."""
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(it):
            seen, paths = Counter(), {}
            parsed = [parse(page) for _, page in rows]
            classes = page_classes(["\n".join(b[3] for b in blocks if not b[1]) for blocks, *_ in parsed])
            for (host, _), (blocks, styles, doubts), page in zip(rows, parsed, classes):
                texts = {(path[-1] if path else 0, _signed(_hash(text))) for path, noise, _, text in blocks if not noise}
                seen.update((host, node, 0, text, page) for node, text in texts)
                live = {n for path, noise, _, _ in blocks if not noise for n in path}
                seen.update((host, node, 1, style, page) for node, style in styles if node in live)
                seen.update((host, node, 2, int(node in doubts), page) for node in live)
                paths.update(((host, path[-1]), path) for path, noise, _, _ in blocks if path and not noise)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64()),
                 pa.array([k[4] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64()),
                 pa.array([paths.pop(k[:2], None) if k[2] == 2 else None for k in keys], pa.list_(pa.int64()))],
                ["host", "node", "kind", "value", "page", "n", "path"])

    return pages.mapInArrow(read, "host bigint, node bigint, kind int, value bigint, page bigint, n bigint, path array<bigint>")


def node_importance(pages: DataFrame, damping: float = 0.9) -> DataFrame:
    """``host, node, pages, different, doubtful, importance`` of every style node that holds text, from rows of (host hash, html):
    ``pages`` counts classes of pages, ``different`` says how many classes of equal size would be as varied."""
    classes = _observations(pages).groupBy("host", "node", "kind", "value", "page").agg(
        F.sum("n").alias("rows"), F.max("path").alias("path"))
    rows = F.col("rows").cast("double")
    summed = classes.groupBy("host", "node", "kind", "value").agg(
        F.count("*").alias("n"), F.max("path").alias("path"),
        (F.log(F.sum(rows)) - F.sum(rows * F.log(rows)) / F.sum(rows)).alias("spread"))
    n = F.col("n").cast("double")

    def of(kind: int, c):
        return F.when(F.col("kind") == kind, c)

    nodes = staged(summed.groupBy("host", "node").agg(
        F.sum(of(2, F.col("n"))).alias("pages"), F.max(of(2, F.col("path"))).alias("path"),
        F.exp(F.max(of(2, F.col("spread")))).alias("different"), F.max(of(2, F.col("value") == 1)).alias("doubtful"),
        F.count(of(0, n)).alias("texts"), F.sum(of(0, F.log(n))).alias("log_texts"),
        F.count(of(1, n)).alias("styles"), F.sum(of(1, n)).alias("shown"), F.sum(of(1, n * F.log(n))).alias("n_log_n")),
        "site-nodes")
    base = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    held = nodes.where("texts > 0")
    content = held.select("host", F.explode("path").alias("node"), F.col("texts").alias("below"),
                          (F.col("texts") - F.col("log_texts") / base).alias("worth"))
    content = content.groupBy("host", "node").agg((F.sum("worth") / F.sum("below")).alias("content"))
    varied = F.when(F.col("shown") > 0, (F.log("shown") - F.col("n_log_n") / F.col("shown")) / F.log(F.greatest("shown", F.lit(2.0))))
    weight = F.pow(F.lit(damping), F.col("styles"))
    presented = F.when(F.col("styles") > 1, (1 - weight) * F.coalesce(varied, F.lit(0.0)) + weight * F.col("content"))
    return nodes.join(content, ["host", "node"]).select(
        "host", "node", "pages", "different", "doubtful", F.coalesce(presented, "content").alias("importance"))


def low_nodes(pages: DataFrame, threshold: float, doubtful: float, min_pages: int, min_share: float,
              least_different: float) -> DataFrame:
    """``host, node, rare``: the style nodes that are to be cut, and whether fewer than ``min_share`` of the host's pages have one."""
    scored = staged(node_importance(pages), "site-importance")
    # The pages of a host: the most that one of its nodes is on.
    size = scored.groupBy("host").agg(F.max("pages").alias("host_pages"))
    low = scored.where((F.col("importance") < F.when(F.col("doubtful"), F.lit(doubtful)).otherwise(F.lit(threshold)))
                       & (F.col("pages") >= min_pages) & (F.col("different") >= least_different)).join(size, "host")
    return low.select("host", "node", (F.col("pages") < min_share * F.col("host_pages")).alias("rare"))


def _rare_of_pages(pages: DataFrame, rare: DataFrame) -> DataFrame:
    """``host, html, rare``: the rare low nodes of pages, by host and digest of the html."""
    def nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for host, digest, page in zip(*(c.to_pylist() for c in batch.columns)):
                live = sorted({n for path, noise, _, _ in parse(page or "", styled=False)[0] if not noise for n in path})
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(live), pa.int64()), pa.array([digest] * len(live), pa.string()),
                                                  pa.array(live, pa.int64())], ["host", "html", "node"])

    concerned = pages.toDF("host", "html").select("host", F.md5("html").alias("digest"), "html").join(
        rare.select("host").distinct(), "host", "left_semi")
    return concerned.mapInArrow(nodes, "host bigint, html string, node bigint").join(rare, ["host", "node"]).groupBy(
        "host", "html").agg(F.collect_set("node").alias("rare"))


def extract_main_text(df: DataFrame, url: str = "url", page: str = "html", threshold: float = 0.3, min_pages: int = 8,
                      min_share: float = 0.01, least_different: float = 3.0, doubtful: float = 0.6) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to every row."""
    host = F.when(host_of(F.col(url)) != "", F.xxhash64(host_of(F.col(url))))
    rows = df.drop("text", "n_chars").withColumn("__host", host)
    pages = rows.where("__host is not null").select("__host", page)
    # Written, so that its size is known when the pages are joined: small ones are broadcast, large ones are not.
    low = staged(low_nodes(pages, threshold, doubtful, min_pages, min_share, least_different), "site-low")
    common = low.where("not rare").groupBy("host").agg(F.collect_set("node").alias("low"))
    rows = rows.join(common.toDF("__host", "__low"), "__host", "left")
    rare = low.where("rare").select("host", "node")
    if not rare.isEmpty():
        mine = staged(_rare_of_pages(pages, rare), "site-rare").toDF("__host", "__html", "__rare")
        none = F.array().cast("array<bigint>")
        rows = rows.withColumn("__html", F.md5(page)).join(mine, ["__host", "__html"], "left").withColumn(
            "__low", F.concat(F.coalesce("__low", none), F.coalesce("__rare", none)))
    at = {c: i for i, c in enumerate(df.drop("text", "n_chars").columns)}

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [main_text(p, frozenset(low or ())) for p, low in zip(batch.column(at[page]).to_pylist(), lists)]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"])

    kept = rows.select(*at, "__low")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__low")
    return kept.mapInArrow(cut, f"{fields}, text string, n_chars bigint")
