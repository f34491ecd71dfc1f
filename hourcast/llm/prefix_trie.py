"""Trie of conversation prefixes by van Emde Boas recursion.

A conversation is a string of symbols, one a turn: a hash of role and text, and the text's length. The trie of all
strings is never built level by level: a window of 2k levels is cut at half depth. The first k symbols of a
string below a window's root get a name; the strings cut there, equal ones merged, are the upper window,
and the rest of each hangs below its name as a lower window. All windows of a round are cut in one job, upper
and lower alike, so a trie of depth D takes log2 D rounds; in the last a window is one level and a row one node.

Totals go up the same way: when windows of k levels are summed, the totals of the lower ones are grafted on the names
at their roots and from there on the nodes above them in the upper window, again in log2 D rounds.

Defined results: turns stand in the order of their number, null first, equal numbers by a hash of role and text;
null role or text is empty; repeated rows are turns of their own; rows without a conversation id belong to none;
an empty table has no nodes, not even a root. A conversation is one row of 24 bytes a turn, so its texts
may be of any length. Nodes with any number of children or members are summed before they are shuffled.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.chunks import salted_join
from .common import require, staged

NAME, SYMBOL = 16, 24
ROOT = bytes(NAME)
BLOCK = 4096  # consecutive ids that one task joins to a line


def _hashed(c: Column) -> Column:
    return F.unhex(F.md5(c))


def symbol(role: Column, text: Column) -> Column:
    """16 bytes that name a turn, and its number of code points in 8 bytes. The role's length goes in front, so
    role and text cannot be shifted against each other."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    turn = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    size = F.lpad(F.hex(F.char_length(text).cast("bigint")), 16, "0")
    return F.concat(_hashed(turn), F.unhex(size))


def strings(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """``conv, string``: the symbols of each conversation in order."""
    require(turns, [conv, turn, role, text])
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), symbol(F.col(role), F.col(text)).alias("symbol"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "symbol")))["symbol"]  # null turns sort first
    return (rows.groupBy("conv").agg(F.unhex(F.array_join(F.transform(ordered, F.hex), "")).alias("string")))


def _size(c: str = "string") -> Column:
    return (F.octet_length(c) / SYMBOL).cast("int")


def _part(start: Column | int, count: Column | int, c: str = "string") -> Column:
    """``count`` symbols after the first ``start``."""
    start, count = (F.lit(x) if isinstance(x, int) else x for x in (start, count))
    return F.substring(F.col(c), start * SYMBOL + 1, count * SYMBOL)


def _rest(start: Column | int, c: str = "string") -> Column:
    return _part(start, F.greatest(_size(c) - start, F.lit(0)), c)


def name_of(root: bytes, string: bytes) -> bytes:
    return hashlib.md5(root + string).digest()


def _name(string: Column) -> Column:
    """``name_of`` a string below ``root``."""
    return _hashed(F.concat(F.col("root"), string))


def path_names(root: bytes, string: bytes, leaf: bytes | None, height: int) -> list[bytes]:
    """Names of the nodes of a window's string, as the rounds of cuts give them."""
    size = len(string) // SYMBOL
    if height == 1:
        return [leaf or name_of(root, string)] if size else []
    half = height // 2
    if size < half:
        return path_names(root, string, None, half)
    cut = name_of(root, string[:half * SYMBOL])
    return path_names(root, string[:half * SYMBOL], cut, half) + path_names(cut, string[half * SYMBOL:], leaf, half)


def _cut(windows: DataFrame, half: int) -> DataFrame:
    """Upper and lower windows of ``half`` levels of windows twice as high. Rows: the depth of the window's root,
    its name, a string below it, the name of the string's end if a cut gave it one, members and the smallest."""
    prefix = _part(0, half)
    named = windows.withColumn("cut", F.when(_size() >= half, _name(prefix)))
    upper = (named.withColumn("string", prefix).groupBy("depth", "root", "string")
             .agg(F.first("cut").alias("leaf"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
             .withColumn("upper", F.lit(True)))
    lower = named.where(_size() > half).select(
        (F.col("depth") + half).alias("depth"), F.col("cut").alias("root"), _rest(half).alias("string"), "leaf",
        "n_convs", "conv_id", F.lit(False).alias("upper"))
    return upper.unionByName(lower)


def _windows(convs: DataFrame, height: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """All nodes, and by height the windows whose strings end at a cut."""
    rows = staged(convs.where(_size() > 0).groupBy("string").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
        .select(F.lit(0).alias("depth"), F.lit(ROOT).alias("root"), "string", F.lit(None).cast("binary").alias("leaf"),
                "n_convs", "conv_id"), "strings")
    grafts = {}
    while height > 1:
        height //= 2
        rows = staged(_cut(rows, height), "windows")
        grafts[height] = rows.where(F.col("upper") & F.col("leaf").isNotNull()).select("depth", "root", "string", "leaf")
    chars = F.conv(F.hex(F.substring("string", NAME + 1, SYMBOL - NAME)), 16, 10).cast("bigint")
    nodes = rows.select(F.coalesce("leaf", _name(F.col("string"))).alias("node"), F.col("root").alias("parent"),
                        (F.col("depth") + 1).alias("depth"), "n_convs", "conv_id", chars.alias("chars"))
    return nodes, grafts


def _grafted(totals: DataFrame, windows: DataFrame, height: int) -> DataFrame:
    """What the lower windows add to the nodes above them in the upper ones of the same height."""
    below = (totals.where((F.col("depth") - 1) % (2 * height) == height).groupBy(F.col("parent").alias("leaf"))
             .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for depth, root, string, leaf, n, saved in zip(*(c.to_pylist() for c in batch.columns)):
                above = root
                for k, node in enumerate(path_names(root, string, leaf, height), 1):
                    rows.append((node, above, depth + k, n, saved))
                    above = node
            for lo in range(0, len(rows), 50_000):
                columns = zip(*rows[lo:lo + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))],
                    ["node", "parent", "depth", "n_leaves", "saved"])

    pairs = windows.join(below, "leaf").select("depth", "root", "string", "leaf", "n_leaves", "saved").mapInArrow(
        run, "node binary, parent binary, depth int, n_leaves bigint, saved bigint")
    return pairs.groupBy("node", "parent", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _ends(convs: DataFrame, height: int) -> DataFrame:
    """``node, ends_sha256``: the hash of the sorted ids of the conversations that end at a node. Ids are joined in
    blocks of consecutive ones; one task streams the lines of a node through its hash and keeps none."""
    def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ends = [(path_names(ROOT, s, None, height) or [ROOT])[-1] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.binary())], ["conv", "node"])

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in it:
            done = []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == node:
                    state.update(b"," + line.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                              pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])],
                                             ["node", "ends_sha256"])

    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    lines = (convs.select("conv", "string").mapInArrow(last, "conv bigint, node binary")
             .groupBy("node", F.floor(F.col("conv") / BLOCK).alias("block")).agg(F.array_join(ids, ",").alias("line")))
    return (lines.repartition("node").sortWithinPartitions("node", "block").select("node", "line")
            .mapInArrow(hashed, "node binary, ends_sha256 string"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``conv, string`` rows: ``conv_id`` (its smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. Leaves and saved tokens are those
    of the whole subtree; a node saves its last turn for each member but one."""
    convs = staged(convs.select(F.col("conv").cast("bigint").alias("conv"), "string"), "conversations")
    all_convs, smallest, longest = convs.agg(F.count("*"), F.min("conv"), F.max(_size())).first()
    height = 1 << max((longest or 0) - 1, 0).bit_length()
    nodes, grafts = _windows(convs, height)
    top = convs.sparkSession.createDataFrame(
        [(ROOT, 0, all_convs, smallest)] if all_convs else [], "node binary, depth int, n_convs bigint, conv_id bigint")
    nodes = nodes.unionByName(top, allowMissingColumns=True)
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children.where("node is not null"), "node", "left").fillna(0, ["n_children", "chars"]), "nodes")
    totals = nodes.select("node", "parent", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    for k in sorted(grafts):
        totals = totals.unionByName(staged(_grafted(totals, grafts[k], k), "grafts"))
    sum_up = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    top = totals.where("depth = 1").groupBy(F.col("parent").alias("node")).agg(*sum_up)
    sums = totals.select("node", "n_leaves", "saved").unionByName(top).groupBy("node").agg(*sum_up)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # A parent may have a large share of all nodes.
    rows = salted_join(nodes, parents, ["parent"], ["node"], "left").join(sums, "node").join(
        _ends(convs, height), "node", "left")
    return rows.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(convs: DataFrame, base: Column, head: Column) -> DataFrame:
    """Strings whose first ``head`` symbols are those of conversation ``base``, as many as it has, and whose rest
    is their own behind their first ``head``. ``head`` is small, so only heads travel to a base's followers."""
    rows = convs.withColumn("base", base).withColumn("head", head)
    most = rows.agg(F.max("head")).first()[0] or 0
    heads = convs.select(F.col("conv").alias("base"), _part(0, most).alias("start"))
    return salted_join(rows, heads, ["base"], ["conv"], "left").select(
        "conv", F.concat(F.coalesce(_part(F.lit(0), F.col("head"), "start"), F.lit(b"")), _rest(F.col("head"))).alias("string"))
