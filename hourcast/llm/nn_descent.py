"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Random hyperplanes (thresholds: medians of a bounded sample) deal the nodes to small
cells, whose members are compared to start the graph. Then, round by round, each node brings together the nodes
that list it and those it lists: neighbours of neighbours meet by joins on the node in the middle, and every
node keeps its nearest. A hub's list is cut to the ``in_degree`` nearest before the shuffle; the graph stays an
approximation, whose recall the tests measure against brute force.

A query holds a pool of its ``beam`` nearest nodes so far and has those expanded that are not yet: their
neighbours come from the block of nodes that holds them, and are measured in the blocks that hold the
neighbours, until nothing in the pool is left to expand. All queries advance together, a round is two joins on
the block. Blocks have about ``block_rows`` nodes, so no task holds more.

Bounds: ``sample`` vectors reach the driver for the thresholds; every row is indexed.
Defined results: vectors that are null, zero, of another length than most or with null or non-finite
components take no part, as query or candidate; nor do rows without an id. Equal distances go to the smaller id;
copies of a vector are all found; rows that repeat an id count once each way (the smallest vector).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (float array) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = (F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
            & F.exists(v, lambda c: c != 0) & F.col(key).isNotNull())
    rows = df.where(fine).select(F.col(key).alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["dim"] if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def distinct_nodes(rows: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, v`` (the smallest id of each vector), and ``node, id`` of up to ``copies`` members of each: a
    result never needs more. The rank is pruned before its shuffle."""
    keys = ["k1", "k2"]  # 128 bits that stand for the vector
    keyed = rows.select("id", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))
    first = keyed.groupBy(*keys).agg(F.min("id").alias("node"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    members = keyed.withColumn("r", rank).where(F.col("r") <= copies).join(first, keys).select("node", "id")
    return rows.join(first.select(F.col("node").alias("id")), "id").select(F.col("id").alias("node"), "v"), members


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, from 0."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("int32")
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def _vectors(column, dtype="<f4") -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)


def _nearest(ids: np.ndarray, dist: np.ndarray, most: int, but) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest different ids other than ``but``, ties to the smaller id."""
    keep = ids != but
    ids, dist = ids[keep], dist[keep]
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:most]
    return ids[first], dist[first]


def start_graph(nodes: DataFrame, k: int, cell: int, tables: int, sample: int, seed: int) -> DataFrame:
    """``u, ids, ds``: the nearest of the members of each node's cells, one row a table."""
    n = nodes.count()
    held = nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(sample).select("x").collect()
    if not held:
        return nodes.sparkSession.createDataFrame([], "u bigint, ids array<bigint>, ds array<float>")
    held = np.frombuffer(b"".join(bytes(r.x) for r in held), "<f4").reshape(len(held), -1)
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / cell))))
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((held.shape[1], tables * bits)).astype("f4")
    cuts = np.median(held @ planes, axis=0) if bits else np.empty(0)

    def codes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                over = (_vectors(batch.column(1)) @ planes > cuts).reshape(batch.num_rows, tables, bits)
                code = (over * (1 << np.arange(bits, dtype="int64"))).sum(axis=2)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, t, "int32")),
                         pa.array(code[:, t].astype("int64"))], ["node", "x", "t", "code"])

    coded = nodes.mapInArrow(codes, "node bigint, x binary, t int, code bigint")
    parts = coded.groupBy("t", "code").agg(F.ceil(F.count("*") / (2 * cell)).alias("parts"))
    coded = coded.join(parts, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def compare(cell_rows: pa.Table) -> pa.Table:
        ids, x = cell_rows["node"].to_numpy(), _vectors(cell_rows["x"])
        sq = (x ** 2).sum(axis=1)
        d = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0)
        near = [_nearest(ids, row, k, me) for me, row in zip(ids, d)]
        return pa.table({"u": ids, "ids": _list_array([i for i, _ in near], pa.int64()),
                         "ds": _list_array([s for _, s in near], pa.float32())})

    return (coded.select("t", "code", "part", "node", "x").groupBy("t", "code", "part")
            .applyInArrow(compare, "u bigint, ids array<bigint>, ds array<float>"))


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """One row a node from several: its ``k`` nearest."""
    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                (ids, at), (ds, _) = _lists(batch.column(1)), _lists(batch.column(2))
                near = [_nearest(ids[a:b], ds[a:b], k, u) for u, a, b in zip(batch.column(0).to_numpy(), at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), _list_array([i for i, _ in near], pa.int64()),
                                                  _list_array([d for _, d in near], pa.float32())], ["u", "ids", "ds"])

    lists = rows.groupBy("u").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("ds")).alias("ds"))
    return lists.mapInArrow(best, "u bigint, ids array<bigint>, ds array<float>")


def descend(graph: DataFrame, nodes: DataFrame, k: int, in_degree: int, tell: int) -> DataFrame:
    """One round: at each node v the nodes that list v are measured against one another and against v's own list;
    each hears of the ``tell`` nearest."""
    edges = graph.select("u", F.explode(F.arrays_zip("ids", "ds")).alias("e")).select(
        "u", F.col("e.ids").alias("v"), F.col("e.ds").alias("d"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
    into = staged(edges.withColumn("r", rank).where(F.col("r") <= in_degree).drop("r"), "ann-in")
    half = nodes.select("node", F.col("x").alias("x"))
    heard = into.join(half, F.col("u") == F.col("node")).select("v", F.lit(1).alias("lists"), F.col("u").alias("id"), "x")
    listed = edges.join(half, F.col("v") == F.col("node")).select(F.col("u").alias("v"), F.lit(0).alias("lists"),
                                                                  F.col("v").alias("id"), "x")
    met = heard.union(listed).groupBy("v").agg(F.collect_list(F.struct("lists", "id", "x")).alias("m"))

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            who, ids_out, ds_out = [], [], []
            m = batch.column(1)
            at = m.offsets.to_numpy()
            flat = m.values
            if not len(flat):
                continue
            lists, ids = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            x = _vectors(flat.field(2))
            for a, b in zip(at, at[1:]):
                mine = np.flatnonzero(lists[a:b]) + a
                if not len(mine) or b - a < 2:
                    continue
                sq = (x[a:b] ** 2).sum(axis=1)
                d = np.maximum(sq[mine - a][:, None] + sq[None] - 2 * x[mine] @ x[a:b].T, 0)
                d[ids[mine][:, None] == ids[None, a:b]] = np.inf
                t = min(tell, b - a - 1)
                near = np.argpartition(d, t - 1, axis=1)[:, :t]
                far = np.take_along_axis(d, near, axis=1)
                for i, me in enumerate(mine):
                    ok = np.isfinite(far[i])
                    who.append(ids[me])
                    ids_out.append(ids[a:b][near[i][ok]])
                    ds_out.append(far[i][ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(who, "int64")), _list_array(ids_out, pa.int64()),
                                              _list_array(ds_out, pa.float32())], ["u", "ids", "ds"])

    told = met.mapInArrow(meet, "u bigint, ids array<bigint>, ds array<float>")
    back = into.groupBy("v").agg(F.collect_list("u").alias("ids"), F.collect_list("d").alias("ds")).withColumnRenamed("v", "u")
    return _merged(graph.unionByName(told).unionByName(back), k)


def build_graph(nodes: DataFrame, k: int = 20, rounds: int = 2, cell: int = 256, tables: int = 2, in_degree: int = 20,
                tell: int = 8, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """``node, near``: the list of each node, nearest first, with the nodes that list it (``in_degree`` nearest)."""
    graph = staged(_merged(start_graph(nodes, k, cell, tables, sample, seed), k), "ann-start")
    for _ in range(rounds):
        graph = staged(descend(graph, nodes, k, in_degree, tell), "ann-round")
    edges = graph.select("u", F.explode(F.arrays_zip("ids", "ds")).alias("e")).select(
        "u", F.col("e.ids").alias("v"), F.col("e.ds").alias("d"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
    back = edges.withColumn("r", rank).where(F.col("r") <= in_degree).groupBy("v").agg(F.collect_list("u").alias("back"))
    near = F.array_distinct(F.concat("ids", F.coalesce("back", F.array().cast("array<bigint>"))))
    return graph.join(back, F.col("u") == F.col("v"), "left").select(F.col("u").alias("node"), near.alias("near"))


def _block(c, blocks: int):
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, k: int, beam: int = 400,
           block_rows: int = 20_000) -> DataFrame:
    """``qid, node, d2`` of the ``k`` nearest nodes found for each query (``qid, q, entry``; q as float64
    bytes like ``x`` of the nodes, entry a node to begin with)."""
    blocks = max(16, -(-nodes.count() // block_rows))
    near = staged(graph.withColumn("block", _block("node", blocks)), "ann-graph")
    spots = staged(nodes.withColumn("block", _block("node", blocks)), "ann-nodes")
    queries = staged(queries, "ann-queries")
    need = "block int, qid bigint, q binary, most double, ids array<bigint>"
    found = "qid bigint, ids array<bigint>, ds array<double>, open array<boolean>"

    def expand(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        """The neighbours of the wanted nodes of this block, by query."""
        ids, order = rows["node"].to_numpy(), None
        order = np.argsort(ids)
        ids = ids[order]
        near_ids, at = _lists(rows["near"].combine_chunks()) if len(rows) else (np.empty(0, "int64"), np.zeros(1, "int64"))
        out = []
        asked, ask_at = _lists(wanted["ids"].combine_chunks()) if len(wanted) else (np.empty(0, "int64"), [0])
        for a, b in zip(ask_at, ask_at[1:]):
            place = order[np.searchsorted(ids, asked[a:b])] if len(ids) else []
            out.append(np.unique(np.concatenate([near_ids[at[p]:at[p + 1]] for p in place])) if len(place)
                       else np.empty(0, "int64"))
        return pa.table({"qid": wanted["qid"], "q": wanted["q"], "most": wanted["most"], "ids": _list_array(out, pa.int64())})

    def measure(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        """Distances of the wanted nodes of this block, by query: the ``beam`` nearest below the query's bound."""
        qids, ids_out, ds_out = [], [], []
        if len(rows) and len(wanted):
            ids = rows["node"].to_numpy()
            order = np.argsort(ids)
            ids, x = ids[order], _vectors(rows["x"], "<f8")[order]
            asked, at = _lists(wanted["ids"].combine_chunks())
            qid, most, q = wanted["qid"].to_numpy(), wanted["most"].to_numpy(), wanted["q"].to_pylist()
            by = np.argsort(qid, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(qid[by])) + 1):
                want = np.unique(np.concatenate([asked[at[i]:at[i + 1]] for i in group]))
                place = np.searchsorted(ids, want)
                d = ((x[place] - np.frombuffer(q[group[0]], "<f8")) ** 2).sum(axis=1)
                keep = np.flatnonzero(d <= most[group[0]])
                keep = keep[np.lexsort((want[keep], d[keep]))[:beam]]
                qids.append(qid[group[0]])
                ids_out.append(want[keep])
                ds_out.append(d[keep])
        return pa.table({"qid": pa.array(qids, pa.int64()), "ids": _list_array(ids_out, pa.int64()),
                         "ds": _list_array(ds_out, pa.float64()),
                         "open": _list_array([np.ones(len(i), bool) for i in ids_out], pa.bool_())})

    def pool(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            (ids, at), (ds, _), (free, _) = (_lists(batch.column(i)) for i in (1, 2, 3))
            out = []
            for a, b in zip(at, at[1:]):
                i, d, o = ids[a:b], ds[a:b], free[a:b].astype(bool)
                order = np.lexsort((o, i, d))  # of a node met twice the row that was expanded comes first
                i, d, o = i[order], d[order], o[order]
                _, first = np.unique(i, return_index=True)
                first = np.sort(first)[:beam]
                out.append((i[first], d[first], o[first]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _list_array([x[0] for x in out], pa.int64()),
                 _list_array([x[1] for x in out], pa.float64()), _list_array([x[2] for x in out], pa.bool_())],
                ["qid", "ids", "ds", "open"])

    def by_block(rows: DataFrame) -> DataFrame:
        one = rows.select("qid", "q", "most", F.explode("ids").alias("id")).withColumn("block", _block("id", blocks))
        return one.groupBy("block", "qid").agg(F.first("q").alias("q"), F.first("most").alias("most"),
                                               F.collect_list("id").alias("ids")).select("block", "qid", "q", "most", "ids")

    def measured(wanted: DataFrame) -> DataFrame:
        return spots.groupBy("block").cogroup(by_block(wanted).groupBy("block")).applyInArrow(measure, found)

    def pooled(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("qid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "ds", "open")])
        return staged(lists.mapInArrow(pool, found), "ann-pool")

    inf = F.lit(float("inf"))
    state = pooled(measured(queries.select("qid", "q", inf.alias("most"), F.array("entry").alias("ids"))))
    while state.where(F.exists("open", lambda o: o)).limit(1).count():
        # Nothing beyond a full pool's last can enter it.
        most = F.when(F.size("ds") >= beam, F.array_max("ds")).otherwise(inf)
        zipped = F.filter(F.arrays_zip("ids", "open"), lambda e: e["open"])
        wanted = state.select("qid", most.alias("most"), F.transform(zipped, lambda e: e["ids"]).alias("ids"))
        wanted = by_block(wanted.where(F.size("ids") > 0).join(queries.select("qid", "q"), "qid"))
        beyond = near.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
            expand, "qid bigint, q binary, most double, ids array<bigint>")
        closed = state.withColumn("open", F.transform("open", lambda o: F.lit(False)))
        state = pooled(closed.unionByName(measured(beyond)))
    best = state.select("qid", F.posexplode(F.arrays_zip("ids", "ds"))).where(F.col("pos") < k)
    return best.select("qid", F.col("col.ids").alias("node"), F.col("col.ds").alias("d2"))


def nearest(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", beam: int = 400,
            **options) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``df`` that ``is_query`` picks, against all other rows."""
    rows = staged(valid_vectors(df, key, vector), "ann-rows")
    nodes, members = distinct_nodes(rows, k + 1)
    members = staged(members, "ann-members")

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            values, at = _lists(batch.column(1))
            both = [pa.array([values[a:b].astype(t).tobytes() for a, b in zip(at, at[1:])], pa.binary())
                    for t in ("<f4", "<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *both], ["node", "x", "y"])

    nodes = staged(nodes.select("node", "v").mapInArrow(pack, "node bigint, x binary, y binary"), "ann-packed")
    graph = staged(build_graph(nodes.select("node", "x"), **options), "ann-built")
    asked = rows.where(is_query(F.col("id"))).select("id", "v")
    # A query is an indexed row itself: the search begins at its own node.
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2")]
    entry = asked.select(F.col("id").alias("qid"), *keys).join(
        rows.select("id", *keys).groupBy("k1", "k2").agg(F.min("id").alias("entry")), ["k1", "k2"]).select("qid", "entry")
    packed = asked.mapInArrow(pack, "node bigint, x binary, y binary").select(F.col("node").alias("qid"), F.col("y").alias("q"))
    hits = search(packed.join(entry, "qid"), graph, nodes.select("node", F.col("y").alias("x")), k + 1, max(beam, k + 1))
    ranked = hits.join(members, "node").where("id <> qid")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))
    return (ranked.withColumn("rank", place).where(F.col("rank") <= k)
            .select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.sqrt("d2").alias("score")))
