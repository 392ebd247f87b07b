"""Nearest vectors by inner product: an NN-descent neighbour graph, searched greedily.

Equal vectors are one node with its smallest ids (no other copy can be among the nearest ``k``).  Nodes
are scaled by the largest norm and get one more component that makes all norms equal, so neighbours by
inner product are neighbours on a sphere; the graph works on codes of 16 bits a component.

* Start: several codes of random hyperplanes, split at sampled medians, cut the nodes into blocks of
  bounded size; a block is one matrix product.
* Descent: each node's neighbours and reverse neighbours, some new ones and some old ones drawn by hash,
  are joined on the node between them; a member keeps the few best partners over its own bar.  Rounds
  end when hardly any link is new.
* Search: a query starts at its own node.  Each round opens its best unopened nodes, whose lists of
  neighbours are stored by node, so queries travel to the lists, and keeps the best ``beam`` seen.

Found candidates are scored again in double precision on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, materialize_by_key

_SAMPLE = 4000  # nodes whose projections give the medians of the hyperplanes
_LINKS = "u bigint, w bigint, sim float"


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id``, ``vec`` (array<double>), one row per id; rows without an id or a usable vector are left out."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    bad = F.exists(F.col("vec"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    some = F.exists(F.col("vec"), lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.coalesce(~bad & some, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _key() -> Column:
    return F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))


def _pick(col: pa.ListArray, field: str | None = None) -> tuple[np.ndarray, np.ndarray | pa.Array]:
    """Offsets of a list column and its flattened values."""
    flat = col.flatten()
    return col.offsets.to_numpy() - col.offsets[0].as_py(), flat if field is None else flat.field(field)


def _rows(codes: pa.Array) -> np.ndarray:
    """Equal-length binaries as float rows: four bytes of scale, then 16-bit steps."""
    if len(codes) == 0:
        return np.zeros((0, 1), np.float32)
    at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset:codes.offset + len(codes) + 1]
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(codes), -1)
    body, scale = (np.ascontiguousarray(raw[:, a:b]).view(t) for a, b, t in ((4, None, "<i2"), (0, 4, "<f4")))
    return body.astype(np.float32) * scale


def _encode(x: np.ndarray) -> list[bytes]:
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30).astype(np.float32) / np.float32(32767)
    body = np.rint(x / scale[:, None]).astype("<i2")
    return [s.tobytes() + b.tobytes() for s, b in zip(scale, body)]


def _lifted(vecs: list[list[float]], dim: int, top: float) -> np.ndarray:
    """Vectors over ``top``, zero-padded, with the component that makes their norms 1."""
    x = np.zeros((len(vecs), dim + 1))
    for i, v in enumerate(vecs):
        x[i, :len(v)] = v
    x /= top
    x[:, dim] = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
    return x


def _partners(g: np.ndarray, bar: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of similarities the places of its ``most`` largest that are over its bar."""
    if g.shape[1] > most:
        at = np.argpartition(-g, most - 1, axis=1)[:, :most]
    else:
        at = np.broadcast_to(np.arange(g.shape[1]), g.shape)
    i, c = np.nonzero(np.take_along_axis(g, at, 1) > bar[:, None])
    return i, at[i, c]


def _link_batch(u: list, w: list, sim: list) -> pa.RecordBatch:
    join = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([join(u, pa.int64()), join(w, pa.int64()), join(sim, pa.float32())], ["u", "w", "sim"])


class Graph:
    """Nodes, their codes and the neighbour lists of one table of vectors."""

    def __init__(self, nodes: DataFrame, codes: DataFrame, links: DataFrame, dim: int, top: float, rounds: int):
        self.nodes, self.codes, self.links, self.dim, self.top, self.rounds = nodes, codes, links, dim, top, rounds


def _nodes(valid: DataFrame, copies: int) -> DataFrame:
    """``node``, ``ids`` (the ``copies`` smallest), ``vec``, ``key`` of each distinct vector."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = valid.withColumn("r", rank).where(F.col("r") <= copies)  # cut in each task before the shuffle
    nodes = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "ids", "vec", _key().alias("key")), "nn-nodes")


def _codes(nodes: DataFrame, dim: int, top: float, n: int, block: int, trees: int, seed: int) -> DataFrame:
    """``node``, ``code`` and ``cells``: per tree the cell of the node among 2^bits."""
    bits = max(0, math.ceil(math.log2(n / block)))
    planes = np.random.default_rng(seed).standard_normal((dim + 1, trees * bits))
    some = nodes.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(max(1, n // _SAMPLE))) == 0).select("vec").limit(2 * _SAMPLE)
    medians = np.median(_lifted([r[0] for r in some.collect()] or [[1.0]], dim, top) @ planes, axis=0)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _lifted(b.column(1).to_pylist(), dim, top)
            cells = ((x @ planes > medians).reshape(len(x), trees, bits) @ weights).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_encode(x), pa.binary()),
                                              pa.array(list(cells), pa.list_(pa.int64()))], ["node", "code", "cells"])

    return materialize(nodes.select("node", "vec").mapInArrow(work, "node bigint, code binary, cells array<bigint>"), "nn-codes")


def _first_links(codes: DataFrame, block: int, per_block: int) -> DataFrame:
    """Best partners of each node inside its block of each tree."""
    cells = codes.select("node", F.posexplode("cells").alias("tree", "cell"))
    sizes = cells.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = (codes.select("node", "code", F.posexplode("cells").alias("tree", "cell")).join(sizes, ["tree", "cell"])
              .withColumn("part", F.pmod(F.xxhash64("tree", "node"), F.col("parts"))))

    def work(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        x = _rows(t.column("code").combine_chunks())
        us, ws, sims = [], [], []
        for at in range(0, len(ids), 512):
            g = x[at:at + 512] @ x.T
            g[np.arange(len(g)), at + np.arange(len(g))] = -np.inf
            i, j = _partners(g, np.full(len(g), -np.inf, np.float32), per_block)
            us.append(ids[at + i])
            ws.append(ids[j])
            sims.append(g[i, j])
        return pa.Table.from_batches([_link_batch(us, ws, sims)])

    return placed.select("node", "code", "tree", "cell", "part").groupBy("tree", "cell", "part").applyInArrow(work, _LINKS)


def _best_links(found: DataFrame, old: DataFrame | None, width: int, draw: int, turn: int) -> DataFrame:
    """The ``width`` best distinct links of each node; ``turn_rank`` orders a node's new (or old) links by hash."""
    rows = found.withColumn("new", F.lit(True))
    if old is not None:
        rows = rows.unionByName(old.select("u", "w", "sim", (F.col("new") & (F.col("turn_rank") > draw)).alias("new")))
    rows = rows.repartition("u").groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    chance = Window.partitionBy("u", "new").orderBy(F.xxhash64(F.lit(turn), "u", "w"))
    out = (rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= width).drop("place")
           .withColumn("turn_rank", F.row_number().over(chance)))
    return materialize(out, "nn-links")


def _descend(links: DataFrame, codes: DataFrame, width: int, draw: int, per_centre: int, turn: int) -> DataFrame:
    """Links proposed by joining neighbours of one node with each other."""
    forward = links.where(F.col("turn_rank") <= draw).select(F.col("u").alias("c"), F.col("w").alias("m"), "new")
    chance = Window.partitionBy("c", "new").orderBy(F.xxhash64(F.lit(turn), "m", "c"))
    back = (links.select(F.col("w").alias("c"), F.col("u").alias("m"), "new")
            .withColumn("r", F.row_number().over(chance)).where(F.col("r") <= draw).drop("r"))
    bars = links.groupBy("u").agg(F.when(F.count(F.lit(1)) >= width, F.min("sim")).alias("bar"))
    state = codes.select("node", "code").join(bars, F.col("node") == F.col("u"), "left").select(F.col("node").alias("m"), "code", "bar")
    members = (forward.union(back).join(state, "m").groupBy("c")
               .agg(F.collect_list(F.struct("m", "new", "bar", "code")).alias("ms"), F.max("new").alias("any"))
               .where("any").select("ms"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = _pick(b.column(0))
            ids = flat.field("m").to_numpy()
            fresh = flat.field("new").to_numpy(zero_copy_only=False).astype(bool)
            bars = np.nan_to_num(flat.field("bar").to_numpy(zero_copy_only=False).astype(np.float32), nan=-np.inf)
            x = _rows(flat.field("code"))
            us, ws, sims = [], [], []
            for lo, hi in zip(ends[:-1], ends[1:]):
                order = np.lexsort((~fresh[lo:hi], ids[lo:hi]))  # a member met twice counts as new
                m = lo + order[np.concatenate([[True], np.diff(ids[lo:hi][order]) != 0])]
                a = m[fresh[m]]
                g = x[a] @ x[m].T
                g[ids[a][:, None] == ids[m][None]] = -np.inf
                i, j = _partners(g, bars[a], per_centre)
                us.append(ids[a[i]])
                ws.append(ids[m[j]])
                sims.append(g[i, j])
                j, i = _partners(g.T, bars[m], per_centre)
                us.append(ids[m[j]])
                ws.append(ids[a[i]])
                sims.append(g[i, j])
            out = _link_batch(us, ws, sims)
            keep = np.isfinite(out.column(2).to_numpy())
            yield out.filter(pa.array(keep))

    return members.mapInArrow(work, _LINKS)


def build_graph(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 40, draw: int = 20,
                per_centre: int = 6, block: int = 256, trees: int = 12, per_block: int = 12, settled: float = 0.03,
                max_rounds: int = 8, copies: int = 21, seed: int = 5) -> Graph | None:
    """Neighbour graph over all usable vectors; None if there are none.

    ``width`` links a node, at first the ``per_block`` best of each of ``trees`` blocks; descent ends
    when under ``settled`` of all links are new, or after ``max_rounds``.  Vectors shorter than the
    longest are padded with zeros.  Steps and parameters are the same for tables of any size.
    """
    nodes = _nodes(valid_vectors(vectors, id_col, vec_col), copies)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, dim, top = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(norm)).first()
    if not n:
        return None
    codes = _codes(nodes, dim, top, n, block, trees, seed)
    links = _best_links(_first_links(codes, block, per_block), None, width, draw, 0)
    for rounds in range(1, max_rounds + 1):
        links = _best_links(_descend(links, codes, width, draw, per_centre, rounds), links, width, draw, rounds)
        if links.where("new").count() < settled * n * width:
            break
    return Graph(nodes, codes, links, dim, top, rounds)


def greedy_search(graph: Graph, starts: DataFrame, beam: int = 160, opened: int = 16, back: int = 20) -> DataFrame:
    """``q``, ``w``, ``score``: the best ``beam`` nodes found for each query node ``q`` of ``starts``.

    A node's list holds its links and the ``back`` best links to it, so that nodes nobody links to are
    reached as well.  All queries go on together; a query is done when none of its best nodes is unopened.
    """
    near = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    to = graph.links.select(F.col("w").alias("u"), F.col("u").alias("w"), "sim").withColumn("r", F.row_number().over(near))
    both = graph.links.select("u", "w").union(to.where(F.col("r") <= back).select("u", "w")).distinct()
    lists = (both.join(graph.codes.select(F.col("node").alias("w"), "code"), "w")
             .repartition(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u")
             .groupBy("u").agg(F.collect_list(F.struct("w", "code")).alias("ws")))
    lists = materialize_by_key(lists, "nn-lists", "u")
    asked = materialize(starts.select(F.col("node").alias("q")).distinct()
                        .join(graph.codes.select(F.col("node").alias("q"), F.col("code").alias("asks")), "q"), "nn-asked")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "w")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, bar = b.column(0).to_numpy(), np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(np.float32), nan=-np.inf)
            asks = _rows(b.column(1))
            asks[:, -1] = 0  # the lifted component belongs to stored vectors only
            ends, flat = _pick(b.column(3))
            ids, x = flat.field("w").to_numpy(), _rows(flat.field("code"))
            who = np.repeat(np.arange(len(q)), np.diff(ends))
            score = np.einsum("ij,ij->i", asks[who], x)
            keep = score > bar[who]
            yield _link_batch([q[who[keep]]], [ids[keep]], [score[keep]])

    start = asked.select("q", F.col("q").alias("w"), F.lit(0.0).cast("float").alias("score"), F.lit(False).alias("done"))
    state = materialize(start.withColumn("turn", F.lit(1)), "nn-beam")
    while True:
        front = state.where(F.col("turn") <= opened)
        if front.isEmpty():
            break
        bars = state.groupBy("q").agg(F.when(F.count(F.lit(1)) >= beam, F.min("score")).alias("bar"))
        ask = front.select("q", "w").join(asked, "q").join(bars, "q").select("q", "asks", "bar", F.col("w").alias("u"))
        seen = ask.join(lists, "u").select("q", "asks", "bar", "ws").mapInArrow(work, "q bigint, w bigint, score float")
        rows = seen.withColumn("done", F.lit(False)).unionByName(
            state.select("q", "w", "score", (F.col("done") | F.coalesce(F.col("turn") <= opened, F.lit(False))).alias("done")))
        rows = rows.repartition("q").groupBy("q", "w").agg(F.max("score").alias("score"), F.max("done").alias("done"))
        # the query's own node is no answer, but it is kept so that it is not opened again
        rows = rows.withColumn("place", F.row_number().over(best)).where((F.col("place") <= beam) | (F.col("q") == F.col("w")))
        order = Window.partitionBy("q", "done").orderBy(F.desc("score"), "w")
        state = materialize(rows.withColumn("turn", F.when(~F.col("done"), F.row_number().over(order))).drop("place"), "nn-beam")
    return state.select("q", "w", "score")


def _dot(a: str, b: str) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(vectors: DataFrame, queries: Column | None = None, k: int = 20, id_col: str = "vec_id",
                    vec_col: str = "embedding", beam: int = 160, spare: int = 20, **graph_options) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest found of each query.

    ``queries`` is a condition on ``vec_id`` (by default the ids divisible by 20); candidates are all
    other rows.  Nearest is the largest inner product, ties go to the smaller id.  All candidates are
    returned if there are fewer than ``k``.  Rows whose vector is NULL, zero or holds NULL or
    non-finite components take no part, nor do rows without an id; of rows that repeat an id the
    smallest vector counts.  Copies of one vector share a node and are all answers.  Other columns are
    left out, whatever their names; an empty table gives an empty result.  ``beam`` nodes are kept
    during the search and the best ``k + spare`` of them are scored exactly.
    """
    spark = vectors.sparkSession
    wanted = F.col("vec_id") % 20 == 0 if queries is None else queries
    kind = vectors.schema[id_col].dataType.simpleString()
    graph = build_graph(vectors, id_col, vec_col, copies=k + 1, **graph_options)
    if graph is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    asks = valid_vectors(vectors, id_col, vec_col).where(wanted).select(F.col("vec_id").alias("query_id"), _key().alias("key"))
    asks = materialize(asks.join(graph.nodes.select("node", "key"), "key").select("query_id", "node"), "nn-queries")
    found = greedy_search(graph, asks, beam)
    own = asks.select(F.col("node").alias("q")).distinct().select("q", F.col("q").alias("w"), F.lit(None).cast("float").alias("score"))
    near = Window.partitionBy("q").orderBy(F.desc("score"), "w")
    # copies of the query's own vector are answers too; its node is kept beside the best others
    few = (found.where(F.col("q") != F.col("w")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + spare)
           .select("q", "w").union(own.select("q", "w")))
    vec = graph.nodes.select("node", "vec")
    pairs = (few.join(graph.nodes.select(F.col("node").alias("w"), "ids", F.col("vec").alias("b")), "w")
             .join(vec.select(F.col("node").alias("q"), F.col("vec").alias("a")), "q")
             .select("q", "ids", _dot("a", "b").alias("score")))
    order = [F.desc("score"), F.asc("vec_id")]
    best = (pairs.select("q", "score", F.explode("ids").alias("vec_id"))
            .withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1))
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    # one list of k + 1 answers per node: a query takes the first k that are not itself
    mine = asks.join(best, F.col("node") == F.col("q")).select(
        "query_id", F.slice(F.filter("best", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("at", "s")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))
