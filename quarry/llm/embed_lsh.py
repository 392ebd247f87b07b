"""Near-duplicate vectors: p-stable hashing proposes, exact cosine decides.

Vectors are normalised; cosine ``c`` is Euclidean distance sqrt(2 - 2c).  A table key is ``k``
quantised Gaussian projections, floor((a . x + b) / w); vectors that share a key in any of ``L``
tables are compared exactly.  ``k`` grows with the logarithm of the table size, so buckets of
unrelated vectors stay small, and ``L`` follows from the recall wanted at the threshold itself.

Every pair is judged once: in the first table where its keys agree (each row carries all its keys).
A bucket returns one row per member - its link count and the smallest member it reaches inside the
bucket - never pairs.  Buckets over ``block`` rows are cut into blocks, and each pair of blocks is a
group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, materialize, mix64


def _collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for two points (2-stable case)."""
    t = width / distance
    return 1 - 2 * 0.5 * math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def hash_plan(n: int, threshold: float, recall: float) -> tuple[float, int, int]:
    """Width, projections per table and tables for ``n`` vectors."""
    near = math.sqrt(2 - 2 * threshold)
    width = 4 * near
    far = _collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 16) / 8) / -math.log(far)))
    hit = _collision(near, width) ** k
    return width, k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _bucket_links(a: np.ndarray, ka: np.ndarray, b: np.ndarray, kb: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold in double precision and share none of the earlier tables' keys."""
    ok = a @ b.T >= threshold
    for t in range(ka.shape[1]):
        ok &= ka[:, t][:, None] != kb[:, t][None, :]
    return ok


def _smallest_reached(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id in each member's component, over the links (a[i], b[i]) of one group."""
    low = c.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, a, was[b])
        np.minimum.at(low, b, was[a])
        if (low == was).all():
            return low


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # keeps the squares finite
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x


def _large_group(x: np.ndarray, keys: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group, a stripe of rows at a time: members ``first`` against members ``second``."""
    a, b = np.flatnonzero(first), np.flatnonzero(second)
    one, two = [], []
    for at in range(0, len(a), 512):
        part = a[at:at + 512]
        i, j = np.nonzero(_bucket_links(x[part], keys[part], x[b], keys[b], threshold))
        one.append(part[i])
        two.append(b[j])
    return np.concatenate(one), np.concatenate(two)


def _reached(c: np.ndarray, many: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Per linked row its links (copies counted) and the smallest class it reaches."""
    apart = left != right
    left, right = left[apart], right[apart]
    links = np.bincount(left, weights=many[right], minlength=len(c)).astype(np.int64)
    low = _smallest_reached(c, left, right)
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(links[some]), pa.array(low[some])], ["c", "links", "low"])


def _judge_rows(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a table sorted by group; groups of one size are one stacked product."""
    t, key, i, j = (rows.column(name).to_numpy() for name in ("t", "key", "i", "j"))
    c, many, own = (rows.column(name).to_numpy() for name in ("c", "n", "own"))
    lists = rows.column("v").combine_chunks()
    dims, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    at_v = np.concatenate([[0], np.cumsum(dims)])
    earlier = rows.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    at_k = np.concatenate([[0], np.cumsum(t)])  # a row carries the keys of the t tables before its own
    fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(t)))
    left, right = [], []
    kinds = np.stack([t[start], size, dims[start]], axis=1)
    for table, many_rows, dim in np.unique(kinds[size > 1], axis=0):
        heads = start[(kinds == (table, many_rows, dim)).all(axis=1)]
        step = max(1, 2_000_000 // (many_rows * max(many_rows, dim)))  # groups whose products are held at once
        for at in range(0, len(heads), step):
            members = heads[at:at + step, None] + np.arange(many_rows)
            picked = members.ravel()
            x = _unit(flat[(at_v[picked][:, None] + np.arange(dim))])
            k = earlier[(at_k[picked][:, None] + np.arange(table))]
            if many_rows > 64:
                for g, rowset in enumerate(members):
                    part = slice(g * many_rows, (g + 1) * many_rows)
                    side, head = own[rowset], rowset[0]
                    one, two = _large_group(x[part], k[part], side == i[head], side == j[head], threshold)
                    if i[head] != j[head]:
                        one, two = np.concatenate([one, two]), np.concatenate([two, one])
                    yield _reached(c[rowset], many[rowset], one, two)
                continue
            x = x.reshape(len(members), many_rows, dim)
            g, one, two = np.nonzero(x @ x.transpose(0, 2, 1) >= threshold)
            a, b = members[g, one], members[g, two]
            # two blocks of a bucket meet here; within a block another group judges
            meet = (i[a] == j[a]) | (own[a] != own[b])
            k = k.reshape(len(members), many_rows, table)
            for at_pair in range(0, len(a), 100_000):
                s = slice(at_pair, at_pair + 100_000)
                meet[s] &= ~(k[g[s], one[s]] == k[g[s], two[s]]).any(axis=1)
            left.append(a[meet])
            right.append(b[meet])
    left, right = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    yield _reached(c, many, left, right)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           threshold: float = 0.9, recall: float = 0.95, block: int = 2048, seed: int = 13) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are NULL, zero, or hold NULL or non-finite parts link with nothing and are their own
    component; vectors of different lengths never link.  Equal vectors are judged once, as one class
    with a multiplicity.  Repeated ids are separate rows; a NULL id gives a NULL component unless it
    links with others.  An empty table gives an empty result.
    """
    # single-precision input travels as it is; all products are made in double precision
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = materialize(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast(kind).alias("_v"))
                       .withColumn("_rid", F.monotonically_increasing_id()), "vec-rows")
    good = rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0)
                      & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists("_v", lambda x: x != 0))
    # one class per distinct vector
    classes = materialize(good.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_c")), "vec-classes")
    n = classes.count()
    width, k, tables = hash_plan(n, threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for b in batches:
            c = b.column(0).to_numpy(zero_copy_only=False)
            many = b.column(1).to_numpy(zero_copy_only=False)
            lists = b.column(2).to_pylist()
            for dim in sorted({len(x) for x in lists}):
                pick = [i for i, x in enumerate(lists) if len(x) == dim]
                x = _unit(np.array([lists[i] for i in pick], np.float64))
                if dim not in planes:
                    rng = np.random.default_rng(seed + dim)
                    planes[dim] = rng.standard_normal((dim, k * tables)), rng.random(k * tables) * width
                g, shift = planes[dim]
                cells = np.floor((x @ g + shift) / width).astype(np.int64).reshape(len(pick), tables, k)
                key = np.full((len(pick), tables), dim, np.uint64)
                for j in range(k):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[pick]), pa.array(many[pick]), b.column(2).take(pa.array(pick)),
                    pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))], ["c", "n", "v", "keys"])

    marked = materialize(classes.select("_c", "_n", "_v").mapInArrow(
        hashed, f"c bigint, n bigint, v {classes.schema['_v'].dataType.simpleString()}, keys array<bigint>"), "vec-keys")
    cells = marked.select("c", F.posexplode("keys").alias("t", "key"))
    sizes = cells.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes, "vec-buckets")
    member = cells.join(sizes, ["t", "key"]).withColumn("blocks", F.ceil(F.col("size") / block))
    # block i of a bucket meets every block: group (min, max); one block: group (0, 0)
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    member = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    member = (member.select("c", "t", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
              .join(marked, "c").withColumn("keys", F.slice("keys", 1, F.col("t"))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups (each of at most two blocks of rows), some ten thousand rows at a time."""
        held, size = [], 0

        def last_start(rows: pa.Table) -> int:
            cols = [rows.column(name).to_numpy() for name in ("t", "key", "i", "j")]
            same = np.logical_and.reduce([x == x[-1] for x in cols])
            return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 16_384:
                rows = pa.Table.from_batches(held)
                cut = last_start(rows)  # the last group may go on in the next batch
                if cut:
                    yield from _judge_rows(rows.slice(0, cut).combine_chunks(), threshold)
                held, size = rows.slice(cut).combine_chunks().to_batches(), rows.num_rows - cut
        if size:
            yield from _judge_rows(pa.Table.from_batches(held).combine_chunks(), threshold)

    group = ["t", "key", "i", "j"]
    found = materialize(member.repartition(*group).sortWithinPartitions(*group)
                        .mapInArrow(judge, "c bigint, links bigint, low bigint"), "vec-links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("c").alias("a"), F.col("low").alias("b")))
    # back to rows: copies of one vector link with each other
    by_class = (classes.select("_c", "_n", "_v").join(links, classes["_c"] == links["c"], "left").drop("c")
                .join(comp, classes["_c"] == comp["node"], "left")
                .select("_v", "_c", (F.coalesce("links", F.lit(0)) + F.col("_n") - 1).alias("n_links"),
                        F.coalesce("component", "_c").alias("_comp")))
    joined = materialize(rows.join(by_class, "_v", "left").select("_id", "_rid", "n_links", "_comp"), "vec-joined")
    names = joined.where(F.col("_comp").isNotNull()).groupBy("_comp").agg(F.min("_id").alias("component_id"))
    out = joined.join(names, "_comp", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
