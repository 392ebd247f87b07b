"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

# ASCII white space, the same class as [\x20\x09-\x0D]; bytes.split() uses it too
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


# batch limits as Spark ships them, and the smaller ones for tasks that share an executor's memory
_BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
                 "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of 4 MB and 2,000 rows, unless the session has limits of its own.

    A batch is held several times over (Arrow buffers of the JVM and of the worker, Python values), in each
    of an executor's tasks.  A longer text is a batch of its own.  Results do not depend on it.
    """
    for key, (shipped, small) in _BATCH_LIMITS.items():
        if spark.conf.get(key) == shipped:
            spark.conf.set(key, small)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage the way ``checkpoint()`` does, but columnar: later reads
    prune columns, and a lost executor costs a re-read, not a re-computation.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/quarry-llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, as an external table bucketed and sorted by ``key``: joins on it need no shuffle of ``df``.

    There are as many buckets as shuffle partitions; the table's files lie in the shared checkpoint folder.
    ``df`` should come partitioned by ``key`` into as many partitions, so that each bucket is one file.
    """
    spark = df.sparkSession
    label = f"{name}-{uuid.uuid4().hex[:12]}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-llm/{label}"
    table = f"quarry_llm_{label.replace('-', '_')}"
    (df.write.format("parquet").option("path", path)
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------- hash bitmaps

_MOST_BITS = 27  # a bitmap never takes more than 16 MB, so it may be broadcast


class HashBitmap:
    """Bits of the 64-bit hashes of some rows: finds candidates for an exact join among many more rows.

    Built by Spark's bitmap aggregate and broadcast as rows of 4 KB; its size has a fixed bound.  A row
    whose hash is in the set is always found; with very many hashes the bits fill up and more other rows
    pass, which the exact join behind it leaves out.
    """

    def __init__(self, hashes: DataFrame, col: str, name: str):
        n = hashes.count()
        self.empty = n == 0
        self.mask = (1 << min(_MOST_BITS, max(15, (32 * n).bit_length()))) - 1
        at = F.col(col).bitwiseAND(F.lit(self.mask))
        self.rows = materialize(hashes.groupBy(F.shiftright(at, 15).alias("block"))
                                .agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits")), name)

    def mark(self, df: DataFrame, hashed: Column, name: str) -> DataFrame:
        """``df`` with a boolean: whether the row's hash may be in the set."""
        if self.empty:
            return df.withColumn(name, F.lit(False))
        at, block, bits = free_names(df, "at", "block", "bits")
        rows = self.rows.select(F.col("block").alias(block), F.col("bits").alias(bits))
        out = df.withColumn(at, hashed.bitwiseAND(F.lit(self.mask)))
        out = out.join(F.broadcast(rows), F.shiftright(at, 15) == F.col(block), "left")
        place = F.col(at).bitwiseAND(32767)
        byte = F.conv(F.hex(F.substr(F.col(bits), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        return out.withColumn(name, F.coalesce(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop(at, block, bits)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (NULL id: NULL)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_bytes(text: Column) -> Column:
    """Text as UTF-8 bytes for Arrow; NULL becomes empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


class WordHashes(dict):
    """64-bit hash of each word, remembered; emptied when it holds too many words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: list[bytes], n: int, hashes: WordHashes, chunk: int = 200_000) -> Iterator[np.ndarray]:
    """Per text the distinct sorted hashes of all runs of ``n`` words (A-Z lower-cased).

    Fewer words: the whole run as one; no words: empty.  Runs are hashed for many texts at once.
    """
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append(text.lower().split())
        size += len(held[-1])
        if size >= chunk:
            yield from _shingles(held, n, hashes)
            held, size = [], 0
    yield from _shingles(held, n, hashes)


def _shingles(held: list[list[bytes]], n: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    lens = [len(w) for w in held]
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(held)), np.uint64, sum(lens))
    runs = _run_hash(h, n)
    at = 0
    for size in lens:
        if size >= n:
            s = np.sort(runs[at:at + size - n + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield _run_hash(h[at:at + size], size) if size else h[:0]
        at += size


def _run_hash(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return h[:0]
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return out


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The ``k``-th largest non-NULL value, exactly, by narrowing histograms (no sort, no gathering)."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    above = 0  # values over hi
    while lo < hi:
        step = (hi - lo) / bins
        cell: Column = F.least(F.floor((F.col(key) - lo) / step).cast("int"), F.lit(bins - 1)) if step > 0 else F.lit(0)
        hist = (df.where(F.col(key).between(lo, hi)).groupBy(cell.alias("c"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
                .orderBy(F.desc("c")).collect())
        for r in hist:
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
        if len(hist) == 1 and step <= 0:
            break
    return hi


# --------------------------------------------------------------------------- connected components

def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest reachable node for each node of an undirected edge list.

    ``edges``: columns ``a``, ``b`` of one ordered type.  Returns ``node``, ``component`` for every
    node that has an edge (self loops and repeated edges allowed, NULL ends dropped; an empty
    list gives an empty result).

    Alternates large-star and small-star steps: each is a grouped minimum plus a join, so a hub
    with very many neighbours is aggregated map-side and its join is a plain skewed join that
    adaptive execution can split; no adjacency list is ever gathered.  Every round is written to
    the shared checkpoint folder.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    cur = both.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialize(cur, "cc")
    sig = _signature(cur)
    for _ in range(max_rounds):
        if sig[0] == 0:
            break
        sym = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (sym.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        nxt = materialize(small, "cc")
        new = _signature(nxt)
        if new == sig:
            break
        cur, sig = nxt, new
    else:
        raise RuntimeError("connected components did not settle")
    # a star forest: every non-root has exactly one edge, to its root
    roots = cur.select(F.col("b").alias("node")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
