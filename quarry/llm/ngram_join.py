"""N-gram Jaccard join with a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes; two documents link when
``100 * |A & B| >= percent * |A | B|``.  The result is each document's link component.

1. Documents with the same set are one class (copies cost one row each).
2. Each set is written as tokens: its elements are dealt by hash into parts, and the hash of a part's
   content is a token.  Linked sets differ in at most H elements, so with H + 1 + e parts they have
   at least e + 1 parts in common (sizes are cut into bands, and a set near the top of its band also
   joins the next band; empty parts make no token, and e leaves room for them).  From a set's size
   follows how many tokens any link needs; sets that share fewer with all others are left out.
3. Similar classes are partitioned into groups: each class joins the leader it shares most tokens
   with.  Classes are first compared exactly with their leader; linked stars are the group's core.
4. The token-group matrix has a row for each token and group that holds it.  A class asks groups with
   which it shares tokens; from the sizes follows how many tokens a link needs at least, and a group
   whose whole union holds fewer stays closed (as does a group in whose core the class already is).
5. In an open group the class is verified against the members, block by block: overlaps of many
   classes at once are one matrix product, and only reached components leave the task, never pairs.

Nothing is lost: the bounds hold for every linking pair.  Sets travel only for classes that share a
token with another class, filtered first by a bitmap of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WordHashes, connected_components, free_names, materialize, materialize_by_key, mix64, shingle_sets, text_bytes

_BITS = 1 << 23
_SEEDS = 16  # cuts of one set; band and cut fill the last ten bits of a token
_MAX_BANDS = 64


def _max_difference(size: int, percent: int) -> int:
    """Most elements in which two linked sets of at most ``size`` elements can differ."""
    return (100 - percent) * 2 * size // (100 + percent)


@lru_cache(maxsize=None)
def _band(index: int) -> int:
    """Upper size of a band: 1, 2, 3, 4, 6, 9, 13, ... (each half as large again)."""
    top = 1
    for _ in range(index):
        top = max(top + 1, top * 3 // 2)
    return top


def _bands_of(size: int, percent: int) -> list[int]:
    """The band of a set, and further bands in which a linked larger set can lie."""
    index = 0
    while _band(index) < size:
        index += 1
    out = [index]
    while 100 * size >= percent * (_band(out[-1]) + 1):
        out.append(out[-1] + 1)
    return out


@lru_cache(maxsize=None)
def _parts(band: int, percent: int) -> tuple[int, int]:
    """Parts of a band's sets, and how many of them may be empty before a set is cut again."""
    h = _max_difference(_band(band), percent)
    if h == 0:
        return 1, 0
    least = max(1, percent * ((_band(band - 1) if band else 0) + 1) // 100)  # smallest set that joins the band
    spare = math.ceil((h + 1) * 2 * math.exp(-least / (h + 1)))
    return h + 1 + spare, spare


def _tokens(content: np.ndarray, band: int, seed: int) -> np.ndarray:
    low = np.uint64(band * _SEEDS + seed)
    return (mix64(content + low) & np.uint64(0xFFFFFFFFFFFFFC00)) | low


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the non-empty parts of a set, for each band it joins.

    A band has H + 1 + e parts.  Linked sets agree in at least e + 1 parts, so unless both have over
    e empty parts they share a non-empty one; a set with over e empty parts is cut again with
    another seed, and so is its partner.
    """
    out = []
    for band in _bands_of(len(s), percent):
        parts, spare = _parts(band, percent)
        for seed in range(_SEEDS):
            mixed = mix64(s ^ np.uint64((band * _SEEDS + seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            if parts == 1:
                out.append(_tokens(mixed.sum(dtype=np.uint64, keepdims=True), band, seed))
                break
            part = ((mixed >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
            order = np.argsort(part, kind="stable")
            part, body = part[order], mix64(mixed[order] + np.uint64(1))
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total = np.add.reduceat(body, start)
            out.append(_tokens(total + part[start] * np.uint64(0xD1B54A32D192ED03), band, seed))
            if parts - len(start) <= spare:
                break
        else:
            raise ValueError("a set leaves too many parts empty under every seed")
    return np.concatenate(out)


def _class_key(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix64(mix64(s + np.uint64(0x1234567)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def class_of_rows(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Per row: ``_id``, ``_cls`` (NULL for an empty set) and ``_n`` (set size)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = list(shingle_sets(b.column(1).to_pylist(), n, hashes))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([_class_key(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64())], ["_id", "_cls", "_n"])

    src = docs.select(F.col(id_col).alias("_id"), text_bytes(F.col(text_col)).alias("_text"))
    return src.mapInArrow(work, f"_id {src.schema['_id'].dataType.simpleString()}, _cls bigint, _n bigint")


def _shared_parts(docs: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """(sig, cls) of tokens that at least two classes hold."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            sig, cls = [], []
            for s in shingle_sets(b.column(0).to_pylist(), n, hashes):
                if not len(s):
                    continue
                key = _class_key(s)
                if key in seen:  # copies inside one task
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                got = signatures(s, percent)
                sig.append(got)
                cls.append(np.full(len(got), key, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)),
                                                  pa.array(np.concatenate(cls))], ["sig", "cls"])

    rows = docs.select(text_bytes(F.col(text_col)).alias("_text")).mapInArrow(work, "sig bigint, cls bigint")
    w = Window.partitionBy("sig")
    return (rows.withColumn("low", F.min("cls").over(w)).withColumn("high", F.max("cls").over(w))
            .where("low < high").select("sig", "cls").distinct())


def _partner_limit(band, n, percent: int):
    """Largest size of a set that can link with one of size ``n`` by tokens of this band (Column)."""
    top = F.array(*[F.lit(_band(i)).cast("long") for i in range(_MAX_BANDS)])
    return F.least(F.floor(100 * n / percent), F.get(top, band))


def _with_enough(shared: DataFrame, sizes: DataFrame, percent: int, max_rounds: int = 8) -> DataFrame:
    """Rows of ``shared`` that can belong to a link, with ``held`` counted anew.

    Linked sets share at least ``_needed`` tokens of one cut.  A class that has fewer shared tokens of a
    cut links by none of them, so they go; with them other tokens lose their second holder, and so on.
    Every round only leaves out tokens without a link, so the number of rounds bears on the work alone.
    """
    band, n = F.shiftright("cut", 4), F.col("n")
    need = _needed(band, n, _partner_limit(band, n, percent), percent)
    rows = materialize(shared.join(sizes, "cls").select("sig", "cut", "cls", need.alias("need")), "ngram-parts")
    left = rows.count()
    for _ in range(max_rounds):
        few = rows.groupBy("cls", "cut").agg(F.count(F.lit(1)).alias("some"), F.min("need").alias("least")).where("some < least")
        some = rows.join(few.select("cls", "cut"), ["cls", "cut"], "left_anti")
        twice = some.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        rows = materialize(some.join(twice.select("sig"), "sig", "left_semi"), "ngram-parts")
        was, left = left, rows.count()
        if left > 0.9 * was:
            break
    return rows.join(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("held")), "sig").select("sig", "cut", "cls", "held")


def _sets_for(docs: DataFrame, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """(cls, s) for the wanted classes only, bucketed by class; a bitmap of fixed size drops most others before the shuffle."""
    slot = F.col("cls").bitwiseAND(F.lit(_BITS - 1))
    words = (wanted.select(F.shiftright(slot, 5).alias("w"), F.expr("shiftleft(1L, cast(cls & 31 as int))").alias("m"))
             .groupBy("w").agg(F.bit_or("m").alias("m")).toPandas())
    bitmap = np.zeros(_BITS >> 5, np.uint32)
    bitmap[words["w"]] = words["m"].to_numpy(np.int64).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            cls, sets = [], []
            for s in shingle_sets(b.column(0).to_pylist(), n, hashes):
                if not len(s):
                    continue
                c = _class_key(s)
                if c in seen or not int(bitmap[(c & (_BITS - 1)) >> 5]) >> (c & 31) & 1:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                cls.append(c), sets.append(s.view(np.int64))
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "s"])

    rows = docs.select(text_bytes(F.col(text_col)).alias("_text")).mapInArrow(work, "cls bigint, s array<bigint>")
    # the sets move once, into the buckets of the table; every later join on the class finds them there
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cls")
    return materialize_by_key(rows.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "ngram-sets", "cls")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Pairs (a, b) of classes whose sets link.

    ``sets`` is bucketed by class, so both look-ups read it in place.  A right-hand class with over
    ``block`` partners is repeated once for each block of them, so a large family is many tasks' work.
    """
    large = (pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).where("blocks > 1"))
    pairs = pairs.join(large, "b", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = (pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("blocks")))
           .join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a"))
    two = (pairs.select("b", "blocks").distinct()
           .join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
           .select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt")))
    both = one.join(two, ["b", "salt"])
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _needed(band, n_a, n_b, percent: int):
    """Tokens of one band that two linked sets of these sizes share at least (Column)."""
    top = F.array(*[F.lit(_max_difference(_band(i), percent)).cast("long") for i in range(_MAX_BANDS)])
    return F.get(top, band) - F.floor((100 - percent) * (n_a + n_b) / (100 + percent)) + 1


def _links_of(asking: list[np.ndarray], members: list[np.ndarray], percent: int, chunk: int = 8192) -> np.ndarray:
    """Which sets of two lists link: overlaps counted as a product of 0/1 rows over shared elements."""
    na, nb = np.array([len(s) for s in asking]), np.array([len(s) for s in members])
    ea, eb = np.concatenate(asking), np.concatenate(members)
    both = np.intersect1d(ea, eb)
    hits = np.zeros((len(na), len(nb)), np.float32)
    at = [np.searchsorted(both, e) for e in (ea, eb)]
    ok = [(np.minimum(k, len(both) - 1) == k) & (both[np.minimum(k, len(both) - 1)] == e) if len(both) else np.zeros(len(e), bool)
          for k, e in zip(at, (ea, eb))]
    row = [np.repeat(np.arange(len(n)), n) for n in (na, nb)]
    for lo in range(0, len(both), chunk):
        part = []
        for side, size in ((0, len(na)), (1, len(nb))):
            x = np.zeros((size, min(chunk, len(both) - lo)), np.float32)
            use = ok[side] & (at[side] >= lo) & (at[side] < lo + chunk)
            x[row[side][use], at[side][use] - lo] = 1
            part.append(x)
        hits += part[0] @ part[1].T
    i = hits.astype(np.int64)  # under 2^24, so exact
    return 100 * i >= percent * (na[:, None] + nb[None, :] - i)


def _judge_groups(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links between the classes that ask a group and the group's members, as (a, b) rows: each class with
    the smallest class that it reaches inside its block.

    ``asked`` and ``members``: (cls, fam).  A large group is cut into blocks of asking classes and blocks of
    members; each pair of blocks is a task's group of its own, so neither sets nor links of a whole group meet.
    """
    sizes = (asked.groupBy("fam").agg(F.count(F.lit(1)).alias("q"))
             .join(members.groupBy("fam").agg(F.count(F.lit(1)).alias("m")), "fam")
             .select("fam", F.ceil(F.col("q") / block).alias("nq"), F.ceil(F.col("m") / block).alias("nm")))

    def dealt(side: DataFrame, own: str, other: str, role: int) -> DataFrame:
        return (side.join(sizes, "fam").withColumn("role", F.lit(role))
                .withColumn(own, F.pmod(F.xxhash64("cls"), F.col("nq" if role == 0 else "nm")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), (F.col("nm" if role == 0 else "nq") - 1).cast("int"))))
                .select("fam", "i", "j", "role", "cls"))

    rows = dealt(asked, "i", "j", 0).union(dealt(members, "j", "i", 1)).join(sets, "cls")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", kind="stable")
        q, m = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if not (len(q) and len(m)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        one, two = np.nonzero(_links_of(list(q["s"]), list(m["s"]), percent))
        names, back = np.unique(np.concatenate([q["cls"].to_numpy(), m["cls"].to_numpy()]), return_inverse=True)
        low = np.arange(len(names))
        left, right = back[one], back[len(q) + two]
        while True:
            was = low.copy()
            np.minimum.at(low, left, was[right])
            np.minimum.at(low, right, was[left])
            if (low == was).all():
                break
        some = low != np.arange(len(names))
        return pd.DataFrame({"a": names[some], "b": names[low[some]]})

    return rows.groupBy("fam", "i", "j").applyInPandas(judge, "a bigint, b bigint")


def class_components(docs: DataFrame, text_col: str, n: int, percent: int, sizes: DataFrame) -> DataFrame:
    """(node, component) over classes that link with another class.  ``sizes``: cls, n."""
    if not 80 <= percent <= 100:  # below, parts get too small to leave few of them empty
        raise ValueError("percent must be from 80 to 100")
    cut, band = F.col("sig").bitwiseAND(1023).cast("int"), F.shiftright(F.col("cut"), 4)
    shared = materialize(_shared_parts(docs, text_col, n, percent).withColumn("cut", cut), "ngram-parts")
    shared = materialize(_with_enough(shared, sizes, percent), "ngram-parts")
    # the original of a family shares every token with some copy: it scores highest and leads
    wanted = shared.groupBy("cls").agg(F.sum(F.col("held") - 1).alias("score"))
    wanted = materialize(wanted.join(sizes, "cls").select("cls", "n", "score"), "ngram-wanted")
    sets = _sets_for(docs, text_col, n, wanted.select("cls"))

    # groups: each class with the leader it shares most tokens with
    held = shared.join(wanted, "cls")
    lead = held.groupBy("sig").agg(F.max(F.struct("score", "cls")).alias("l"))
    votes = (held.join(lead, "sig").where("cls != l.cls")
             .groupBy(F.col("cls").alias("a"), F.col("l.cls").alias("b")).agg(F.count(F.lit(1)).alias("hits")))
    star = materialize(votes.groupBy("a").agg(F.max_by("b", F.struct("hits", "b")).alias("b")), "ngram-star")
    edges = materialize(_verified(star, sets, percent), "ngram-stars")
    comp = connected_components(edges)
    named = (wanted.join(star, wanted["cls"] == star["a"], "left").join(comp, wanted["cls"] == comp["node"], "left")
             .select("cls", "n", F.coalesce("b", "cls").alias("fam"), F.coalesce("component", "cls").alias("g")))
    named = materialize(named, "ngram-groups")

    # the token-group matrix, and the groups that hold enough of a class's tokens
    tokens = shared.select("sig", "cut", "cls").join(named, "cls")
    matrix = tokens.select("sig", F.col("fam").alias("of")).distinct()
    most = _partner_limit(band, F.col("n"), percent)
    opened = (tokens.join(matrix, "sig").groupBy("cls", "n", "g", "of", "cut").agg(F.count(F.lit(1)).alias("hits"))
              .where(F.col("hits") >= _needed(band, F.col("n"), most, percent))
              .select("cls", "g", F.col("of").alias("fam")).distinct())
    # the leader's component needs no second look: its members link already, the others ask for themselves
    heads = named.select(F.col("cls").alias("fam"), F.col("g").alias("head"))
    asked = materialize(opened.join(heads, "fam").where("g != head").select("cls", "fam"), "ngram-asked")
    members = named.select("cls", "fam").union(named.where("cls != fam").join(
        named.select(F.col("fam").alias("cls")).distinct(), "cls", "left_semi").select("cls", F.col("cls").alias("fam")))
    more = materialize(_judge_groups(asked, members.distinct(), sets, percent), "ngram-opened")
    return comp if more.isEmpty() else connected_components(edges.union(more))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_cls").isNotNull()).groupBy(F.col("_cls").alias("cls")).agg(F.max("_n").alias("n"))


def _row_components(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return (rows.join(comp, rows["_cls"] == comp["node"], "left")
            .withColumn("_comp", F.coalesce("component", "_cls")).drop("node", "component"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                   percent: int = 85) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``.

    Texts with fewer than ``n`` words have their whole word run as one shingle; NULL texts and texts
    without words have an empty set, link with nothing and are their own component.  Repeated rows
    share a class.  NULL ids are skipped as component names (a component of NULL ids only has NULL).
    An empty table gives an empty result.
    """
    rows = materialize(class_of_rows(docs, id_col, text_col, n), "ngram-rows")
    named = materialize(_row_components(rows, class_components(docs, text_col, n, percent, _sizes(rows))), "ngram-named")
    names = named.where(F.col("_comp").isNotNull()).groupBy("_comp").agg(F.min("_id").alias("component_id"))
    return named.join(names, "_comp", "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                     percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with one row of each component kept (smallest id, NULL ids last); all columns.

    Rows with an empty set are all kept.
    """
    cols = docs.columns
    cls_, of_, keep_, text_, at_, row_ = free_names(docs, "__cls", "__of", "__keep", "__text", "__at", "__row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            cls = [_class_key(s) if len(s) else None for s in shingle_sets(b.column(b.num_columns - 1).to_pylist(), n, hashes)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cls, pa.int64())], [*cols, cls_])

    from pyspark.sql.types import LongType, StructType
    schema = StructType([*docs.schema.fields]).add(cls_, LongType())
    rows = materialize(class_of_rows(docs, id_col, text_col, n).where(F.col("_cls").isNotNull()), "ngram-rows")
    named = _row_components(rows, class_components(docs, text_col, n, percent, _sizes(rows)))
    first = F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("id"), F.col("_cls").alias("cls")))
    keep = materialize(named.groupBy("_comp").agg(first.alias("k"))
                       .select(F.col("k.cls").alias(of_), F.col("k.id").alias(keep_)), "ngram-keep")
    # rows without a set meet nothing: a hash of their id spreads them over the join
    marked = (docs.withColumn(text_, text_bytes(F.col(text_col))).mapInArrow(work, schema)
              .withColumn(at_, F.coalesce(cls_, F.xxhash64(id_col))))
    kept = (marked.join(keep, (marked[at_] == keep[of_]) & marked[id_col].eqNullSafe(keep[keep_]), "left")
            .where(F.col(cls_).isNull() | F.col(of_).isNotNull()))
    if not rows.groupBy("_id", "_cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # repeated rows: one of each, and every row without a set
        kept = (kept.withColumn(row_, F.when(F.col(cls_).isNull(), F.monotonically_increasing_id()))
                .dropDuplicates([cls_, row_]))
    return kept.select(*cols)
