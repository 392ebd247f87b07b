"""Target-distribution importance resampling: array-scored weights, bisected cut-off, ranks by range partitions.

Runs of one to three words are hashed (CRC-32) into buckets.  The CRC of a run is combined from the CRCs
of its words by table look-ups over whole arrays, as CRC is linear: appending L bytes is one linear map.
Integer gains per bucket compare the target's shares with the corpus's; a document's weight is the sum
over its runs, and hashed Gumbel noise on top makes the largest scores a sample.  The cut-off is found by
exact count jobs over the persisted scores, and only drawn rows are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_bytes
from quarry.operators.windows import global_row_number

POLY = 0xEDB88320  # reflected CRC-32 polynomial
# bytes outside [0-9A-Za-z] and below 0x80 separate words; A-Z become a-z
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_PIECE = 1 << 20  # bytes of a text split into words at a time
_CHUNK = 200_000  # words hashed at a time


def _byte_maps() -> list[np.ndarray]:
    """Tables of the maps that append 1, 2, 4, ... bytes; each is 4 x 256 (byte of the CRC, its value)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLY), crc >> 1).astype(np.uint32)
    places = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [(places >> np.uint32(8)) ^ crc[places & 0xFF]]
    while len(out) < 40:
        out.append(_apply(out[-1], out[-1]))
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][crc >> 8 & 0xFF] ^ table[2][crc >> 16 & 0xFF] ^ table[3][crc >> 24]


class Shift:
    """CRC after appending some number of zero bytes, for arrays of CRCs and lengths."""

    def __init__(self):
        self.powers = _byte_maps()
        self.identity = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        self.short = {}

    def _table(self, length: int) -> np.ndarray:
        if length in self.short:
            return self.short[length]
        table = self.identity
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                table = _apply(self.powers[bit], table)
        if length < 256:
            self.short[length] = table
        return table

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(lengths, return_inverse=True)
        flat = np.concatenate([self._table(int(n)).ravel() for n in kinds]) if len(kinds) else np.zeros(0, np.uint32)
        base = which * 1024
        return (flat[base + (crc & 0xFF)] ^ flat[base + 256 + (crc >> 8 & 0xFF)]
                ^ flat[base + 512 + (crc >> 16 & 0xFF)] ^ flat[base + 768 + (crc >> 24)])


class WordCodes(dict):
    """length << 32 | CRC-32 of a word, remembered for words of ordinary length; emptied when full."""

    LIMIT, LONG = 500_000, 64

    def __missing__(self, word: bytes) -> int:
        code = len(word) << 32 | zlib.crc32(word)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = code
        return code


def run_buckets(texts: Iterator[bytes], buckets: int, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (text number, bucket) of all runs, with the text number of each word of the chunk.

    Long texts come in several chunks; a run is told by its last word and counted once.
    """
    shift, codes = Shift(), WordCodes()
    held, owner, size, ahead = [], [], 0, 0
    for number, text in enumerate(texts):
        text, at = text.translate(_TO_WORDS), 0
        while at < len(text):
            end = text.find(b" ", at + _PIECE)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            at = end
            held.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
            owner.append(np.full(len(words), number))
            size += len(words)
            if size >= _CHUNK:
                code, who = np.concatenate(held), np.concatenate(owner)
                yield _runs(code, who, ahead, shift, buckets, longest)
                ahead = min(longest - 1, len(code))  # words kept as context for the next chunk
                held, owner, size = [code[len(code) - ahead:]], [who[len(who) - ahead:]], ahead
    if size > ahead:
        yield _runs(np.concatenate(held), np.concatenate(owner), ahead, shift, buckets, longest)


def _runs(code: np.ndarray, who: np.ndarray, ahead: int, shift: Shift, buckets: int,
          longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    crc, length = (code & 0xFFFFFFFF).astype(np.uint32), code >> 32
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = shift(space, length) ^ crc
    run, whose, found = crc, [who[ahead:]], [crc[ahead:]]
    for width in range(2, longest + 1):  # run[i] ends at word i + width - 1
        run = shift(run[:-1], length[width - 1:] + 1) ^ spaced[width - 1:]
        ends = np.arange(width - 1, len(code))
        ok = (who[ends] == who[ends - width + 1]) & (ends >= ahead)
        whose.append(who[ends[ok]])
        found.append(run[ok])
    return np.concatenate(whose), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), who[ahead:]


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Runs in each bucket over all texts: at most ``buckets`` sums leave a task or reach the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, found, _ in run_buckets((t.as_py() for t in b.column(0)), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = (docs.select(text_bytes(F.col(text_col)).alias("text")).mapInArrow(work, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed raw share)) of each bucket."""
    size, t_all, r_all = len(raw), float(target.sum() + len(raw)), float(raw.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * r_all / ((r + 1.0) * t_all)))
                     for t, r in zip(target.tolist(), raw.tolist())], np.int64).reshape(size)


def score_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                    longest: int = 3, seed: int = 42) -> DataFrame:
    """id, ``n_words``, ``n_features``, ``weight`` and ``score``, one row per input row (NULL text: no words)."""
    buckets = len(gains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for whose, found, owners in run_buckets((t.as_py() for t in b.column(1)), buckets, longest):
                words += np.bincount(owners, minlength=b.num_rows)
                features += np.bincount(whose, minlength=b.num_rows)
                # sums of whole numbers far below 2**53 are exact in doubles
                weight += np.bincount(whose, gains[found], minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))],
                                             ["id", "n_words", "n_features", "weight"])

    src = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(work, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    unit = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(unit)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def bisect_counts(reaches: Callable[[list[int]], list[bool]], low: int, high: int, fan: int = 16) -> int:
    """Largest value in ``low .. high`` that reaches; ``low`` does, and what reaches falls off once.

    Each call of ``reaches`` is one exact count job over up to ``fan`` cuts.
    """
    while low < high:
        step = max(1, -(-(high - low) // fan))
        cuts = list(range(low + step, high, step)) + [high]
        got = reaches(cuts)
        for cut, ok in zip(cuts, got):
            if not ok:
                high = cut - 1
                break
            low = cut
    return low


def draw(scored: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """Adds ``rank`` to the ``floor(share * N)`` largest scores of the N rows with ``min_words`` words; NULL elsewhere.

    Ties go to the smaller id (a whole number; NULL last), rows alike in both are ranked in any order.
    The cut-off is bisected on counts over the persisted scores, then, among scores equal to it, on
    ids.  Only rows at or over the cut-off are range-partitioned for their ranks; the order is total, so
    many rows of one id spread as well.
    """
    scored = materialize(scored.withColumn("_at", F.monotonically_increasing_id()), "resample")
    keep = [c for c in scored.columns if c != "_at"]
    able = scored.where(F.col("n_words") >= min_words)
    n, low, high = able.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    k = share[0] * n // share[1]
    if k == 0:
        return scored.select(*keep, F.lit(None).cast("bigint").alias("rank"))

    def counts(rows: DataFrame, tests: list) -> list[int]:
        return list(rows.agg(*[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests)]).first())

    cut = bisect_counts(lambda cs: [c >= k for c in counts(able, [F.col("score") >= F.lit(c) for c in cs])], low, high)
    over = able.where(F.col("score") > F.lit(cut)).count()
    tied = able.where(F.col("score") == F.lit(cut))
    named, least, most = tied.agg(F.count(id_col), F.min(id_col), F.max(id_col)).first()
    inside = F.lit(True)
    if named > k - over:
        # the smallest id that gives enough ties, as the largest negative one
        last = -bisect_counts(lambda cs: [c >= k - over for c in counts(tied, [F.col(id_col) <= F.lit(-c) for c in cs])], -most, -least)
        inside = F.coalesce(F.col(id_col) <= F.lit(last), F.lit(False))
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > F.lit(cut)) | ((F.col("score") == F.lit(cut)) & inside))
    ranked = global_row_number(scored.where(drawn), [F.desc("score"), F.asc_nulls_last(id_col), F.asc("_at")], "_rank")
    rank = F.when(F.col("_rank") <= k, F.col("_rank")).cast("bigint")  # more rows than that only if ids repeat or are NULL
    return (ranked.select(*keep, rank.alias("rank"))
            .unionByName(scored.where(~drawn).select(*keep, F.lit(None).cast("bigint").alias("rank"))))


def resample_to_target(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       buckets: int = 10_000, longest: int = 3, share: tuple[int, int] = (5, 100),
                       min_words: int = 20, seed: int = 42) -> DataFrame:
    """Documents drawn towards the word runs of ``target``: id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    One row per input row; ``rank`` is 1, 2, 3, ... for drawn rows and NULL for others.  Whole texts
    are read; NULL and empty texts have no runs, weight 0 and are never drawn (under ``min_words``).
    Repeated rows score alike.  Other columns of both tables are left out, whatever their names.  An
    empty ``target`` is smoothed to equal shares; an empty ``docs`` gives an empty result.
    """
    raw, wanted = (bucket_counts(t, text_col, buckets, longest) for t in (docs, target))
    return draw(score_documents(docs, bucket_gains(wanted, raw), id_col, text_col, longest, seed), share, min_words, id_col)
