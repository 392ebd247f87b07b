"""Fill-in-middle: texts cut into prefix, middle and suffix at unit ends and put in another order.

A unit is a line with its newline; a last line without one counts too.  Each text is seen as blocks of
fixed size in bytes; a Fenwick tree over the blocks holds how many units end and how many code points
start in them.  A cut behind unit ``k`` is found by a binary-lifting descent to its block, and then by
counting inside that block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_bytes

SENTINELS = ("<P>", "<S>", "<M>")
NEWLINE = 10
_OUT_BYTES = 8 << 20  # output texts are handed over in batches of about this size


class BlockTree:
    """Fenwick tree over the fixed blocks of one UTF-8 text: units ended and code points started in each."""

    def __init__(self, text: bytes, block: int):
        self.block = block
        self.bytes = np.frombuffer(text, np.uint8)
        starts = np.arange(0, len(text), block)
        self.blocks = len(starts)
        self.tree = np.zeros((self.blocks + 1, 2), np.int64)
        if not self.blocks:
            self.units = 0
            return
        self.tree[1:, 0] = np.add.reduceat(self.bytes == NEWLINE, starts, dtype=np.int64)
        self.tree[1:, 1] = np.add.reduceat((self.bytes & 0xC0) != 0x80, starts, dtype=np.int64)
        if self.bytes[-1] != NEWLINE:
            self.tree[-1, 0] += 1  # the last line ends with the text
        self.units = int(self.tree[1:, 0].sum())
        for i in range(1, self.blocks + 1):
            up = i + (i & -i)
            if up <= self.blocks:
                self.tree[up] += self.tree[i]

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k == 0:
            return 0, 0
        at, units, chars = 0, 0, 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            to = at + step
            if to <= self.blocks and units + self.tree[to, 0] < k:
                at, units, chars = to, units + int(self.tree[to, 0]), chars + int(self.tree[to, 1])
            step >>= 1
        here = self.bytes[at * self.block:(at + 1) * self.block]
        ends = np.flatnonzero(here == NEWLINE)
        left = k - units
        size = int(ends[left - 1]) + 1 if left <= len(ends) else len(here)
        return at * self.block + size, chars + int(np.count_nonzero((here[:size] & 0xC0) != 0x80))


def arrange(text: bytes, draws: tuple[int, int, int, int], fim_rate: int, spm_rate: int,
            sentinels: tuple[bytes, bytes, bytes], block: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    tree = BlockTree(text, block)
    h1, h2, h3, h4 = draws
    if not text or h3 % 100 >= fim_rate or any(s in text for s in sentinels):
        return tree.units, "plain", None, None, text
    a, b = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (a_byte, a_char), (b_byte, b_char) = tree.cut(a), tree.cut(b)
    p, s, m = sentinels
    prefix, middle, suffix = text[:a_byte], text[a_byte:b_byte], text[b_byte:]
    if h4 % 100 < spm_rate:
        return tree.units, "spm", a_char, b_char - a_char, b"".join((s, suffix, p, prefix, m, middle))
    return tree.units, "psm", a_char, b_char - a_char, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_rate: int = 100,
                   spm_rate: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS,
                   block: int = 4096) -> DataFrame:
    """id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, one row per input row.

    Draws come from sha256 of ``seed:id``, so reruns agree and repeated rows come out alike.  Of 100
    texts ``fim_rate`` are rearranged, ``spm_rate`` of these with the suffix first.  A text that is
    empty, NULL (taken as empty) or holds a sentinel stays plain: its output is the text, its lengths
    are NULL.  A NULL id is hashed as empty decimal.  Other columns of ``docs`` are left out, whatever
    their names; an empty table gives an empty result.  Texts of any length are read whole.
    """
    marks = tuple(s.encode() for s in sentinels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            rows, size, first = [], 0, 0
            for i, (seeded, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                draws = tuple(int(seeded[k:k + 8], 16) for k in (0, 8, 16, 24))
                rows.append(arrange(text.as_py(), draws, fim_rate, spm_rate, marks, block))
                size += len(rows[-1][4])
                if size >= _OUT_BYTES or i + 1 == b.num_rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *cols], names)
                    rows, size, first = [], 0, i + 1

    decimal = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.sha2(F.concat(F.lit(f"{seed}:"), decimal).cast("binary"), 256).alias("seeded"),
                      text_bytes(F.col(text_col)).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(work, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars",
                      F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made from."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def sides(first: str, second: str) -> tuple[Column, Column]:
        return (F.substr(F.substring_index(head, second, 1), F.lit(len(first) + 1)), F.substring_index(head, second, -1))

    psm, spm = sides(p, s), sides(s, p)
    return (F.when(form == "psm", F.concat(psm[0], middle, psm[1]))
            .when(form == "spm", F.concat(spm[1], middle, spm[0])).otherwise(output))


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hashes of the outputs and of the texts rebuilt from them, in place of the outputs."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                      sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
