"""Licence notices: exact seeds find candidates, bounded-error matching verifies them.

A text is lower-cased (A-Z) and cut into words (runs of digits, letters and non-ASCII characters),
joined by single spaces.  A notice that may hold ``k`` edits is cut into ``k + 1`` pieces: by the
pigeonhole principle one piece stays exact in any match, so one Aho-Corasick pass over all pieces
proposes every candidate place.  The ``regex`` library then matches the whole notice with at most
``k`` errors in a window around the seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# phrases whose exact places are always reported, with their labels (fixed values)
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
                ("cc by nc", "cc-by-nc"))

# short notices: words, label, allowed edits
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("gnu general public license version 3", "gpl-3", 1),
    ("gnu general public license version 2", "gpl-2", 1),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2 0", "mpl-2", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1),
    ("all rights reserved", "proprietary", 1),
)

# bytes outside the word class become spaces, A-Z is lower-cased, bytes over 0x7F stay
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=BASE_PHRASES):
        import ahocorasick
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in notices]
        self.phrases = [(f" {p} ", label) for p, label in phrases]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(notices):
            for at, piece in pieces(n, k):
                seeds.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.auto.add_word(piece, (len(piece), uses))
        self.auto.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, int, float, str]]]:
        """Word count; base places (label, first word, last word); fuzzy spans
        (label, first word, last word, edits, score, text)."""
        words = words_of(text)
        if not words:
            return 0, [], []
        norm = " " + b" ".join(words).decode("utf-8", "replace") + " "
        word_at = lambda pos: norm.count(" ", 0, pos + 1) - 1
        base = []
        for phrase, label in self.phrases:
            at = norm.find(phrase)
            while at >= 0:
                first = word_at(at)
                base.append((label, first, first + phrase.count(" ") - 2))
                at = norm.find(phrase, at + 1)
        spans, windows = set(), {}
        for end, (length, uses) in self.auto.iter(norm):
            for i, at in uses:
                n, _, k = self.notices[i]
                lo = max(0, end - length + 1 - at - k)
                hi = min(len(norm), lo + len(n) + 2 * k + 1)
                # overlapping windows of one notice are searched as one
                runs = windows.setdefault(i, [])
                if runs and lo <= runs[-1][1]:
                    runs[-1] = (min(lo, runs[-1][0]), max(hi, runs[-1][1]))
                else:
                    runs.append((lo, hi))
        for i, runs in windows.items():
            n, label, k = self.notices[i]
            for lo, hi in runs:
                for m in self.patterns[i].finditer(norm, lo, hi):
                    edits = sum(m.fuzzy_counts)
                    spans.add((label, word_at(m.start() - (norm[m.start()] != " ")),
                               word_at(m.end() - 1 - (norm[m.end() - 1] == " ")), edits,
                               round(1 - edits / (2 * k + 1), 3), m[0].strip()))
        # of notices that match the same words, the one with the fewest edits (then the longer one)
        kept: list[tuple] = []
        for s in sorted(spans, key=lambda s: (s[3], s[1] - s[2], s[1], s[0])):
            if all(s[2] < k[1] or k[2] < s[1] for k in kept):
                kept.append(s)
        return len(words), base, sorted(kept, key=lambda s: (s[1], s[2], s[0]))


_PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64()),
                   ("score", pa.float64()), ("value", pa.string())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  notices=NOTICES, phrases=BASE_PHRASES) -> DataFrame:
    """One row per input row: id, ``n_words``, ``base`` places and fuzzy ``spans`` (word positions from 0).

    NULL and empty texts have no words and empty lists; repeated rows are scanned each; other
    columns are ignored; an empty table gives an empty result.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for b in batches:
            res = [scanner.scan(t or b"") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([r[0] for r in res], pa.int64()),
                pa.array([[dict(zip(("label", "first", "last"), x)) for x in r[1]] for r in res], pa.list_(_PLACE)),
                pa.array([[dict(zip(("label", "first", "last", "edits", "score", "value"), x)) for x in r[2]]
                          for r in res], pa.list_(_SPAN))], ["id", "n_words", "base", "spans"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(work, f"id {id_type}, n_words bigint, base array<struct<label:string,first:bigint,last:bigint>>, "
                               "spans array<struct<label:string,first:bigint,last:bigint,edits:bigint,score:double,value:string>>")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query."""
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(
        *[F.transform(c, lambda x: x["label"]) for c in cols]))), ",")
    starts = F.transform("base", lambda x: x["first"])
    return found.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "spans").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))).alias("score"))
