"""Line de-duplication: overlapping three-line windows, first occurrence kept.

Every run of three consecutive lines is hashed.  A window that occurs more than once in the corpus
is kept at its first place (smallest document id, then position) and covered lines of every later
place are removed; overlapping windows are merged into runs first.  Built from DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import HashBitmap, free_names, materialize

SPAN = 3
SENTENCE_END = r"(?<=\n)|(?<=[.!?\u2026][ \t])|(?<=[\u3002\uff01\uff1f])"
LONG_UNIT = 100    # characters from which a unit is cut further
WORDS_A_CUT = 4    # one word in so many ends a piece of a long unit
MAX_WORDS = 16     # a longer piece (one word over and over) is cut into blocks of so many
BLANK = " \t\r\n"


def _later_runs(windows: DataFrame, name: str) -> DataFrame:
    """Sorted ``runs`` (s, e) of the windows (``_id``, ``_th``, ``_i``, ``_h1``, ``_h2``) that are not the first of their hash."""
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_th").alias("th"),
                     F.col("_i").alias("i"))
    # one hash a window is counted first (map-side, so a window in a third of all documents is a few partial
    # rows); only windows that may repeat travel with their places
    often = materialize(windows.groupBy("_h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h1"), f"{name}-often")
    windows = materialize(HashBitmap(often, "_h1", f"{name}-bits").mark(windows, F.col("_h1"), "_may").where("_may").drop("_may"),
                          f"{name}-again")
    firsts = materialize(windows.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
                         .where(F.col("_first") != F.col("_last")).drop("_last"), name)
    later = (windows.join(firsts, ["_h1", "_h2"]).where(place != F.col("_first"))
             .select("_id", "_th", "_i").distinct())
    # merge: a start within the lines that earlier starts cover (or next to them) stays in the run
    w = Window.partitionBy("_id", "_th").orderBy("_i")
    fresh = F.when(F.col("_i") > F.lag("_i").over(w) + SPAN, 1).otherwise(0)
    runs = (later.withColumn("_new", fresh)
            .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("_id", "_th", "_run").agg(F.min("_i").alias("s"), (F.max("_i") + SPAN - 1).alias("e")))
    return runs.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """``_id``, ``_th`` (hash of the text) and sorted ``runs`` (s, e: lines from 0, inclusive) to remove."""
    lines = F.split(F.col("_text"), "\n")
    src = (docs.where(F.col(text_col).isNotNull() & F.col(text_col).contains("\n"))
           .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    numbered = (src.select("_id", F.xxhash64("_text").alias("_th"), lines.alias("_l"))
                .where(F.size("_l") >= SPAN)
                .select("_id", "_th", F.posexplode(F.transform(
                    F.sequence(F.lit(0), F.size("_l") - SPAN),
                    lambda i: F.struct(*[F.get("_l", i + k).alias(f"l{k}") for k in range(SPAN)])))))
    cells = [F.col(f"col.l{k}") for k in range(SPAN)]
    windows = (numbered.where(sum((F.length(c) for c in cells), F.lit(0)) >= min_chars)
               .select("_id", "_th", F.col("pos").alias("_i"),
                       F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit(7), *reversed(cells)).alias("_h2")))
    return _later_runs(windows, "lines-first")


def _with_runs(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text may have ``runs`` to cut, shuffled to them (or NULL), and all other rows as they are."""
    th, may, other, other_th = free_names(docs, "__th", "__may", "__id", "__rth")
    bits = HashBitmap(runs.select(F.xxhash64("_id", "_th").alias("h")), "h", "runs-bits")
    marked = bits.mark(docs.withColumn(th, F.xxhash64(text_col)), F.xxhash64(id_col, th), may)
    right = runs.select(F.col("_id").alias(other), F.col("_th").alias(other_th), F.col("runs").alias(name))
    some = marked.where(F.col(may)).join(right.hint("shuffle_merge"), F.col(id_col).eqNullSafe(F.col(other)) & (F.col(th) == F.col(other_th)), "left")
    return some.select(*docs.columns, name), marked.where(~F.col(may)).select(*docs.columns)


def _all_rows(some: DataFrame, rest: DataFrame, name: str) -> DataFrame:
    return some.unionByName(rest.withColumn(name, F.lit(None).cast(some.schema[name].dataType)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with repeated runs cut out of the text, plus the counts of its lines and of those removed.

    Lines end at a newline.  Documents under three lines, and windows of under ``min_chars``
    characters, repeat nothing.  Rows of equal id and text count as one document and get equal
    results; a NULL id comes after all others.  NULL texts stay NULL with 0 lines; a text that
    loses all lines becomes empty.  An empty table gives an empty result.  Columns of the input
    named like ``lines_col`` or ``removed_col`` are replaced.
    """
    docs = docs.drop(lines_col, removed_col)
    runs_, lines_ = free_names(docs, "__runs", "__lines")
    found = materialize(repeated_runs(docs, id_col, text_col, min_chars), "lines-runs")
    both = _all_rows(*_with_runs(docs, found, id_col, text_col, runs_), runs_)
    lines = F.split(F.col(text_col), "\n")
    n = F.size(lines)
    # the stretches between runs: from the end of one to the start of the next
    stretch = lambda i: F.slice(
        F.col(lines_),
        F.when(i == 0, 0).otherwise(F.get(F.col(runs_), i - 1)["e"] + 1) + 1,
        F.coalesce(F.get(F.col(runs_), i)["s"], F.size(lines_))
        - F.when(i == 0, 0).otherwise(F.get(F.col(runs_), i - 1)["e"] + 1))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs_)), stretch))
    gone = F.aggregate(runs_, F.lit(0), lambda a, r: a + r["e"] - r["s"] + 1)
    out = (both.withColumn(lines_col, F.when(F.col(text_col).isNull(), 0).otherwise(n))
           .withColumn(lines_, F.when(F.col(runs_).isNotNull(), lines))
           .withColumn(removed_col, F.coalesce(gone, F.lit(0)))
           .withColumn(text_col, F.when(F.col(runs_).isNull(), F.col(text_col))
                       .otherwise(F.array_join(kept, "\n"))))
    return out.select(*docs.columns, lines_col, removed_col)


# --------------------------------------------------------------------------- passages

def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _pieces(unit: Column) -> Column:
    """A long unit cut behind words picked by their hash, so equal passages are cut at equal places."""
    def cut(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: (k == F.size(words)) | (
            F.pmod(F.xxhash64(F.trim(F.element_at(words, k), F.lit(BLANK))), F.lit(WORDS_A_CUT)) == 0))
        begin = lambda e, j: F.when(j == 0, 1).otherwise(F.get(e, j - 1) + 1)
        return _let(ends, lambda e: F.flatten(F.transform(e, lambda k, j: F.transform(
            F.sequence(begin(e, j), k, F.lit(MAX_WORDS)),
            lambda b: F.array_join(F.slice(words, b, F.least(k - b + 1, F.lit(MAX_WORDS))), "")))))
    return _let(F.split(unit, r"(?<=\s)(?=\S)"), cut)


def text_units(text: Column) -> Column:
    """The text as an array of units with their separators; joined without a separator they are the text."""
    return F.flatten(F.transform(F.split(text, SENTENCE_END), lambda u: F.when(
        F.length(u) > LONG_UNIT, _pieces(u)).otherwise(F.array(u))))


def repeated_unit_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``repeated_runs`` over the units of each text, whatever their length.

    Blanks around a unit do not count.  A text of under three units is one window.
    """
    text = F.col(text_col)
    units = materialize(
        docs.where(text.isNotNull() & (text != ""))
        .select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"),
                F.transform(text_units(text), lambda u: F.xxhash64(F.trim(u, F.lit(BLANK)))).alias("_u")), "passages-units")
    cells = [F.col(f"col.u{k}") for k in range(SPAN)]
    windows = (units.select("_id", "_th", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_u") - SPAN, F.lit(0))),
        lambda i: F.struct(*[F.get("_u", i + k).alias(f"u{k}") for k in range(SPAN)]))))
        .select("_id", "_th", F.col("pos").alias("_i"),
                F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit(7), *reversed(cells)).alias("_h2")))
    return _later_runs(windows, "passages-first")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                   min_passage: int = 120, units_col: str | None = "n_units",
                   removed_col: str = "n_removed", keep_emptied: bool = True) -> DataFrame:
    """``docs`` with repeated runs of units cut out of the text, plus the counts of units and of those removed.

    A run goes if it has ``min_chars`` characters and three whole lines, or ``min_passage`` characters.
    Everything else is as in ``dedup_lines``; what is left of a text keeps its own blanks and newlines,
    but for a newline before a run that ended the text.  With ``units_col=None`` units are not counted.
    With ``keep_emptied=False`` a row whose text loses all its units is left out (rows of NULL and empty
    texts lose nothing and stay).
    """
    docs = docs.drop(removed_col, *([units_col] if units_col else []))
    runs_, units_, cut_ = free_names(docs, "__runs", "__units", "__cut")
    some, rest = _with_runs(docs, materialize(repeated_unit_runs(docs, id_col, text_col), "passages-runs"), id_col, text_col, runs_)
    part = lambda s, e: F.array_join(F.slice(F.col(units_), s + 1, e - s), "")
    size = F.size(units_)

    def goes(r: Column) -> Column:
        run, ends = part(r["s"], r["e"] + 1), r["e"] + 1 >= size
        inside = (r["s"] > 0) & ~F.get(F.col(units_), r["s"] - 1).endswith("\n")  # begins within a line
        lines = F.size(F.split(run, "\n")) - inside.cast("int") - (~ends).cast("int")  # a last piece is empty or cut
        return (F.length(run) >= min_passage) | ((F.length(run) >= min_chars) & (lines >= SPAN))

    last = F.element_at(runs_, -1)["e"] + 1 >= size
    # the stretches between runs: from the end of one to the start of the next
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col(runs_), i - 1)["e"] + 1)
    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs_)), lambda i: part(
        F.least(begin(i), size), F.coalesce(F.get(F.col(runs_), i)["s"], F.greatest(size, begin(i))))), "")
    gone = F.aggregate(runs_, F.lit(0), lambda a, r: a + F.least(r["e"] + 1, size) - r["s"])
    cut, n_units = F.col(cut_), [units_col] if units_col else []

    def counted(df: DataFrame) -> DataFrame:
        return df.withColumn(units_col, F.when(F.col(text_col).isNull(), 0).otherwise(size)) if units_col else df

    some = (some.withColumn(units_, text_units(F.col(text_col)))
            .withColumn(runs_, F.filter(runs_, goes))
            .withColumn(cut_, F.coalesce(F.size(runs_) > 0, F.lit(False)))
            .withColumn(removed_col, F.when(cut, gone).otherwise(0)))
    emptied = cut & (F.col(removed_col) >= size)
    some = counted(some).withColumn(text_col, F.when(~cut, F.col(text_col)).when(last, F.regexp_replace(kept, r"\n\z", "")).otherwise(kept))
    if not keep_emptied:
        # written first: a filter over these columns would be pushed below them, units computed again at each mention
        (empty_,) = free_names(some, "__emptied")
        some = materialize(some.withColumn(empty_, emptied).select(*docs.columns, *n_units, removed_col, empty_), "passages-cut")
        some = some.where(~F.col(empty_))
    rest = counted(rest.withColumn(units_, text_units(F.col(text_col)))).withColumn(removed_col, F.lit(0))
    columns = [*docs.columns, *n_units, removed_col]
    return some.select(*columns).unionByName(rest.select(*columns))
