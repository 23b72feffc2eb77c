"""Repeated passages of three lines, in DataFrame operations only.

Every three consecutive lines of a text are a window, and a text of one or two
lines is a window of its own (unless ``short`` is off).  Windows are hashed (two
64-bit hashes), the first of each is the one with the least (doc_id, row,
position), and all later ones are removed: the positions they cover are merged
into stretches, and a text keeps the lines between them.

The first occurrence is a grouped minimum, combined before the shuffle; later
ones are found by joining the windows with the repeated hashes only.  Both are
written tables, so a window that fills a third of the corpus is split by the
skew-join rule.  Texts are written once with a number for each row, and shuffled
once by it, to meet their stretches.

Defined cases: a null text stays null and an empty one empty; windows of blank
lines are left alone.  A short text meets whole short texts only, and a later
copy of one becomes empty.  A line ends at each newline; a carriage return
belongs to its line; very long texts are read whole.  In a run of equal lines
the first stays.  Rows without doc_id come first in the order; rows that share a
doc_id, repeated rows too, follow each other as they stand in the table.  An
empty table stays empty.  Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, materialize, quoted, release

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, short: bool) -> DataFrame:
    """``(doc_id, row, at, span, h1, h2)``: one row for each window of ``span`` lines."""

    def found(at: Column, span: Column, parts: list[Column]) -> Column:
        blank = F.concat(*parts).rlike(r"\A\s*\z")
        return F.when(~blank, F.struct(at.alias("at"), span.alias("span"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(9), *parts).alias("h2")))

    def threes(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - WINDOW), lambda i: found(i, F.lit(WINDOW), [F.element_at(x, i + k) for k in range(1, WINDOW + 1)]))

    # The one-element array binds the lines once for all windows.
    windows = F.transform(F.array(_lines(F.col("text"))), lambda x: F.when(F.size(x) < WINDOW, F.array(found(F.lit(0), F.size(x), [F.col("text")]))).otherwise(threes(x)))[0]
    some = docs.where(F.col("text").isNotNull() if short else F.col("text").isNotNull() & (F.size(_lines(F.col("text"))) >= WINDOW))
    return some.select("doc_id", "row", F.explode(windows).alias("w")).where("w is not null").select("doc_id", "row", "w.*")


def repeated_stretches(docs: DataFrame, short: bool = True) -> DataFrame:
    """``(row, stretches)`` of ``docs(row, doc_id, text)``: the merged positions of later occurrences, ends included; a written table."""
    windows = materialize(_windows(docs, short), "windows")
    place = F.struct("doc_id", "row", "at")
    seen = windows.groupBy("span", "h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("span", "h1", "h2", "first")
    repeated = materialize(seen, "repeated")
    later = windows.join(repeated, ["span", "h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("row", "at", "span")
    own = Window.partitionBy("row")
    gap = F.col("at") > F.lag("at").over(own.orderBy("at")) + WINDOW
    runs = later.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(own.orderBy("at")))
    merged = runs.groupBy("row", "run").agg(F.min("at").alias("start"), (F.max(F.col("at") + F.col("span")) - 1).alias("end"))
    out = materialize(merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("stretches")), "stretches")
    release(windows)
    release(repeated)
    return out


def dedup_lines(docs: DataFrame, name: str = "lines", short: bool = True) -> DataFrame:
    """``docs`` with shortened texts and a struct column ``name``: n_lines, n_removed, stretches.

    Without ``short``, texts of fewer than three lines are left alone.
    """
    own_row, mark_row, own_cut = (free_name(docs, n) for n in ("own_row", "mark_row", "mark_cut"))
    rows = materialize(docs.withColumn(own_row, F.monotonically_increasing_id()), "rows")
    marks = repeated_stretches(rows.select("doc_id", "text", F.col(quoted(own_row)).alias("row")), short)
    marks = marks.select(F.col("row").alias(mark_row), F.col("stretches").alias(own_cut))
    # The merge hint keeps the plan the same at every size: a broadcast would only hold for small corpora.
    met = rows.hint("merge").join(marks, F.col(own_row) == F.col(mark_row), "left")
    lines, cut = _lines(F.col("text")), F.col(own_cut)

    def between(x: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.element_at(cut, k)["end"] + 1)
        stop = F.when(k == F.size(cut), F.size(x)).otherwise(F.get(cut, k)["start"])
        return F.slice(x, start + 1, F.greatest(stop - start, F.lit(0)))

    kept = F.transform(F.array(lines), lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: between(x, k))), "\n"))[0]
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda acc, s: acc + s["end"] - s["start"] + 1), F.lit(0))
    info = F.struct(F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), cut.alias("stretches"))
    text = F.when(cut.isNull(), F.col("text")).otherwise(kept)
    return met.select(*[text.alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns], info.alias(name))
