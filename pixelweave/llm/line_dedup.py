"""Line deduplication over windows of three lines, with DataFrame functions only.

A text's overlapping windows of ``window`` lines are hashed to 128 bits. Per
hash the first place (smallest document id, then line) and the count are
aggregated, with map-side combining, so a window that a third of all documents
share costs a row per task. Windows at later places cover their lines; the
covered positions are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import blank, limited, materialize


def line_windows(docs: DataFrame, window: int, id_col: str, text: str) -> DataFrame:
    """``(id, mark, at, h1, h2)`` for each window that holds a word; ``mark`` tells texts of one id apart."""
    lines = F.split(blank(F.col(text)), "\n", -1)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(blank(F.col(text))).alias("mark"), lines.alias("lines")).filter(F.size("lines") >= window)
    places = F.sequence(F.lit(1), F.size("lines") - (window - 1))
    each = own.select("id", "mark", F.posexplode(F.transform(places, lambda i: F.array_join(F.slice("lines", i, F.lit(window)), "\n"))).alias("at", "w"))
    return each.filter(F.col("w").rlike(r"[^\x20\x09-\x0D]")).select("id", "mark", "at", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"))


def later_places(docs: DataFrame, window: int, id_col: str, text: str) -> DataFrame:
    """``(id, mark, starts)``: where a document repeats a window that stands at an earlier place."""
    windows = line_windows(docs, window, id_col, text)
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "at")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = windows.join(repeated.select("h1", "h2", "first"), ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("id", "mark").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines`` and ``n_removed``, and the text without its repeated windows.

    Of equal windows anywhere in the table the one with the smallest id, then
    the smallest line number, stays; the lines that any other one covers go.
    Null ids come first. A null text stays null (one line, none removed), a
    text of fewer lines than a window is left alone, and so are windows
    without a word. Rows that share their id and text are one place and are
    treated alike. A very long text is one row like any other. An empty table
    gives an empty table; columns named like the two new ones are replaced, any
    other name may be in use.
    """
    later = limited(materialize(later_places(docs, window, id_col, text).withColumnsRenamed({"id": "of", "mark": "of_mark"}), "later-lines"), 500_000, "1 + size(starts)")
    kept = docs.drop("n_lines", "n_removed")
    own = kept.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(blank(F.col(text))).alias("mark"))
    joined = own.join(later, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    whole = F.col("row").getField(text)
    lines = F.split(blank(whole), "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    shorter = F.transform(F.array(lines), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))[0]
    columns = [F.when(F.col("starts").isNull(), whole).otherwise(shorter).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept.columns]
    return joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"))
