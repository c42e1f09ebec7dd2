"""Line deduplication over overlapping three-line windows.

Every run of three consecutive non-blank lines of a text is a window; a text
with one or two non-blank lines is one window. So that a passage written on one
or two long lines is seen too, a line of more than LONG_WORDS words is a window
of its own, and else two lines that hold more together. Windows are compared over the
whole table by a 128-bit hash. Of each repeated window the first occurrence, by
document id and then position, stays; the lines that any later occurrence
covers go. Blank lines are in no window and stay while a line of the text
remains.

Defined results: a null text stays null; an empty or blank text is unchanged; a
text all of whose lines go becomes empty. Null ids come last in the order. Rows
that agree in id and text are the same document and get the same result; rows
with one id and different texts are ordered by the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import let, stored, text_key

WINDOW_LINES = 3
LONG_WORDS = 50


def _windows(lines: Column) -> Column:
    """``array<struct<at array<int>, a long, b long>>``: the windows of a text."""
    def window(rows: Column) -> Column:
        words = rows["l"]
        return F.struct(rows["i"].alias("at"), F.xxhash64(words).alias("a"),
                        F.xxhash64(F.lit(1), words).alias("b"))

    def windows(full: Column) -> Column:
        n = F.size(full)

        def at(s: Column) -> Column:
            one, two = F.get(full, s - 1)["w"], F.get(full, s)["w"]
            long = F.when(one > LONG_WORDS, 1).when(one + two > LONG_WORDS, 2)
            return F.array(F.when(s <= F.greatest(n - (WINDOW_LINES - 1), F.lit(1)), window(F.slice(full, s, WINDOW_LINES))),
                           F.when(long.isNotNull(), window(F.slice(full, s, long))))

        return F.when(n > 0, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), n), at))))

    numbered = F.transform(lines, lambda l, i: F.struct(
        i.alias("i"), l.alias("l"), F.regexp_count(l, F.lit("[^ ]+")).alias("w")))
    return let(F.filter(numbered, lambda x: F.trim(x["l"]) != ""), windows)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return (docs.filter(text.isNotNull())
            .select(F.col(id_col).alias("id"), text_key(text).alias("k"),
                    F.explode(_windows(F.split(text, "\n"))).alias("w"))
            .select(F.struct(F.col("id").isNull().alias("no_id"), "id", "k").alias("row"),
                    F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.at").alias("at"),
                    F.element_at("w.at", 1).alias("start")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (id and text key) and ``gone``: the sorted positions of lines to remove."""
    seen = _occurrences(docs, id_col, text_col)
    # Count and first place per window combine map-side, so a window that a third
    # of all documents share costs one row per task.
    repeated = stored(
        seen.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start")).alias("first"))
        .filter("n > 1").select("a", "b", "first"), "line-windows")
    # Both sides are plain shuffles: adaptive execution splits a hot window.
    return (seen.join(repeated, ["a", "b"])
            .filter(F.struct("row", "start") != F.col("first"))
            .groupBy("row").agg(F.collect_set("at").alias("at"))
            .select("row", F.array_sort(F.array_distinct(F.flatten("at"))).alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with later repeats cut from the text.

    Adds ``n_lines`` and ``n_removed`` (both null for a null text); input columns
    of these names are replaced.
    """
    gone = removed_lines(docs, id_col, text_col).select(
        F.col("row.id").alias("gone_id"), F.col("row.k").alias("gone_k"), "gone")
    # The input columns travel by number, whatever they are called.
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in (text_col, "n_lines", "n_removed")}
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(id_col).alias("id"),
                       F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("k"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("k") == F.col("gone_k")), "left")
    text, lines = F.col("text"), F.split("text", "\n")
    kept = let(lines, lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(ls)), F.transform("gone", lambda i: i + 1)),
        lambda i: F.element_at(ls, i)))
    cut = let(kept, lambda ls: F.when(F.exists(ls, lambda l: F.trim(l) != ""), F.array_join(ls, "\n")).otherwise(""))
    new = F.when(F.col("gone").isNull(), text).otherwise(cut)
    return joined.select(
        *[(new if c == text_col else F.col(own[c])).alias(c) for c in docs.columns if c in own or c == text_col],
        F.when(text.isNotNull(), F.size(lines)).cast("long").alias("n_lines"),
        F.when(text.isNotNull(), F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias("n_removed"))
