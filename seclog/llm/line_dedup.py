"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Hashes of three consecutive lines are counted over the whole corpus. Of a repeated window the
first occurrence stays; the lines under every later one go, overlapping windows merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.functions.text import evaluated_once
from seclog.llm.common import digest128, rows_again, whole_row

LINES = 3


def window_keys(lines: Column, size: int) -> Column:
    """Two 64-bit hashes of every ``size`` consecutive lines, with the place of the first."""
    def key(start):
        parts = [F.get(lines, start + j) for j in range(size)]
        return F.struct(
            start.alias("at"), F.xxhash64(F.lit(1), *parts).alias("h1"),
            F.xxhash64(F.lit(2), *parts).alias("h2"),
        )

    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), key)


def split_once(text: str) -> Column:
    """The lines of a text, through a generator: else every use of a line would split it again."""
    return evaluated_once(F.split(text, "\n", -1))


def later_windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``doc_id, d1, d2, starts``: the windows of a text that stand earlier in the corpus.

    A text is named by its id and the two digests of its text; of equal windows that with the least
    (id, digests, place) is the first, NULL ids before others. Rows equal in id and text are
    one document here.
    """
    d1, d2 = digest128(F.col("text"))
    named = docs.where(F.col("text").contains("\n")).select(
        "doc_id", d1.alias("d1"), d2.alias("d2"), split_once("text").alias("lines"))
    windows = named.select("doc_id", "d1", "d2", F.inline(window_keys(F.col("lines"), size)))
    place = F.struct("doc_id", "d1", "d2", "at")
    first = windows.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.max(place).alias("last"),
    ).where(F.col("first") != F.col("last"))
    later = windows.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "d1", "d2").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``row`` (the document, with what is left of its text) and ``n_lines, n_removed``.

    Lines are what stands between \\n characters; equal lines are equal code points. Texts with
    fewer lines than a window, empty and NULL ones stay as they are (NULL has 0 lines). Rows
    equal in id and text get equal results. A text all of whose lines go is empty.
    """
    d1, d2 = digest128(F.col("text"))
    given = docs.select(
        whole_row(docs).alias("row"), F.col("doc_id").alias("id"), d1.alias("e1"), d2.alias("e2"),
    )
    later = later_windows(docs, size)
    same = (F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("e1") == F.col("d1"))
            & (F.col("e2") == F.col("d2")))
    joined = given.join(later, same, "left")
    lines = F.col("lines")
    covered = F.array_distinct(F.flatten(F.transform(
        "starts", lambda s: F.sequence(s, s + (size - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "covered")  # in order
    left = F.array_join(F.transform(kept, lambda n: F.get(lines, n)), "\n")
    return joined.select("row", covered.alias("covered"), split_once("row.text").alias("lines")).select(
        F.col("row").withField(
            "text", F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(left)).alias("row"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeated_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """The documents, all columns in their order, without lines that repeated windows cover.

    A document that loses lines and has nothing but white space left was a copy: it goes. Documents that
    lose no line all stay, those without text too.
    """
    found = dedup_lines(docs, size)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("row.text").rlike(r"\S"), F.lit(False))
    return rows_again(found.where(~emptied))
