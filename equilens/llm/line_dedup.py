"""Line deduplication over overlapping windows of three consecutive lines, all in Spark SQL functions.

Every window of three lines is hashed to 128 bits.  A window found more than once keeps its
first occurrence, by document id and position; the lines that later occurrences cover are
removed, overlapping windows merged.  The first occurrence of any line is never covered, so
no line is lost from the corpus.

With ``long_words`` windows of one and two lines take part too where they hold more words than
that, in texts of any number of lines: a long passage that repeats as one or two lines goes as
well.  Without it repeats of one or two lines, and texts under three lines, stay as they are.

Occurrences of one window are counted with map-side combining and joined back by hash, so a
passage that a third of the documents share is one row of the counted side.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import fresh, n_words

SPAN = 3
LONG_WORDS = 50          # a passage of more words is long


def _windows(docs: DataFrame, text: str, doc_id: str, long_words: int | None) -> DataFrame:
    """``(id, text_key, pos, span, h1, h2)`` of every window of lines that takes part."""
    lines = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("lines"))
    spans = [SPAN]
    if long_words is None:
        lines = lines.where(F.size("lines") >= SPAN)
    else:
        spans = list(range(1, SPAN + 1))
        lines = lines.withColumn("counts", F.transform("lines", n_words))

    def windows_of(span: int) -> Column:
        def part(i: Column) -> list[Column]:
            return [F.get("lines", i + k) for k in range(span)]

        def takes_part(i: Column) -> Column:
            if span == SPAN:
                return F.concat(*part(i)).rlike(r"[^\x20\x09-\x0D]")
            return reduce(add, [F.get("counts", i + k) for k in range(span)]) > long_words

        def window(i: Column) -> Column:
            return F.struct(i.alias("pos"), F.lit(span).alias("span"), F.xxhash64(*part(i)).alias("h1"),
                            F.xxhash64(F.lit(span), *reversed(part(i))).alias("h2"))

        at = F.when(F.size("lines") >= span, F.sequence(F.lit(0), F.size("lines") - span)) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(at, takes_part), window)

    return lines.select("id", "text_key", F.explode(F.concat(*map(windows_of, spans))).alias("w")) \
        .select("id", "text_key", "w.*")


def covered_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", long_words: int | None = None) -> DataFrame:
    """``(id, text_key, removed)``: the 0-based lines that later occurrences cover, sorted.

    Only documents that lose lines have a row.
    """
    windows = _windows(docs, text, doc_id, long_words)
    place = F.struct("id", "text_key", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")) \
        .where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("id", "text_key").agg(F.collect_set(F.struct("pos", "span")).alias("starts"))
    spans = F.flatten(F.transform("starts", lambda s: F.sequence(s["pos"], s["pos"] + s["span"] - 1)))
    return starts.select("id", "text_key", F.array_sort(F.array_distinct(spans)).alias("removed"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                removed_lines: str | None = None, long_words: int | None = None) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``; every row stays.

    ``removed_lines`` names an added column with the 0-based lines removed.  With ``long_words``
    passages of one or two lines with more words than that are removed too.  Null and empty
    texts, other texts under three lines and windows of blank lines are left alone; a document
    whose lines are all covered has the empty text.  Null ids come first.  Rows that repeat
    an id and text count as one document and all change alike.
    """
    gone, ident, key = fresh(docs, "gone", "gone_id", "gone_key")
    cover = covered_lines(docs, text, doc_id, long_words).select(F.col("id").alias(ident), F.col("text_key").alias(key),
                                                     F.col("removed").alias(gone))
    joined = docs.join(cover, docs[doc_id].eqNullSafe(cover[ident]) & (F.xxhash64(docs[text]) == cover[key])
                       & docs[text].isNotNull(), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if removed_lines:
        out.append(F.coalesce(F.col(gone), F.array().cast("array<int>")).alias(removed_lines))
    return joined.select(*out)
