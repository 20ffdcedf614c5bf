"""Words to lines, lines to regions and pages, in their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_strings(strings: DataFrame, line: str = "line_id") -> DataFrame:
    """Words (line, word_no, id, text) of rows (line, pos, is_space, id, text).

    In lines with a space element, strings without one between them are one
    word, with the first one's id; in lines without, every string is a word.
    Blank strings are dropped. Islands are numbered by a running count of
    spaces over the line, one window and one aggregation on the same key.
    """
    by_line = Window.partitionBy(line)
    running = by_line.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = strings.withColumn("spaced", F.max("is_space").over(by_line)).withColumn("gap", F.sum(F.col("is_space").cast("int")).over(running))
    words = marked.where(~F.col("is_space") & (F.trim("text") != "")).withColumn("word_no", F.when(F.col("spaced"), F.col("gap")).otherwise(F.col("pos")))
    first = F.min_by("id", "pos")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "")
    return words.groupBy(line, "word_no").agg(first.alias("id"), whole.alias("text"))


def transcription(rows: DataFrame, key: str, order: str, text: str = "text", separator: str = " ") -> DataFrame:
    """(key, text): the texts of a parent's children joined in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda s: s["t"]), separator)
    return rows.groupBy(key).agg(joined.alias("text"))


def reading_order(regions: DataFrame, order: DataFrame, page: str = "page_id") -> DataFrame:
    """regions (page, region_id, dom_pos) with rank 1..n: by the index of (page, region_id, index), the unlisted last in their own order."""
    listed = regions.join(order, [page, "region_id"], "left")
    w = Window.partitionBy(page).orderBy(F.col("index").asc_nulls_last(), "dom_pos")
    return listed.withColumn("rank", F.row_number().over(w).cast("bigint"))


def words_by_centre(words: Column) -> Column:
    """Words (cx, pos, text) of a line from left to right by their whole-numbered centre."""
    return F.transform(F.array_sort(F.transform(words, lambda w: F.struct(w["cx"].cast("int").alias("c"), w["pos"].alias("p"), F.trim(w["text"]).alias("t")))), lambda s: s["t"])


def long_enough(lines: DataFrame, least: int, text: str = "text") -> DataFrame:
    return lines.where(F.length(F.trim(text)) >= least)
