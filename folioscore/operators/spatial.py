"""Spatial filters over the flat form of pages: words in a frame, emptied parents, boxes from below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def words_with_place(words: DataFrame, frames: DataFrame) -> DataFrame:
    """words (page_id, ..., polygon) with `inside`: whether the centroid lies strictly in the page's frame (page_id, frame).

    Pages without a frame keep all their words; a word without a polygon is an error of the page, `inside` null.
    """
    # The centre as a column of its own, before the join: found once, and the polygon needn't be moved for it.
    joined = words.withColumn("__centre", geometry.centroid(F.col("polygon"))).join(frames.select("page_id", "frame"), "page_id", "left")
    return joined.withColumn("inside", F.when(F.col("frame").isNull(), True).otherwise(geometry.inside_box(F.col("__centre"), F.col("frame")))).drop("__centre")


def filter_words(words: DataFrame, frames: DataFrame) -> DataFrame:
    return words_with_place(words, frames).where("inside").drop("inside", "frame")


def cascade(parents: DataFrame, parent_key: str, children_before: DataFrame, children_after: DataFrame) -> DataFrame:
    """parents without those that had children and lost all of them; parents that never had any stay."""
    had = children_before.select(parent_key).distinct()
    have = children_after.select(parent_key).distinct()
    lost = had.join(have, parent_key, "left_anti")
    return parents.join(lost, parent_key, "left_anti")


def boxes_from_children(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., box): the box of all corners of a parent's children."""
    corner = words.select(*key, F.explode("polygon").alias("p"))
    return corner.groupBy(*key).agg(F.struct(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1")).alias("box"))


def filter_report(placed: DataFrame, tag: str) -> DataFrame:
    """(tag, removed, kept) from words with `inside`."""
    return placed.groupBy(tag).agg(F.count_if(~F.col("inside")).alias("removed"), F.count_if("inside").alias("kept"))
