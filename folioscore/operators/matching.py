"""Joins by names: candidates with transcriptions, files with manifests, data with images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_groundtruth(candidates: DataFrame, groundtruth: DataFrame) -> DataFrame:
    """candidates (path, stem) with gt_path: the first, by path, of the groundtruth (gt_path, gt_name) whose name starts with the stem; null if none.

    A prefix join as an equi-join: every groundtruth name meets the candidates
    under each of its prefixes that is as long as some stem, so both sides are
    hashed and nothing is compared with everything.
    """
    lengths = candidates.select(F.length("stem").alias("n")).distinct()
    names = groundtruth.where(F.col("gt_name").endswith(".gt.xml") | F.col("gt_name").endswith("gt.txt") | F.col("gt_name").endswith(".xml"))
    prefixes = names.join(F.broadcast(lengths), F.col("n") <= F.length("gt_name")).select(F.col("gt_name").substr(F.lit(1), F.col("n")).alias("stem"), "gt_path")
    first = prefixes.groupBy("stem").agg(F.min("gt_path").alias("gt_path"))
    return candidates.join(first, "stem", "left")


def without_groundtruth(candidates: DataFrame, groundtruth: DataFrame) -> DataFrame:
    return match_groundtruth(candidates, groundtruth).where("gt_path is null").drop("gt_path")


def match_images(data: DataFrame, images: DataFrame) -> DataFrame:
    """data (data_name) with the images (image_name) whose name up to the first dot it contains, and how many there are; more than one is an error to the caller.

    Containment as an equi-join: every part of a data name that is as long as
    some image stem is looked up, so nothing is compared with everything.
    """
    known = images.where(F.col("image_name").rlike(r"(?i)\.(jpg|jpeg|tif|tiff|png)$")).select("image_name", F.split_part("image_name", F.lit("."), F.lit(1)).alias("image_stem")).where("image_stem <> ''")
    lengths = known.select(F.length("image_stem").alias("n")).distinct()
    starts = F.explode(F.sequence(F.lit(1), F.length("data_name")))
    pieces = data.select("data_name", starts.alias("at")).join(F.broadcast(lengths), F.col("at") + F.col("n") - 1 <= F.length("data_name"))
    parts = pieces.select("data_name", F.col("data_name").substr(F.col("at"), F.col("n")).alias("image_stem")).distinct()
    return parts.join(known, "image_stem").groupBy("data_name").agg(F.min("image_name").alias("image_name"), F.countDistinct("image_name").alias("n_images"))
