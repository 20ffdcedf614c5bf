"""The evaluation from documents to report: match, crop, transcribe, score, key, aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, names
from ..sources import nodes as tree
from . import aggregate, dimensions, matching, metrics


def require(entries: DataFrame, folder: str | None = None) -> DataFrame:
    """entries; RuntimeError if there are none, or if the folder that they are from isn't one."""
    spark = entries.sparkSession
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            raise RuntimeError(f"no directory: {folder}")
    if entries.isEmpty():
        raise RuntimeError("missing evaluation data")
    return entries


def listing(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """(path, content) of the files below a folder; the content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def by_path(df: DataFrame) -> DataFrame:
    return df.orderBy("path")


def entries(candidates: DataFrame, groundtruth: DataFrame, root: Column) -> tuple[DataFrame, DataFrame]:
    """((path, gt_path, root, gt_type) of candidates (path) with groundtruth (path), the paths of those without)."""
    name = names.base_name(F.col("path"))
    own = candidates.select("path", names.stem(name).alias("stem"))
    known = groundtruth.select(F.col("path").alias("gt_path"), name.alias("gt_name"))
    matched = matching.match_groundtruth(own, known)
    there = matched.where("gt_path is not null").select("path", "gt_path", root.alias("root"), names.groundtruth_type(names.base_name(F.col("gt_path"))).alias("gt_type"))
    return there, matched.where("gt_path is null").select("path")


def page_texts(nodes_: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(path, text, removed): the transcription of every page in reading order, without the words whose centre is outside of the frame (path, frame).

    Lines and regions that lose all words go; a line without text counts as an
    empty one between its neighbours.  Pages with an error give no row.
    """
    good = nodes_.where("error is null")
    words = good.where(F.col("level") == tree.WORD)
    if frames is not None:
        placed = words.join(frames.select("path", "frame"), "path", "left").withColumn("centre", geometry.centroid(F.col("polygon")))
        words = placed.withColumn("inside", F.col("frame").isNull() | F.coalesce(geometry.inside_box(F.col("centre"), F.col("frame")), F.lit(False)))
    else:
        words = words.withColumn("inside", F.lit(True))
    line = words.groupBy("path", F.slice("ord", 1, 2).alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("ord", "text")))), lambda w: w["text"]), " ").alias("words"), F.count_if(~F.col("inside")).alias("removed"), F.count_if("inside").alias("kept"))
    own = good.where(F.col("level").isin(tree.LINE, tree.REGION, 4) & F.col("text").isNotNull()).select("path", "ord", "text")
    parts = own.withColumns({"removed": F.lit(0).cast("bigint"), "kept": F.lit(1).cast("bigint")}).unionByName(line.select("path", "ord", F.col("words").alias("text"), "removed", "kept"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept") > 0, F.struct("ord", "text")))), lambda x: x["text"]), " ")
    texts = parts.groupBy("path").agg(joined.alias("text"), F.sum("removed").alias("removed"))
    empty = good.where(F.col("level") == tree.PAGE).select("path")
    return empty.join(texts, "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("removed", F.lit(0)).alias("removed"))


def scores(matched: DataFrame, candidates: DataFrame, groundtruth: DataFrame, keys: list[str], ignore_geometry: bool = False, form: str = "NFC") -> DataFrame:
    """matched with reference, candidate and a column for every metric; the frame comes from the groundtruth, pages with an error drop out.

    Every document is parsed once, and nothing but its text and frame leaves the parser.
    """
    # Not to be asked twice, once for the filter and once for the value.
    truth, own = (f.asNondeterministic() for f in (tree.read_groundtruth, tree.read_candidate))
    read = groundtruth.select(F.col("path").alias("gt_path"), truth(F.col("path"), F.col("content")).alias("read")).where("read.text is not null")
    frame = F.lit(None).cast("struct<x0: int, y0: int, x1: int, y1: int>")
    if not ignore_geometry:
        named = geometry.frame_from_name(names.base_name(F.col("gt_path")))
        read = read.where(named.isNotNull() | F.col("read.error").isNull())
        frame = F.coalesce(named, "read.frame")
    known = read.select("gt_path", F.col("read.text").alias("reference"), frame.alias("__frame"))
    # The contents' bytes size the partitions only if they are shuffled; next to a broadcast table, few tasks would parse them all.
    both = matched.join(known, "gt_path").join(candidates.select("path", F.col("content").alias("__content")).hint("merge"), "path")
    found = both.withColumn("__read", own(F.col("path"), F.col("__content"), F.col("__frame"))).where("__read.text is not null")
    pairs = found.select("gt_path", "path", *[c for c in matched.columns if c not in ("gt_path", "path")], F.col("__read.text").alias("candidate"), F.col("__read.removed").alias("removed"), "reference")
    return metrics.score(pairs, keys, form=form)


def keyed(scored: DataFrame, labels: list[str], specs: str | None, manifest: DataFrame | None = None) -> DataFrame:
    """(key, value, n_ref) of scored entries by a spec of dimensions, or by every directory where there is none."""
    if specs is None:
        flat = metrics.long_form(scored, labels, ["path", "root"])
        keys = dimensions.default_keys(F.col("metric"), names.domains(F.col("path"), F.col("root")))
    else:
        found, hierarchical = dimensions.parse(specs, manifest is not None)
        if "tags" not in scored.columns:
            scored = scored.withColumn("tags", F.lit(None).cast("map<string,string>"))
        with_dims, columns = dimensions.columns(scored, found, manifest)
        named = [(name, F.col(f"__d{k}"), many) for k, (name, _, many) in enumerate(columns)]
        with_dims = with_dims.withColumns({f"__d{k}": c for k, (_, c, _) in enumerate(columns)})
        flat = metrics.long_form(with_dims, labels, [f"__d{k}" for k in range(len(columns))])
        keys = aggregate.dimension_keys(F.col("metric"), named, hierarchical)
    return flat.select(F.explode(keys).alias("key"), "value", "n_ref")


def candidate_lines(scored: DataFrame, labels: list[str]) -> DataFrame:
    """(path, line) of every entry: its label, type and metrics, the second and the fourth with how they differ from the one before."""
    name = names.base_name(F.col("path"))
    both = F.contains(name, F.lit("+")) & F.contains(name, F.lit("_"))
    label = F.when(both, F.concat(F.replace(F.split_part(name, F.lit("_"), F.lit(1)), F.lit("+"), F.lit(":")), F.lit("_"), F.split_part(name, F.lit("_"), F.lit(2)))).otherwise(name)
    kind = F.when(F.col("gt_type").isNotNull() & (F.col("gt_type") != names.UNSET), F.concat(F.lit("("), F.substring("gt_type", 1, 3), F.lit(")"))).otherwise("")
    parts = []
    for k, m in enumerate(labels):
        value, size = F.col(m)["value"], F.col(m)["n_ref"]
        refs = F.when(size > 10_000, F.format_string("%2dK+", F.floor(size / 1000))).otherwise(F.format_string("%4d", size))
        part = F.concat(F.lit(f"{m}:"), F.format_string("%5.2f", value), F.lit("("), refs, F.lit(")"))
        if k in (1, 3):
            gap = value - F.col(labels[k - 1])["value"]
            part = F.concat(part, F.when(gap > 0, F.format_string("(+%5.2f)", gap)).otherwise(F.format_string("(-%5.2f)", F.abs(gap))))
        parts.append(part)
    line = F.concat(F.lit("["), F.replace(label, F.lit(".xml"), F.lit("")), F.lit("]"), kind, F.lit(" ["), F.concat_ws(", ", *parts), F.lit("]"))
    return scored.select("path", line.alias("line"))


def report_lines(cleaned: DataFrame) -> DataFrame:
    """(key, part, line): the printed form of `aggregate.cleaned_statistics`, part 1 for what is left without outliers."""
    plain = F.format_string("%s\t%3d items %d refs\tmean:%5.2f", "key", "n_total", "n_ref", "mean")
    more = F.when(F.col("n_total") > 1, F.format_string(" M:%5.2f std:%5.2f", "median", "std")).otherwise("")
    first = cleaned.select("key", F.lit(0).alias("part"), F.concat(plain, more).alias("line"))
    dropped = F.format_string("%s(-%d)\t%3d items %d refs\tmean:%5.2f M:%5.2f std:%5.2f", F.col("key"), F.col("n_total") - F.col("n_cleaned"), F.col("n_cleaned"), F.col("n_ref_cleaned"), F.col("mean_cleaned"), F.col("median_cleaned"), F.col("std_cleaned"))
    return first.unionByName(cleaned.where("n_cleaned > 0").select("key", F.lit(1).alias("part"), dropped.alias("line"))).orderBy("key", "part")
