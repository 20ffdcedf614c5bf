"""The mini-language of dimensions, compiled to columns of the entries before anything runs.

Entries have path, root, gt_path, gt_type and tags (a map).  ``a,b`` are
dimensions of their own, ``a+b`` also form a joined key.  Each is one of

* ``directory`` or ``directory:all``, ``directory:N``: all directories, or the N-th below the root (-1: the nearest);
* ``type``; ``metadata:KEY``; ``pattern:REGEX`` or ``pattern:REGEX:GROUP`` of the file's name;
* ``mods:DIMENSION`` or ``mods:.//PATH``, with ``:decade`` or ``:century`` after it; ``mets:ATTRIBUTE`` of the linked division.

The separators also cut a regular expression that holds them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources import manifests
from . import mets

TRANSFORMS = {"decade": names.decade, "century": names.century}
KINDS = ("directory", "type", "metadata", "pattern", "mods", "mets")


@dataclass(frozen=True)
class Dimension:
    name: str
    kind: str
    argument: str | int | None = None
    more: str | int | None = None


def parse_dimension(spec: str, manifest: bool = True) -> Dimension:
    """One dimension; ValueError says what is wrong with it."""
    kind, colon, rest = (s.strip() for s in spec.partition(":"))
    if kind not in KINDS:
        raise ValueError(f"unknown extractor {kind!r} in {spec!r}: one of {', '.join(KINDS)}")
    if kind == "directory":
        if not colon or rest == "all":
            return Dimension("directory", kind)
        if not re.fullmatch(r"[+-]?\d+", rest):
            raise ValueError(f"no directory level: {spec!r}")
        return Dimension(f"directory_{int(rest)}", kind, int(rest))
    if kind == "type":
        return Dimension("type", kind)
    if not colon:
        raise ValueError(f"{kind} needs an argument: {spec!r}")
    if kind == "metadata":
        return Dimension(f"metadata_{rest}", kind, rest)
    if kind == "pattern":
        pattern, _, group = (s.strip() for s in rest.partition(":"))
        if group and not group.isdigit():
            raise ValueError(f"no group number: {spec!r}")
        try:
            groups = re.compile(pattern).groups
        except re.error as e:
            raise ValueError(f"no regular expression: {spec!r}: {e}") from e
        if int(group or 1) > groups:
            raise ValueError(f"no group {group or 1} in {spec!r}")
        return Dimension("pattern", kind, pattern, int(group or 1))
    if not manifest:
        raise ValueError(f"{kind} needs a manifest: {spec!r}")
    if kind == "mets":
        return Dimension(f"mets_div_{rest.lower()}", kind, rest.upper())
    custom = rest.startswith(".//")
    # In a path, only a known transform after the last colon is one; prefixes have colons too.
    dimension, _, how = (s.strip() for s in (rest.rpartition(":") if custom and rest.rpartition(":")[2] in TRANSFORMS else (rest, "", "") if custom else rest.partition(":")))
    if how and how not in TRANSFORMS:
        raise ValueError(f"unknown transform {how!r} in {spec!r}: one of {', '.join(TRANSFORMS)}")
    manifests.mods_path(dimension)
    return Dimension("_".join(x for x in ("mods", "custom" if custom else dimension, how) if x), kind, dimension, how or None)


def parse(specs: str, manifest: bool = True, strict: bool = True) -> tuple[list[Dimension], bool]:
    """(dimensions, hierarchical); with `strict` any bad one is an error, else it is left out, and none at all is an error."""
    hierarchical = "+" in specs
    found, wrong = [], []
    for s in specs.split("+" if hierarchical else ","):
        try:
            found.append(parse_dimension(s.strip(), manifest))
        except ValueError as e:
            wrong.append(str(e))
    if wrong and (strict or not found):
        raise ValueError("; ".join(wrong))
    return found, hierarchical


def legacy_mods(dimensions: str) -> str:
    """The spec of a plain list of MODS dimensions."""
    return ",".join(f"mods:{d.strip()}" for d in dimensions.split(",") if d.strip())


def default_keys(metric: Column, dirs: Column) -> Column:
    """label@:directory for every directory: the keys where no dimension is named."""
    return F.transform(dirs, lambda d: F.concat(metric, F.lit("@:"), d))


def manifest_values(entries: DataFrame, rows: DataFrame, d: Dimension) -> DataFrame:
    """(path, value) of the entries that the manifest knows: the first href, in the manifest's order, that holds the groundtruth's name or that its path holds."""
    file, phys, link, logi = manifests.tables(rows, str(d.argument) if d.kind == "mets" else "TYPE")
    if d.kind == "mets":
        values = mets.file_attribute(file, phys, link, logi, "value").where("value is not null")
        values = values.join(file.groupBy("href").agg(F.min(F.struct(F.lit(0).alias("late"), "doc_ord")).alias("ord")), "href")
    else:
        dmds = mets.file_dmds(file, phys, link, logi).where("dmdids is not null")
        values = mets.dmd_values(dmds, manifests.mods_values(rows, str(d.argument)))
        # Files with a DMDID of their own or their group's come first, then those known by links only.
        values = values.join(file.groupBy("href").agg(F.min(F.struct((F.size("dmdids") == 0).cast("int").alias("late"), "doc_ord")).alias("ord")), "href")
    asked = entries.where("gt_path is not null").select("path", "gt_path", names.base_name(F.col("gt_path")).alias("name")).distinct()
    found = mets.entry_hrefs(asked.select(F.col("path").alias("entry"), F.col("gt_path").alias("path"), "name"), values.select("href", "ord"))
    out = found.join(values.select("href", "value"), "href").select(F.col("entry").alias("path"), "value")
    return out.withColumn("value", TRANSFORMS[str(d.more)](F.col("value"))) if d.more and d.kind == "mods" else out


def columns(entries: DataFrame, dimensions: list[Dimension], rows: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, Column, bool]]]:
    """entries with what the manifest's dimensions add, and (name, value, whether it is a list) of each dimension, as `aggregate.dimension_keys` takes them."""
    out: list[tuple[str, Column, bool]] = []
    dirs = names.domains(F.col("path"), F.col("root"))
    for k, d in enumerate(dimensions):
        if d.kind == "directory":
            out.append((d.name, names.directory_level(dirs, d.argument), d.argument is None))  # type: ignore[arg-type]
        elif d.kind == "type":
            out.append((d.name, F.nullif("gt_type", F.lit(names.UNSET)), False))
        elif d.kind == "metadata":
            out.append((d.name, F.try_element_at("tags", F.lit(d.argument)), False))
        elif d.kind == "pattern":
            out.append((d.name, names.pattern_group(names.base_name(F.col("path")), str(d.argument), int(d.more or 1)), False))
        else:
            if rows is None:
                raise ValueError(f"{d.kind} needs a manifest")
            entries = entries.join(manifest_values(entries, rows, d).withColumnRenamed("value", f"__dimension_{k}"), "path", "left")
            out.append((d.name, F.col(f"__dimension_{k}"), False))
    return entries, out
