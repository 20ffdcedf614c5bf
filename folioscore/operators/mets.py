"""Manifest resolution over the narrow tables of a METS document, and the merge of many into one.

Tables: file (file_id, href, dmdids, grp_dmdids, doc_ord), phys (div_id,
file_id), logi (div_id, dmdids, type, label, doc_ord), link (log_id, phys_id,
doc_ord), dmd (dmd_id, value, doc_ord).  All joins are equi-joins; priorities
are min_by and max_by aggregates, so no step needs a sort of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _linked(file: DataFrame, phys: DataFrame, link: DataFrame, logi: DataFrame) -> DataFrame:
    to_log = phys.join(link.select("log_id", F.col("phys_id").alias("div_id"), F.col("doc_ord").alias("link_ord")), "div_id").select("file_id", "log_id", "link_ord")
    return file.select("file_id", "href").join(to_log, "file_id").join(logi.withColumnRenamed("div_id", "log_id").withColumnRenamed("dmdids", "log_dmdids"), "log_id")


def file_dmds(file: DataFrame, phys: DataFrame, link: DataFrame, logi: DataFrame) -> DataFrame:
    """(href, dmdids): of the last link to a logical division that has some, else of the file, else of its group."""
    linked = _linked(file, phys, link, logi).where(F.size("log_dmdids") > 0).groupBy("file_id").agg(F.max_by("log_dmdids", "link_ord").alias("linked"))
    own = lambda c: F.when(F.size(c) > 0, F.col(c))
    return file.join(linked, "file_id", "left").select("href", F.coalesce("linked", own("dmdids"), own("grp_dmdids")).alias("dmdids"))


def file_attribute(file: DataFrame, phys: DataFrame, link: DataFrame, logi: DataFrame, attribute: str) -> DataFrame:
    """(href, value): the attribute of the first linked logical division that has it, else of the division with the file's own DMDID."""
    linked = _linked(file, phys, link, logi).where(F.col(attribute).isNotNull()).groupBy("file_id").agg(F.min_by(attribute, "link_ord").alias("primary"))
    by_dmd = logi.where(F.col(attribute).isNotNull()).select(F.explode("dmdids").alias("dmd_id"), F.col(attribute).alias("v"), F.col("doc_ord").alias("o")).groupBy("dmd_id").agg(F.min_by("v", "o").alias("v"))
    wanted = file.select("file_id", F.posexplode(F.concat(F.coalesce("dmdids", F.array()), F.coalesce("grp_dmdids", F.array()))).alias("pos", "dmd_id"))
    fallback = wanted.join(by_dmd, "dmd_id").groupBy("file_id").agg(F.min_by("v", "pos").alias("fallback"))
    return file.join(linked, "file_id", "left").join(fallback, "file_id", "left").select("href", F.coalesce("primary", "fallback").alias("value"))


def dmd_values(files: DataFrame, dmd: DataFrame) -> DataFrame:
    """(href, value): from (href, dmdids), the first of a file's DMDIDs, in their order, that has a value."""
    each = files.select("href", F.posexplode("dmdids").alias("pos", "dmd_id"))
    found = each.join(dmd.where("value is not null").select("dmd_id", "value"), "dmd_id").groupBy("href").agg(F.min_by("value", "pos").alias("value"))
    return files.select("href").join(found, "href", "left")


def entry_hrefs(entries: DataFrame, hrefs: DataFrame) -> DataFrame:
    """entries (path, name) with the first href, by order (href, ord), that contains the name or that the path contains.

    A name inside an href is found by the parts of the href's file name that are
    as long as some name, an href inside a path by the part of both after the
    last slash, which containment implies for paths to files; so both are
    equi-joins.
    """
    last = F.element_at(F.split("href", "/"), -1)
    lengths = entries.select(F.length("name").alias("n")).distinct()
    parts = hrefs.withColumn("file", last).select("href", "ord", "file", F.explode(F.sequence(F.lit(1), F.length("file"))).alias("at"))
    by_name = parts.join(F.broadcast(lengths), F.col("at") + F.col("n") - 1 <= F.length("file")).select("href", "ord", F.col("file").substr(F.col("at"), F.col("n")).alias("name"))
    by_path = hrefs.withColumn("file", last).join(entries.select("path", F.element_at(F.split("path", "/"), -1).alias("file")), "file").where(F.contains("path", "href")).select("path", "href", "ord")
    both = entries.join(by_name, "name").select("path", "href", "ord").unionByName(by_path)
    first = both.groupBy("path").agg(F.min_by("href", "ord").alias("href"))
    return entries.join(first, "path", "left")


def first_of_each(dmd: DataFrame) -> DataFrame:
    """One row per dmd_id, the first in document order."""
    w = Window.partitionBy("dmd_id").orderBy("doc_ord")
    return dmd.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def renumber(divs: DataFrame, within: str) -> DataFrame:
    """divs with order 1..n in document order inside each `within`."""
    return divs.withColumn("order", F.row_number().over(Window.partitionBy(within).orderBy("doc_ord")).cast("bigint"))


def nearest_ancestor_dmd(divs: DataFrame, kinds: tuple[str, ...] = ("monograph", "volume", "issue", "additional")) -> DataFrame:
    """(div_id, dmd_id) from divs with ancestors (array of id, type, dmd_id; nearest first): of the nearest of the kinds that has one."""
    fit = F.filter("ancestors", lambda a: a["type"].isin(*kinds) & a["dmd_id"].isNotNull())
    return divs.select("div_id", F.when(F.size(fit) > 0, F.element_at(fit, 1)["dmd_id"]).alias("dmd_id"))
