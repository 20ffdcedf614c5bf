"""METS documents with MODS sections as narrow tables, and the merge of many into one manifest.

`parse` reads every document once into rows of one schema; the functions below
select the tables of `operators.mets` from them.  Tags are matched by local
names, so any prefix will do.  A document that can't be read is one row with
its error.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MODS = "http://www.loc.gov/mods/v3"
ROWS = "path string, kind string, id string, ref string, ids array<string>, attrs map<string,string>, above array<struct<id: string, type: string, dmd: string>>, xml string, ord int, error string"
_ABOVE = pa.list_(pa.struct([("id", pa.string()), ("type", pa.string()), ("dmd", pa.string())]))
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("ref", pa.string()), ("ids", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("above", _ABOVE), ("xml", pa.string()), ("ord", pa.int32()), ("error", pa.string())])

#: Paths of the usual dimensions inside a MODS section.
MODS_PATHS = {
    "language": "language/languageTerm[@type='code']", "languageTerm": "language/languageTerm", "genre": "genre", "dateIssued": "originInfo/dateIssued", "dateCreated": "originInfo/dateCreated", "publisher": "originInfo/publisher",
    "place": "originInfo/place/placeTerm", "title": "titleInfo/title", "author": "name/namePart", "subject": "subject/topic", "classification": "classification",
}


def mods_path(dimension: str) -> str:
    """The search path of a dimension by name, or of a path that begins with .// and may use the prefix mods."""
    if dimension in MODS_PATHS:
        return ".//" + "/".join(f"{{{_MODS}}}{step}" for step in MODS_PATHS[dimension].split("/"))
    if dimension.startswith(".//"):
        return dimension.replace("mods:", f"{{{_MODS}}}")
    raise ValueError(f"unknown MODS dimension {dimension!r}: one of {', '.join(MODS_PATHS)}, or a path that starts with .//")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _plain(e: ET.Element) -> dict[str, str]:
    return {k.rpartition("}")[2]: v for k, v in e.attrib.items()}


def manifest_rows(path: str, content: bytes | str | None) -> list[dict]:
    raw = content.encode() if isinstance(content, str) else bytes(content or b"")
    try:
        root = ET.fromstring(raw.removeprefix(b"\xef\xbb\xbf"))
    except ET.ParseError as e:
        return [{"path": path, "kind": "error", "error": str(e)}]
    out: list[dict] = []

    def add(kind: str, **fields: object) -> None:
        out.append({"path": path, "kind": kind, "ord": len(out)} | fields)

    def walk(e: ET.Element, above: list[ET.Element], structure: str | None) -> None:
        name, own = _tag(e), _plain(e)
        if name == "structMap":
            structure = own.get("TYPE")
        if name == "file":
            href = next((_plain(x)["href"] for x in e if _tag(x) == "FLocat" and _plain(x).get("href")), None)
            group = _plain(above[-1]) if above else {}
            if href is not None:
                add("file", id=own.get("ID"), ref=href, ids=(own.get("DMDID") or group.get("DMDID") or "").split(), attrs={"USE": group.get("USE", "")} | own)
        elif name == "div" and own.get("ID"):
            chain = [{"id": _plain(a).get("ID"), "type": _plain(a).get("TYPE"), "dmd": _plain(a).get("DMDID")} for a in reversed(above) if _tag(a) == "div"]
            add("phys" if structure == "PHYSICAL" else "logi" if structure == "LOGICAL" else "div", id=own["ID"], ids=own.get("DMDID", "").split(), attrs=own, above=chain)
            for x in e:
                if _tag(x) == "fptr" and structure == "PHYSICAL":
                    add("pointer", id=own["ID"], ref=x.get("FILEID"))
        elif name == "smLink":
            add("link", id=own.get("from"), ref=own.get("to"))
        elif name == "mods":
            holder = next((_plain(a).get("ID") for a in reversed(above) if _tag(a) == "dmdSec"), None)
            add("mods", id=holder, xml=ET.tostring(e, encoding="unicode"))
        for x in e:
            walk(x, [*above, e], structure)

    walk(root, [], None)
    return out


def parse(documents: DataFrame) -> DataFrame:
    """ROWS of documents (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [{c: list(r[c].items()) if c == "attrs" and r.get(c) is not None else r.get(c) for c in ARROW.names} for r in manifest_rows(path, content)]
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return documents.select("path", "content").mapInArrow(run, ROWS)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(folder))


def tables(rows: DataFrame, attribute: str = "TYPE") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(file, phys, link, logi) of `operators.mets`, ids made distinct by their document's path; `value` of logi is the attribute."""
    own = lambda c: F.concat_ws("#", "path", c)
    each = F.transform("ids", lambda d: F.concat_ws("#", F.col("path"), d))
    kind = lambda k: rows.where(F.col("kind") == k)
    file = kind("file").select(own("id").alias("file_id"), F.col("ref").alias("href"), each.alias("dmdids"), F.array().cast("array<string>").alias("grp_dmdids"), F.struct("path", "ord").alias("doc_ord"))
    phys = kind("pointer").select(own("id").alias("div_id"), own("ref").alias("file_id"))
    link = kind("link").where("id is not null and ref is not null").select(own("id").alias("log_id"), own("ref").alias("phys_id"), F.struct("path", "ord").alias("doc_ord"))
    logi = kind("logi").select(own("id").alias("div_id"), each.alias("dmdids"), F.nullif(F.try_element_at("attrs", F.lit(attribute)), F.lit("")).alias("value"), F.struct("path", "ord").alias("doc_ord"))
    return file, phys, link, logi


def found_values(xml: Column, dimension: str) -> Column:
    """The texts at a dimension's path inside a MODS section, joined by +; null if there is none."""
    path = mods_path(dimension)

    @F.pandas_udf("string")
    def run(sections: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            texts = [e.text for e in ET.fromstring(x).findall(path) if e.text] if x else []
            return "+".join(texts) or None

        return sections.map(one)

    return run(xml)


def mods_values(rows: DataFrame, dimension: str) -> DataFrame:
    """(dmd_id, value) of every metadata section: from its first MODS block with a value."""
    each = rows.where("kind = 'mods' and id is not null").select(F.concat_ws("#", "path", "id").alias("dmd_id"), "ord", found_values(F.col("xml"), dimension).alias("value"))
    return each.where("value is not null").groupBy("dmd_id").agg(F.min_by("value", "ord").alias("value"))


def projected(xml: Column) -> Column:
    """A MODS section with nothing but its title, identifiers, languages, genres and publication."""

    @F.pandas_udf("string")
    def run(sections: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            root, name = ET.fromstring(x), f"{{{_MODS}}}"
            out = ET.Element(root.tag, root.attrib)
            out.extend(root.findall(f".//{name}titleInfo")[:1])
            for tag in ("identifier", "language", "genre"):
                out.extend(root.findall(f".//{name}{tag}"))
            out.extend(root.findall(f".//{name}originInfo[@eventType='publication']")[:1])
            return ET.tostring(out, encoding="unicode")

        return sections.map(one)

    return run(xml)


def corpus_pages(resources: DataFrame, rows: DataFrame, kinds: tuple[str, ...] = ("monograph", "volume", "issue", "additional"), group: str = "OCR-D-GT-FULLTEXT") -> DataFrame:
    """A row of the merged manifest for every resource (identifier, relative_path, file_base_name) whose page a document has.

    (position, identifier, path, phys_id, image_id, image_href, log_id, dmd_id, file_id, href, error): the page's largest image, its first
    linked division with the DMDID of the nearest division above of the kinds, and the new full text's file.  Documents
    with several MODS blocks are an error of the page, unreadable ones and pages without a match are left out.
    Positions follow the file names; they are counted by ranges, so no task sees all pages.
    """
    div = rows.where("kind = 'phys'").select("path", F.col("id").alias("phys_id"), F.try_element_at("attrs", F.lit("CONTENTIDS")).alias("identifier"))
    image = (
        rows.where("kind = 'pointer'").select("path", F.col("id").alias("phys_id"), F.col("ref").alias("image_id"), F.col("ord").alias("o"))
        .join(rows.where("kind = 'file' and attrs['USE'] = 'MAX'").select("path", F.col("id").alias("image_id"), F.col("ref").alias("image_href")), ["path", "image_id"])
        .groupBy("path", "phys_id").agg(F.min_by(F.struct("image_id", "image_href"), "o").alias("image"))
    )
    first = rows.where("kind = 'link'").groupBy("path", F.col("ref").alias("phys_id")).agg(F.min_by("id", "ord").alias("log_id"))
    fit = F.filter("above", lambda a: a["type"].isin(*kinds) & a["dmd"].isNotNull())
    logi = rows.where("kind = 'logi'").select("path", F.col("id").alias("log_id"), F.when(F.size(fit) > 0, F.element_at(fit, 1)["dmd"]).alias("dmd_id"))
    blocks = rows.where("kind = 'mods'").groupBy("path").agg(F.count("*").alias("n"))
    joined = resources.join(div, "identifier").join(image, ["path", "phys_id"]).join(first, ["path", "phys_id"]).join(logi, ["path", "log_id"]).join(blocks, "path", "left")
    placed = numbered(joined, ["file_base_name", "identifier"], "position")
    return placed.select(
        "position", "identifier", "path", "phys_id", "image.image_id", "image.image_href", "log_id", "dmd_id", F.concat_ws("-", F.lit(group), F.col("position").cast("string")).alias("file_id"), F.col("relative_path").alias("href"),
        F.when(F.col("n") > 1, F.concat(F.lit("more than one MODS block: "), F.col("n").cast("string"))).alias("error"),
    )


def numbered(df: DataFrame, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """df with a position 1..n in the order of columns: ranges, their sizes, and a count inside each.

    The ranges' bounds are keys of the rows with the least hashes, so that however often and wherever the plan is run again, a row
    falls into the same range; Spark's own range partitioning draws anew for the sizes and for the rows, and the two disagree.
    """
    from pyspark.sql.window import Window

    key = F.struct(*order)
    drawn = df.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h").limit(20 * ranges).agg(F.array_sort(F.collect_list("k")).alias("all"))
    bounds = drawn.select(F.filter("all", lambda _, i: i % 20 == 19).alias("__bounds"))
    cut = df.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < key))).drop("__bounds")
    inside = cut.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__before"))
    return inside.join(F.broadcast(before), "__range").withColumn(name, (F.col("__in") + F.col("__before")).cast("bigint")).drop("__range", "__in", "__before")


def corpus_sections(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(dmd_id, mods): the metadata section of each DMDID that pages name, once, from the first page that does, projected."""
    some = pages.where("error is null").groupBy("dmd_id").agg(F.min_by("path", "position").alias("path"))
    sections = rows.where("kind = 'mods'").groupBy("path", F.col("id").alias("dmd_id")).agg(F.min_by("xml", "ord").alias("xml"))
    return some.join(sections, ["path", "dmd_id"]).select("dmd_id", projected(F.col("xml")).alias("mods"))


def corpus_lines(pages: DataFrame, rows: DataFrame, label: str = "Ground Truth Corpus") -> DataFrame:
    """(section, position, line): the merged manifest as lines in order; written by `pages.write_lines`, its parts are one document."""
    good = pages.where("error is null")
    attr = lambda name, c: F.concat(F.lit(f" {name}=\""), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit('"'))
    fixed = [
        (0, '<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink">'), (20, '<mets:fileSec><mets:fileGrp USE="OCR-D-IMG">'), (30, '</mets:fileGrp><mets:fileGrp USE="OCR-D-GT-FULLTEXT">'),
        (40, '</mets:fileGrp></mets:fileSec><mets:structMap TYPE="PHYSICAL"><mets:div ID="physroot" TYPE="physSequence">'), (50, f'</mets:div></mets:structMap><mets:structMap TYPE="LOGICAL"><mets:div ID="logroot" LABEL={quoteattr(label)}>'), (60, "</mets:div></mets:structMap><mets:structLink>"), (70, "</mets:structLink></mets:mets>"),
    ]
    line = lambda section, *parts: good.select(F.lit(section).alias("section"), "position", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))
    out = pages.sparkSession.createDataFrame([(s, 0, t) for s, t in fixed], "section int, position bigint, line string")
    dmd = corpus_sections(pages, rows).select(F.lit(10).alias("section"), F.lit(0).cast("bigint").alias("position"), F.concat(F.lit("<mets:dmdSec"), attr("ID", "dmd_id"), F.lit('><mets:mdWrap MDTYPE="MODS"><mets:xmlData>'), "mods", F.lit("</mets:xmlData></mets:mdWrap></mets:dmdSec>")).alias("line"))
    for more in (
        dmd,
        line(21, "<mets:file", attr("ID", "image_id"), "><mets:FLocat LOCTYPE=\"URL\"", attr("xlink:href", "image_href"), "/></mets:file>"),
        line(31, "<mets:file", attr("ID", "file_id"), ' MIMETYPE="application/vnd.prima.page+xml"><mets:FLocat LOCTYPE="OTHER" OTHERLOCTYPE="FILE"', attr("xlink:href", "href"), "/></mets:file>"),
        line(41, "<mets:div", attr("ID", "phys_id"), attr("CONTENTIDS", "identifier"), attr("ORDER", "position"), "><mets:fptr", attr("FILEID", "image_id"), "/><mets:fptr", attr("FILEID", "file_id"), "/></mets:div>"),
        line(51, "<mets:div", attr("ID", "log_id"), attr("DMDID", "dmd_id"), attr("ORDER", "position"), "/>"),
        line(61, "<mets:smLink", attr("xlink:from", "log_id"), attr("xlink:to", "phys_id"), "/>"),
    ):
        out = out.unionByName(more)
    return out


def gt_resources(files: DataFrame, limit: int = 0) -> DataFrame:
    """(identifier, languages, file_base_name, relative_path) of files (name, relative_path) whose names tell an identifier, by name; the first `limit`, 0 for all."""
    from ..functions.names import urn_resource

    known = files.select(urn_resource(F.col("name")).alias("r"), F.regexp_replace("name", r"\.xml$", "").alias("file_base_name"), "relative_path", "name").where("r is not null")
    ordered = known.orderBy("name")
    return (ordered.limit(limit) if limit else ordered).select("r.identifier", "r.languages", "file_base_name", "relative_path")




def copy_plan(files: DataFrame, out_dir: str) -> DataFrame:
    """(source, target): where the files (path, relative_path) of a corpus go, their relative paths kept."""
    return files.select(F.col("path").alias("source"), F.concat_ws("/", F.lit(out_dir.rstrip("/")), "relative_path").alias("target"))
