"""Queries over documents: manifests, dimension specs, page trees, frames, training lines and the evaluation as a whole.

Suppliers are files of the manifests of nations; conversations are written as
page documents, a region and line for each turn.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, text
from ..operators import aggregate, dimensions, evaluate, mets, metrics
from ..sources import manifests, nodes
from .evaluation import PAIRS, STATS, _prices, _PRICES, damaged, damaged_sql, literal, pairs, rounded, tokens_sql
from .structure import _escaped
from .tables import register, table

_C = F.concat


def _s(x: str) -> Column:
    return F.lit(x)


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a METS document for every nation, with its suppliers as pages; nations of region 0 have a second metadata section for their files."""
    n, r, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    each = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("good")))).alias("s"))
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(each, "n_nationkey")
    every = lambda f: F.array_join(F.transform("s", f), "")
    group = F.col("n_regionkey") == 0
    section = lambda i, body: _C(_s(f'<mets:dmdSec ID="{i}"><mets:mdWrap><mets:xmlData><mods:mods>'), body, _s("</mods:mods></mets:xmlData></mets:mdWrap></mets:dmdSec>"))
    title = lambda c: _C(_s("<mods:titleInfo><mods:title>"), _escaped(F.col(c)), _s("</mods:title></mods:titleInfo>"))
    own = _C(
        title("n_name"), _s("<mods:identifier>n"), F.col("n_nationkey").cast("string"), _s('</mods:identifier><mods:note>left out</mods:note><mods:language><mods:languageTerm type="code">ger</mods:languageTerm></mods:language><mods:language><mods:languageTerm type="code">lat</mods:languageTerm></mods:language><mods:genre>'),
        _escaped(F.col("r_name")), _s('</mods:genre><mods:originInfo eventType="publication"><mods:dateIssued>'), (F.lit(1800) + F.col("n_nationkey")).cast("string"), _s("</mods:dateIssued></mods:originInfo>"),
    )
    content = _C(
        _s('<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink">'), section("D", own), F.when(group, section("G", title("r_name"))).otherwise(""),
        F.when(group, _s('<mets:fileSec><mets:fileGrp USE="MAX" DMDID="G">')).otherwise('<mets:fileSec><mets:fileGrp USE="MAX">'), every(lambda x: _C(_s('<mets:file ID="F'), x["k"], _s('"><mets:FLocat xlink:href="max/'), x["name"], _s('.xml"/></mets:file>'))),
        _s('</mets:fileGrp></mets:fileSec><mets:structMap TYPE="LOGICAL"><mets:div ID="L0" TYPE="volume" DMDID="D"><mets:div ID="L1" TYPE="chapter" LABEL="'), _escaped(F.col("n_name")), _s('"/></mets:div></mets:structMap><mets:structMap TYPE="PHYSICAL"><mets:div ID="P" TYPE="physSequence">'),
        every(lambda x: _C(_s('<mets:div ID="P'), x["k"], _s('" CONTENTIDS="urn:'), x["k"], _s('" ORDERLABEL="1"><mets:fptr FILEID="F'), x["k"], _s('"/></mets:div>'))), _s("</mets:div></mets:structMap><mets:structLink>"),
        every(lambda x: _C(F.when(x["good"], _s('<mets:smLink xlink:from="L0" xlink:to="P')).otherwise('<mets:smLink xlink:from="L1" xlink:to="P'), x["k"], _s('"/>'))), _s("</mets:structLink></mets:mets>"),
    )
    return joined.select(_C(_s("mets/"), F.col("n_nationkey").cast("string"), _s(".xml")).alias("path"), content.alias("content"))


def _manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once for all the joins that read them."""
    return manifests.parse(manifest_documents(spark, sf_dir)).persist()


_SUPPLIERS = "s AS (SELECT *, 'max/' || s_name || '.xml' AS href FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
_TITLE = "CASE WHEN s_acctbal > 0 THEN n_name WHEN n_regionkey = 0 THEN r_name END"
_DECADE = "CASE WHEN s_acctbal > 0 THEN ((1800 + n_nationkey) // 10 * 10) || 's' END"


@register(f"WITH {_SUPPLIERS} SELECT href, {_TITLE} AS title, CASE WHEN s_acctbal > 0 THEN 'ger+lat' END AS languages, CASE WHEN s_acctbal > 0 THEN 'volume' ELSE 'chapter' END AS type, CASE WHEN s_acctbal <= 0 THEN n_name END AS label FROM s")
def mets_xml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the sections and divisions of parsed manifests for every file."""
    rows = _manifest_rows(spark, sf_dir)
    found = mets.file_dmds(*manifests.tables(rows))
    value = lambda d: mets.dmd_values(found.where("dmdids is not null"), manifests.mods_values(rows, d))
    out = found.select("href").join(value("title").withColumnRenamed("value", "title"), "href", "left").join(value("language").withColumnRenamed("value", "languages"), "href", "left")
    for attribute, name in (("TYPE", "type"), ("LABEL", "label")):
        out = out.join(mets.file_attribute(*manifests.tables(rows, attribute), "value").withColumnRenamed("value", name), "href", "left")
    return out


@register("SELECT 'gt/' || s_name || '.xml' AS path, 'max/' || s_name || '.xml' AS href FROM supplier")
def mets_entry_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = manifests.tables(manifests.parse(manifest_documents(spark, sf_dir)))[0]
    name = _C(F.col("s_name"), _s(".xml"))
    return mets.entry_hrefs(table(spark, sf_dir, "supplier").select(_C(_s("gt/"), name).alias("path"), name.alias("name")), file.select("href", F.col("doc_ord").alias("ord"))).select("path", "href")


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _manifest_rows(spark, sf_dir)
    c = F.col("s_suppkey").cast("string")
    resources = table(spark, sf_dir, "supplier").select(_C(_s("urn:"), c).alias("identifier"), _C(_s("x/"), "s_name").alias("relative_path"), F.col("s_name").alias("file_base_name"))
    return manifests.corpus_pages(resources, rows), rows


@register(f"""WITH {_SUPPLIERS} SELECT row_number() OVER (ORDER BY s_name) AS position, 'urn:' || s_suppkey AS identifier, 'P' || s_suppkey AS phys_id, 'F' || s_suppkey AS image_id, href AS image_href, CASE WHEN s_acctbal > 0 THEN 'L0' ELSE 'L1' END AS log_id,
CASE WHEN s_acctbal <= 0 THEN 'D' END AS dmd_id, 'OCR-D-GT-FULLTEXT-' || row_number() OVER (ORDER BY s_name) AS file_id, 'x/' || s_name AS href, CASE WHEN n_regionkey = 0 THEN 'more than one MODS block: 2' END AS error FROM s""")
def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)[0].drop("path")


@register(f"""WITH {_SUPPLIERS}, p AS (SELECT row_number() OVER (ORDER BY s_name) AS position, * FROM s), g AS (SELECT count(*) AS n FROM p WHERE n_regionkey <> 0), d AS (SELECT count(*) AS n FROM (SELECT min(position) FROM p WHERE n_regionkey <> 0 AND s_acctbal <= 0 HAVING count(*) > 0))
SELECT section, CAST(lines AS BIGINT) AS lines FROM (SELECT unnest([0, 20, 30, 40, 50, 60, 70]) AS section, 1 AS lines UNION ALL SELECT 10, d.n FROM d WHERE d.n > 0 UNION ALL SELECT unnest([21, 31, 41, 51, 61]), g.n FROM g)""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the merged manifest by section."""
    return manifests.corpus_lines(*_pages(spark, sf_dir)).groupBy("section").agg(F.count("line").alias("lines"))


@register("""SELECT n_nationkey, n_name AS title, 'n' || n_nationkey AS identifier, 'ger+lat' AS languages, r_name AS genre, CAST(1800 + n_nationkey AS VARCHAR) AS issued, 0 AS notes FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def mods_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.parse(manifest_documents(spark, sf_dir)).where("kind = 'mods' and id = 'D'")
    x = rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("int").alias("n_nationkey"), manifests.projected(F.col("xml")).alias("x"))
    value = lambda d: manifests.found_values(F.col("x"), d)
    return x.select("n_nationkey", value("title").alias("title"), value(".//mods:identifier").alias("identifier"), value("language").alias("languages"), value("genre").alias("genre"), value("dateIssued").alias("issued"), F.contains("x", _s("note")).cast("int").alias("notes"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    c = F.col
    path = _C(_s("in/root/r"), c("n_regionkey").cast("string"), _s("/n"), c("n_nationkey").cast("string"), _s("/"), "s_name", _s(".xml"))
    kind = F.when(c("s_acctbal") > 5000, "article").when(c("s_acctbal") > 1000, "announcement").otherwise("n.a.")
    tags = F.when(c("s_acctbal") > 0, F.create_map(_s("shelf"), _C(_s("b"), (c("s_suppkey") % 3).cast("string"))))
    score = lambda v: F.struct(v.alias("value"), (c("s_suppkey") * 150).cast("bigint").alias("n_ref"))
    base = F.pmod(c("s_suppkey") * 37, F.lit(100)).cast("double")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        path.alias("path"), _s("root").alias("root"), _C(_s("gt/"), "s_name", _s(".xml")).alias("gt_path"), kind.alias("gt_type"), tags.alias("tags"),
        score(base).alias("Cs"), score(F.abs(base - 7.5)).alias("Ls"), score(base / 2).alias("Ws"), score(F.lit(50.25)).alias("BoWs"),
    )


_VALUES = f"{_SUPPLIERS}, e AS (SELECT *, CAST((s_suppkey * 37) % 100 AS DOUBLE) AS value, CAST(s_suppkey * 150 AS BIGINT) AS n_ref FROM s)"
_TYPE = "CASE WHEN s_acctbal > 5000 THEN 'article' WHEN s_acctbal > 1000 THEN 'announcement' END"
_KEYS = {
    "spec_default": (None, "[':n' || n_nationkey, ':r' || n_regionkey, ':root']"),
    "spec_directory": ("directory", "['directory:n' || n_nationkey, 'directory:r' || n_regionkey, 'directory:root']"),
    "spec_directory_level": ("directory:1,directory:-1", "['directory_1:r' || n_regionkey, 'directory_-1:n' || n_nationkey]"),
    "spec_type": ("type", f"['type:' || {_TYPE}]"),
    "spec_metadata": ("metadata:shelf", "['metadata_shelf:b' || CASE WHEN s_acctbal > 0 THEN s_suppkey % 3 END]"),
    "spec_pattern": (r"pattern:(\d)(\d)\.xml$:2", "['pattern:' || substr(s_name, -1)]"),
    "spec_mods": ("mods:title,mods:dateIssued:decade", f"['mods_title:' || {_TITLE}, 'mods_dateIssued_decade:' || {_DECADE}]"),
    "spec_mets": ("mets:label", "['mets_div_label:' || CASE WHEN s_acctbal <= 0 THEN n_name END]"),
    "spec_hierarchical": ("directory:1+mods:genre+mods:dateIssued:century", "['directory_1:r' || n_regionkey, 'mods_genre:' || CASE WHEN s_acctbal > 0 THEN r_name END, CASE WHEN s_acctbal > 0 THEN 'mods_dateIssued_century:19th' END, 'directory_1:r' || n_regionkey || '/mods_genre:' || CASE WHEN s_acctbal > 0 THEN r_name END || '/mods_dateIssued_century:19th']"),
    "spec_legacy_mods": (dimensions.legacy_mods("publisher, language"), "['mods_language:' || CASE WHEN s_acctbal > 0 THEN 'ger+lat' END]"),
}


def _spec(name: str, spec: str | None, keys: str) -> None:
    @register(f"WITH {_VALUES}, k AS (SELECT unnest([CASE WHEN x IS NOT NULL THEN 'Cs@' || x END FOR x IN {keys}]) AS key, value, n_ref FROM e) SELECT key, {STATS} FROM k WHERE key IS NOT NULL GROUP BY key", name=name)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _manifest_rows(spark, sf_dir) if spec and ("mods" in spec or "mets" in spec) else None
        return rounded(aggregate.statistics(evaluate.keyed(_entries(spark, sf_dir), ["Cs"], spec, rows)))


for _name, (_text, _sql) in _KEYS.items():
    _spec(_name, _text, _sql)


_GAP = "CASE WHEN abs(v - 7.5) - v > 0 THEN printf('(+%5.2f)', abs(v - 7.5) - v) ELSE printf('(-%5.2f)', abs(abs(v - 7.5) - v)) END"
_GAP2 = "CASE WHEN 50.25 - v / 2 > 0 THEN printf('(+%5.2f)', 50.25 - v / 2) ELSE printf('(-%5.2f)', abs(50.25 - v / 2)) END"


@register(f"""WITH {_SUPPLIERS}, e AS (SELECT *, CAST((s_suppkey * 37) % 100 AS DOUBLE) AS v, CASE WHEN s_suppkey * 150 > 10000 THEN printf('%2dK+', CAST(s_suppkey * 150 // 1000 AS BIGINT)) ELSE printf('%4d', CAST(s_suppkey * 150 AS BIGINT)) END AS n FROM s)
SELECT 'in/root/r' || n_regionkey || '/n' || n_nationkey || '/' || s_name || '.xml' AS path, '[' || s_name || ']' || CASE WHEN s_acctbal > 5000 THEN '(art)' WHEN s_acctbal > 1000 THEN '(ann)' ELSE '' END || ' [Cs:' || printf('%5.2f', v) || '(' || n || '), Ls:' || printf('%5.2f', abs(v - 7.5)) || '(' || n || ')' || {_GAP}
|| ', Ws:' || printf('%5.2f', v / 2) || '(' || n || '), BoWs:' || printf('%5.2f', 50.25) || '(' || n || ')' || {_GAP2} || ']' AS line FROM e""")
def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidate_lines(_entries(spark, sf_dir), ["Cs", "Ls", "Ws", "BoWs"])


@register(f"""WITH {_PRICES}, s AS (SELECT key, count(*) AS n, CAST(sum(n_ref) AS BIGINT) AS refs, avg(value) AS a, median(value) AS m, stddev_pop(value) AS sd FROM p GROUP BY key),
q AS (SELECT p.key, median(CASE WHEN value < m THEN value END) AS q1, median(CASE WHEN value > m THEN value END) AS q3 FROM p JOIN s USING (key) WHERE n > 1 AND sd >= 1 GROUP BY p.key),
c AS (SELECT p.key, count(*) AS n, CAST(sum(n_ref) AS BIGINT) AS refs, avg(value) AS a, median(value) AS m, stddev_pop(value) AS sd FROM p JOIN q USING (key) WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q1 + 1.5 * (q3 - q1) GROUP BY p.key)
SELECT key, 0 AS part, printf('%s\t%3d items %d refs\tmean:%5.2f', key, n, refs, a) || CASE WHEN n > 1 THEN printf(' M:%5.2f std:%5.2f', m, sd) ELSE '' END AS line FROM s
UNION ALL SELECT c.key, 1, printf('%s(-%d)\t%3d items %d refs\tmean:%5.2f M:%5.2f std:%5.2f', c.key, s.n - c.n, c.n, c.refs, c.a, c.m, c.sd) FROM c JOIN s USING (key) WHERE c.n < s.n""")
def report_with_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_lines(aggregate.cleaned_statistics(_prices(spark, sf_dir)))


def page_documents(spark: SparkSession, sf_dir: str, candidate: bool = False) -> DataFrame:
    """(path, content): conversations as page documents, a region with one line for each turn that has words; lines of every seventh lie outside of their region.

    Candidates have typical errors and a word outside of the frame.
    """
    c = F.col
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.tokens(damaged(c("text")) if candidate else c("text")).alias("t")).where(F.size("t") > 0)
    n = lambda x: F.coalesce(x.cast("string"), _s("null"))

    def points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        a, b, c, d = n(x0), n(y0), n(x1), n(y1)
        return _C(_s('<Coords points="'), a, _s(","), b, _s(" "), c, _s(","), b, _s(" "), c, _s(","), d, _s(" "), a, _s(","), d, _s('"/>'))

    y = c("turn") * 100
    wide = F.size("t") * 10 + 10
    equiv = lambda s: _C(_s("<TextEquiv><Unicode>"), _escaped(s), _s("</Unicode></TextEquiv>"))
    word = lambda s, k: _C(_s('<Word id="w'), n(c("turn")), _s("_"), n(k), _s('">'), points(k * 10 + 1, y + 5, k * 10 + 9, y + 45), equiv(s), _s("</Word>"))
    words = F.array_join(F.transform("t", word), "")
    if candidate:
        words = _C(words, F.format_string('<Word id="x%d">', c("turn")), points(F.lit(900_000), y + 5, F.lit(900_008), y + 45), equiv(_s("outside")), _s("</Word>"))
    low = F.when(c("conv_id") % 7 == 0, y + 70).otherwise(y)
    line = _C(F.format_string('<TextLine id="l%d">', c("turn")), points(F.lit(0), low, wide, low + 50), words, equiv(F.array_join("t", " ")), _s("</TextLine>"))
    region = _C(F.format_string('<TextRegion id="r%d">', c("turn")), points(F.lit(0), y, wide, y + 50), line, _s("</TextRegion>"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", region.alias("x")))), lambda r: r["x"]), "")
    content = _C(_s('<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Page imageFilename="i.tif" imageWidth="9" imageHeight="9">'), whole, _s("</Page></PcGts>"))
    name = _C(_s("c"), c("conv_id").cast("string"), _s(".xml" if candidate else ".art.gt.xml"))
    return t.groupBy("conv_id").agg(content.alias("content")).select(_C(_s("in/root/" if candidate else "gt/"), name).alias("path"), "content")


_TURNS = f"t AS (SELECT conv_id, turn, {tokens_sql('text')} AS t, {tokens_sql(damaged_sql('text'))} AS d FROM conversations WHERE text IS NOT NULL), g AS (SELECT * FROM t WHERE len(t) > 0)"


@register(f"""WITH {_TURNS}, b AS (SELECT conv_id, count(*) AS turns, CAST(sum(len(t)) AS BIGINT) AS words FROM g GROUP BY conv_id), ok AS (SELECT * FROM b WHERE conv_id % 7 <> 0)
SELECT 7 AS level, count(*) AS n, 0::BIGINT AS errors FROM ok UNION ALL SELECT 5, CAST(sum(turns) AS BIGINT), 0 FROM ok UNION ALL SELECT 3, CAST(sum(turns) AS BIGINT), 0 FROM ok UNION ALL SELECT 2, CAST(sum(words) AS BIGINT), 0 FROM ok
UNION ALL SELECT -1, count(*), count(*) FROM b WHERE conv_id % 7 = 0 HAVING count(*) > 0""")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by level; documents with a line outside of its region are errors."""
    return nodes.nodes(page_documents(spark, sf_dir)).groupBy(F.coalesce("level", F.lit(-1)).alias("level")).agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@register(f"""WITH {_TURNS}, ok AS (SELECT conv_id, turn, len(t) AS n FROM g WHERE conv_id % 7 <> 0)
SELECT level, CAST(sum(n) AS BIGINT) AS n, CAST(sum(width) AS DOUBLE) AS width FROM (SELECT unnest([5, 3, 2]) AS level, unnest([1, 1, n]) AS n, unnest([10 * n + 10, 10 * n + 10, 8 * n]) AS width FROM ok) GROUP BY level""")
def show_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = nodes.shapes(nodes.nodes(page_documents(spark, sf_dir)))
    return drawn.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("polygon")[2]["x"] - F.col("polygon")[0]["x"]).alias("width"))


@register(f"""WITH {_TURNS}, ok AS (SELECT conv_id, turn, len(t) AS n, turn * 100 + CASE WHEN conv_id % 7 = 0 THEN 70 ELSE 0 END AS y FROM g)
SELECT 'gt/c' || conv_id || '.art.gt.xml' AS path, 0 AS x0, CAST(min(y) AS INT) AS y0, CAST(max(10 * n + 10) AS INT) AS x1, CAST(max(y) + 50 AS INT) AS y1 FROM ok GROUP BY conv_id UNION ALL SELECT 'a_0010x0020_0300x0400.xml', 10, 20, 300, 400""")
def document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame([("a_0010x0020_0300x0400.xml", "plain")], "path string, content string")
    return nodes.frames(page_documents(spark, sf_dir).unionByName(named)).select("path", "frame.*")


@register(f"""WITH w AS (SELECT conv_id, turn, unnest({tokens_sql("text")}) AS w, unnest(range(len({tokens_sql("text")}))) AS k FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, CAST(min(10 * k) AS INT) AS x0, CAST(min(turn * 20) AS INT) AS y0, CAST(max(10 * k + 9) AS INT) AS x1, CAST(max(turn * 20 + 15) AS INT) AS y1 FROM w WHERE NOT regexp_matches(w, '^[0-9]') GROUP BY conv_id)
SELECT 'c' || conv_id AS path, x0, y0, x1, y1 FROM (SELECT DISTINCT conv_id FROM w) LEFT JOIN f USING (conv_id)""")
def string_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of ALTO documents from their strings, those that begin with a digit left out."""
    c = F.col
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.tokens(c("text")).alias("t"))
    string = lambda s, k: _C(_s('<String CONTENT="'), _escaped(s), F.format_string('" HPOS="%d" VPOS="%d" WIDTH="9" HEIGHT="15"/>', k * 10, c("turn") * 20))
    line = _C(_s("<TextLine>"), F.array_join(F.transform("t", string), ""), _s("</TextLine>"))
    whole = t.where(F.size("t") > 0).groupBy("conv_id").agg(_C(_s('<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page ID="p"><PrintSpace><TextBlock>'), F.array_join(F.collect_list(line), ""), _s("</TextBlock></PrintSpace></Page></Layout></alto>")).alias("content"))
    return nodes.frames(whole.select(_C(_s("c"), c("conv_id").cast("string")).alias("path"), "content")).select("path", "frame.*")


@register(f"""WITH {_TURNS} SELECT 'gt/c' || conv_id || '.art.gt.xml' AS path, CAST(sum(greatest(len(t) - 20, 0)) AS BIGINT) AS removed, 2 * count(*) AS resized, CAST(sum(least(len(t), 20)) AS BIGINT) AS words, CAST(max(10 * least(len(t), 20) - 1) AS DOUBLE) AS right_end FROM g GROUP BY conv_id""")
def frame_filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page documents cut at x = 200, written and parsed again; boxes follow from the words, so lines lie in their regions now."""
    cut = nodes.filter_documents(page_documents(spark, sf_dir), "-1,-1 200,900000")
    count = lambda m, *tags: sum((F.coalesce(F.try_element_at(m, _s(t)), F.lit(0)) for t in tags), F.lit(0)).cast("bigint")
    counted = cut.select("path", "content", count("removed", "Word").alias("removed"), count("resized", "TextLine", "TextRegion").alias("resized"))
    left = nodes.nodes(counted, "removed", "resized").where("error is null")
    right = F.when(F.col("level") == nodes.LINE, F.array_max(F.transform("polygon", lambda p: p["x"])))
    return left.groupBy("path").agg(F.max("removed").alias("removed"), F.max("resized").alias("resized"), F.count_if(F.col("level") == nodes.WORD).alias("words"), F.max(right).alias("right_end"))


@register(f"""WITH {_TURNS}, c AS (SELECT conv_id, unnest(t) AS w, 1 AS a, 0 AS b FROM g WHERE conv_id % 7 <> 0 UNION ALL SELECT conv_id, unnest(d), 0, 1 FROM g WHERE conv_id % 7 <> 0),
k AS (SELECT conv_id, w, sum(a) AS a, sum(b) AS b FROM c GROUP BY conv_id, w)
SELECT 'in/root/c' || conv_id || '.xml' AS path, 'article' AS gt_type, round_even(100 * (1 - sum(abs(a - b)) / sum(a + b)), 2) AS value, CAST(sum(a) AS BIGINT) AS n_ref, (SELECT count(*) FROM g x WHERE x.conv_id = k.conv_id) AS removed FROM k GROUP BY conv_id""")
def evaluate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page documents with errors against their groundtruth: matched, cut to its frame, transcribed and scored."""
    candidates, truth = page_documents(spark, sf_dir, candidate=True), page_documents(spark, sf_dir)
    matched, _ = evaluate.entries(candidates, truth, _s("root"))
    scored = evaluate.scores(matched, candidates.where(~F.col("path").rlike("nothing")), truth, ["BoWs"])
    return scored.select("path", "gt_type", "BoWs.value", "BoWs.n_ref", "removed")


@register(f"""WITH {_TURNS} SELECT 'c' || conv_id || '_l' || turn || '.gt.txt' AS file, array_to_string(list_reverse(t), ' ') AS content FROM g WHERE length(array_to_string(t, ' ')) >= 30""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.training_pairs(nodes.training_lines(page_documents(spark, sf_dir), 30), reorder=True).select("file", "content")


@register("SELECT doc_id, 'ws/' || source || '/img/' || doc_id || '.tif' AS image, 'out/' || source || '/' || doc_id || '.xml' AS target FROM documents")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    d = table(spark, sf_dir, "documents").select("doc_id", _C(_s("ws/"), "source", _s("/page/"), c("doc_id").cast("string"), _s(".xml")).alias("path"), _C("source", _s("/"), c("doc_id").cast("string"), _s(".xml")).alias("relative_path"))
    image = nodes.image_path(c("path"), _C(_s("img/"), c("doc_id").cast("string"), _s(".tif")))
    return d.select("doc_id", "path", image.alias("image")).join(manifests.copy_plan(d, "out/").withColumnRenamed("source", "path"), "path").select("doc_id", "image", "target")


@register("""WITH f AS (SELECT 'urn+nbn+de+abc+3+1-' || doc_id || '-p1-1_deu+lat.gt.xml' AS name, doc_id FROM documents ORDER BY name LIMIT 50) SELECT 'urn:nbn:de:abc:3:1-' || doc_id || '-p1-1' AS identifier, 'deu,lat' AS languages FROM f""")
def gt_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty resources by name, as the limit of the listing asks."""
    name = _C(_s("urn+nbn+de+abc+3+1-"), F.col("doc_id").cast("string"), _s("-p1-1_deu+lat.gt.xml"))
    other = table(spark, sf_dir, "documents").select(_C(_s("damaged"), F.col("doc_id").cast("string")).alias("name"), _s("x").alias("relative_path"))
    found = manifests.gt_resources(table(spark, sf_dir, "documents").select(name.alias("name"), _s("x").alias("relative_path")).unionByName(other), 50)
    return found.select("identifier", F.array_join("languages", ",").alias("languages"))


@register("SELECT conv_id, turn, count(*) + 1 AS boxes FROM (SELECT conv_id, turn, unnest(string_split(trim(nfc_normalize(text), ' '), '')) AS c FROM conversations WHERE text IS NOT NULL AND trim(text, ' ') <> '') GROUP BY conv_id, turn")
def char_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the box files of all turns."""

    @F.pandas_udf("bigint")
    def count(lines: pd.Series) -> pd.Series:
        return lines.map(lambda t: len(images.char_boxes(t, 100, 40)))

    return table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn", count("text").alias("boxes"))


@register(f"""WITH {PAIRS}, w AS (SELECT doc_id, unnest({tokens_sql("candidate")}) AS word FROM pairs), b AS (SELECT DISTINCT unnest({tokens_sql("text")}) AS word FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n, count(CASE WHEN b.word IS NULL THEN 1 END) AS e FROM w LEFT JOIN b USING (word) GROUP BY doc_id)
SELECT p.doc_id, round_even(100 * CASE WHEN n.n IS NULL THEN 1.0 ELSE 1 - e / n.n END, 2) AS value, coalesce(n.n, 0) AS n_ref FROM pairs p LEFT JOIN n USING (doc_id)""")
def dictionary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark serve as the dictionary."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return metrics.score_dictionary(pairs(spark, sf_dir).select("doc_id", "candidate"), words).select("doc_id", "DictLT.value", "DictLT.n_ref")


@register(f"SELECT doc_id, replace({damaged_sql('text')}, {literal(chr(868))}, '') AS text FROM documents")
def dictionary_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary text of candidates: normal form, then umlauts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.ligatures(text.normalise(damaged(F.col("text")))).alias("text"))
