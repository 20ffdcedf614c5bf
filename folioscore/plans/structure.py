"""Queries of files and layout: names, matching, boxes, orders and manifests.

Rows of lineitem serve as words with boxes on the pages of orders; nation,
region and supplier as divisions, metadata and files of a manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, names, text
from ..operators import lines, matching, mets, spatial
from ..sources import pages as page_source
from .evaluation import tokens_sql
from .tables import register, table


def _groundtruth(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("quality") == 1, "art").otherwise("ann")
    name = F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("."), kind, F.lit(".gt.xml"))
    return table(spark, sf_dir, "labels").select("doc_id", name.alias("gt_name"), F.concat(F.lit("gt/"), name).alias("gt_path"))


_GT = "g AS (SELECT doc_id, 'p' || doc_id || CASE WHEN quality = 1 THEN '.art' ELSE '.ann' END || '.gt.xml' AS gt_name, 'gt/' || 'p' || doc_id || CASE WHEN quality = 1 THEN '.art' ELSE '.ann' END || '.gt.xml' AS gt_path FROM labels)"
_MATCHED = f"WITH {_GT}, c AS (SELECT DISTINCT 'p' || doc_id AS stem FROM documents) SELECT stem, min(gt_path) AS gt_path FROM c LEFT JOIN g ON starts_with(gt_name, stem) GROUP BY stem"


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem")).distinct()


@register(_MATCHED)
def match_groundtruth_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_groundtruth(_stems(spark, sf_dir), _groundtruth(spark, sf_dir)).select("stem", "gt_path")


@register(f"SELECT stem FROM ({_MATCHED}) WHERE gt_path IS NULL")
def candidates_without_groundtruth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.without_groundtruth(_stems(spark, sf_dir), _groundtruth(spark, sf_dir)).select("stem")


@register(f"WITH {_GT} SELECT doc_id, CASE WHEN gt_name LIKE '%.art.gt.xml' THEN 'article' WHEN gt_name LIKE '%.ann.gt.xml' THEN 'announcement' ELSE 'n.a.' END AS type FROM g")
def gt_type_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groundtruth(spark, sf_dir).select("doc_id", names.groundtruth_type(F.col("gt_name")).alias("type"))


@register("SELECT doc_id, lang || '|' || source || '|root' AS domains FROM documents")
def domain_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/data/root"), "source", "lang", F.lit("GT-PAGE"), F.lit("a.xml"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(names.domains(path, F.lit("root")), "|").alias("domains"))


@register("SELECT page_id, CASE WHEN regexp_matches(b, '(\\d+)') THEN regexp_extract(b, '(\\d+)', 1) END AS part FROM (SELECT page_id, list_last(string_split(url, '/')) AS b FROM pages)")
def filename_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.pattern_group(names.base_name(F.col("url")), r"(\d+)").alias("part"))


@register("SELECT CAST(year(o_orderdate) // 10 * 10 AS VARCHAR) || 's' AS bucket, count(*) AS n FROM orders GROUP BY 1")
def decade_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(names.decade(F.col("o_orderdate").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@register("""SELECT c || CASE WHEN c % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c % 10 = 1 THEN 'st' WHEN c % 10 = 2 THEN 'nd' WHEN c % 10 = 3 THEN 'rd' ELSE 'th' END AS bucket, count(*) AS n
FROM (SELECT (year(o_orderdate) - 300 * (o_orderkey % 5)) // 100 + 1 AS c FROM orders) GROUP BY 1""")
def century_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years are moved back by up to 1,200, so that all endings occur."""
    year = F.lpad((F.year("o_orderdate") - 300 * (F.col("o_orderkey") % 5)).cast("string"), 4, "0")
    return table(spark, sf_dir, "orders").groupBy(names.century(year).alias("bucket")).agg(F.count("*").alias("n"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    polygon = geometry.box_polygon(c("l_quantity") * 10, c("l_linenumber") * 100.0, c("l_extendedprice") / 100, c("l_tax") * 1000)
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("word_no"), c("l_linestatus").alias("tag"), polygon.alias("polygon"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.struct(F.lit(45.5).alias("x0"), F.lit(50.0).alias("y0"), (F.col("o_totalprice") / 400).alias("x1"), F.lit(595.0).alias("y1"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), frame.alias("frame"))


_WORDS = """w AS (SELECT l_orderkey AS page_id, l_linenumber AS word_no, l_linestatus AS tag, l_quantity * 10 AS x, l_linenumber * 100.0::DOUBLE AS y, l_extendedprice / 100 AS w, l_tax * 1000 AS h FROM lineitem),
p AS (SELECT w.*, o_orderkey IS NULL OR (x + w / 2 > 45.5 AND x + w / 2 < o_totalprice / 400 AND y + h / 2 > 50 AND y + h / 2 < 595) AS inside FROM w LEFT JOIN orders ON o_orderkey = page_id)"""


@register("SELECT l_orderkey AS page_id, min(l_quantity * 10) AS x0, min(l_linenumber * 100.0::DOUBLE) AS y0, max(l_quantity * 10 + l_extendedprice / 100) AS x1, max(l_linenumber * 100.0::DOUBLE + l_tax * 1000) AS y1 FROM lineitem GROUP BY l_orderkey")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.boxes_from_children(_words(spark, sf_dir), ["page_id"]).select("page_id", "box.*")


@register(f"WITH {_WORDS} SELECT page_id, word_no FROM p WHERE inside")
def words_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.filter_words(_words(spark, sf_dir), _frames(spark, sf_dir)).select("page_id", "word_no")


@register(f"WITH {_WORDS} SELECT o_orderkey AS page_id FROM orders LEFT JOIN (SELECT page_id, bool_or(inside) AS any_left FROM p GROUP BY page_id) ON page_id = o_orderkey WHERE any_left IS NULL OR any_left")
def cascade_empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, frames = _words(spark, sf_dir), _frames(spark, sf_dir)
    return spatial.cascade(frames.select("page_id"), "page_id", words, spatial.filter_words(words, frames))


@register(f"WITH {_WORDS} SELECT tag, count(CASE WHEN NOT inside THEN 1 END) AS removed, count(CASE WHEN inside THEN 1 END) AS kept FROM p GROUP BY tag")
def frame_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.filter_report(spatial.words_with_place(_words(spark, sf_dir), _frames(spark, sf_dir)), "tag")


@register("SELECT l_orderkey, l_linenumber, y > 0 AND x > 0 AND -1000 * y - 700 * (x - 1000) > 0 AS inside FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS x, l_quantity * 10 AS y FROM lineitem)")
def hull_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against a triangle with a corner inside its hull."""
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    polygon = F.array(p(0, 0), p(1000, 0), p(100, 100), p(0, 700))
    inside = geometry.in_hull(polygon, F.col("l_extendedprice") / 100, F.col("l_quantity") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", inside.alias("inside"))


@register("SELECT conv_id AS page_id, turn AS region_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN length(text) END NULLS LAST, turn) AS rank FROM conversations")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are regions; those of users are listed, by length."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("region_id"), "role", F.length("text").alias("index"))
    listed = c.where("role = 'user'").select("page_id", "region_id", "index")
    return lines.reading_order(c.select("page_id", "region_id", F.col("region_id").alias("dom_pos")), listed).select("page_id", "region_id", "rank")


@register("""WITH e AS (SELECT user_id AS line_id, event_id AS pos, event_type = 'click' AS is_space, 'e' || event_id AS id, event_type AS text FROM events),
m AS (SELECT *, bool_or(is_space) OVER (PARTITION BY line_id) AS spaced, sum(is_space::INT) OVER (PARTITION BY line_id ORDER BY pos) AS gap FROM e)
SELECT line_id, CAST(CASE WHEN spaced THEN gap ELSE pos END AS BIGINT) AS word_no, min_by(id, pos) AS id, string_agg(text, '' ORDER BY pos) AS text FROM m WHERE NOT is_space GROUP BY line_id, 2""")
def alto_word_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are strings of a user's line, clicks the spaces."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("pos"), (F.col("event_type") == "click").alias("is_space"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("text"))
    return lines.merge_strings(e)


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(file, phys, link, logi) from suppliers as files and nations as logical divisions."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = lambda c: F.col(c).cast("string")
    some = lambda c, when: F.when(when, F.array(key(c))).otherwise(F.array().cast("array<string>"))
    file = s.select(key("s_suppkey").alias("file_id"), F.col("s_name").alias("href"), some("s_nationkey", F.col("s_acctbal") > 5000).alias("dmdids"), F.array(F.lit("1")).alias("grp_dmdids"), F.col("s_suppkey").alias("doc_ord"))
    phys = s.select(F.concat(F.lit("p"), key("s_suppkey")).alias("div_id"), key("s_suppkey").alias("file_id"))
    link = s.select(key("s_nationkey").alias("log_id"), F.concat(F.lit("p"), key("s_suppkey")).alias("phys_id"), F.col("s_suppkey").alias("doc_ord"))
    logi = n.select(key("n_nationkey").alias("div_id"), some("n_regionkey", F.col("n_regionkey") > 1).alias("dmdids"), F.when(F.col("n_regionkey") != 3, F.col("n_name")).alias("type"), F.col("n_nationkey").alias("doc_ord"))
    return file, phys, link, logi


@register("""SELECT s_name AS href, d AS dmd_id, r_name AS value FROM (SELECT s_name, CASE WHEN n_regionkey > 1 THEN n_regionkey WHEN s_acctbal > 5000 THEN s_nationkey ELSE 1 END AS d FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey) LEFT JOIN region ON r_regionkey = d""")
def mets_mods_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mets.file_dmds(*_manifest(spark, sf_dir))
    dmd = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("dmd_id"), F.col("r_name").alias("value"))
    values = mets.dmd_values(found, dmd)
    return found.join(values, "href").select("href", F.col("dmdids")[0].cast("int").alias("dmd_id"), "value")


@register("""WITH l AS (SELECT n_nationkey AS o, n_regionkey AS d, CASE WHEN n_regionkey <> 3 THEN n_name END AS t FROM nation), f AS (SELECT d, min_by(t, o) AS t FROM l WHERE t IS NOT NULL AND d > 1 GROUP BY d)
SELECT s_name AS href, coalesce(l.t, CASE WHEN s_acctbal > 5000 THEN own.t END) AS value FROM supplier LEFT JOIN l ON l.o = s_nationkey LEFT JOIN f own ON own.d = s_nationkey""")
def mets_div_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mets.file_attribute(*_manifest(spark, sf_dir), "type")


@register('SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "order" FROM orders')
def corpus_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mets.renumber(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("doc_ord")), "o_custkey").select("o_custkey", "o_orderkey", "order")


@register("SELECT conv_id AS dmd_id, turn AS doc_ord, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def corpus_dmd_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mets.first_of_each(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dmd_id"), F.col("turn").alias("doc_ord"), "text"))


@register("SELECT doc_id, 'urn:nbn:de:abc:3:1-' || doc_id || '-p1-1' AS identifier, 'deu,lat' AS languages FROM documents")
def urn_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("urn+nbn+de+abc+3+1-"), F.col("doc_id").cast("string"), F.lit("-p1-1_deu+lat.gt.xml"))
    r = names.urn_resource(name)
    return table(spark, sf_dir, "documents").select("doc_id", r["identifier"].alias("identifier"), F.array_join(r["languages"], ",").alias("languages"))


@register("SELECT 'x_' || d.s_name || '_page.xml' AS data_name, min(i.s_name) || '.jpg' AS image_name, count(DISTINCT i.s_name) AS n_images FROM supplier d JOIN supplier i ON contains('x_' || d.s_name || '_page.xml', i.s_name) GROUP BY d.s_name")
def image_match_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return matching.match_images(s.select(F.concat(F.lit("x_"), "s_name", F.lit("_page.xml")).alias("data_name")), s.select(F.concat("s_name", F.lit(".jpg")).alias("image_name")))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@register(f"""WITH t AS (SELECT conv_id, turn, {tokens_sql("text")} AS t FROM conversations WHERE text IS NOT NULL)
SELECT 'c' || conv_id AS path, count(CASE WHEN len(t) > 0 THEN 1 END) AS n_lines, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS n_words, string_agg(array_to_string(t, ' '), ' ' ORDER BY turn) AS text FROM t WHERE len(t) > 0 GROUP BY conv_id""")
def page_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are written as layout documents, a line for each turn, and parsed again."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    word = lambda t: F.concat(F.lit('<String CONTENT="'), _escaped(t), F.lit('" HPOS="1" VPOS="1" WIDTH="9" HEIGHT="9"/>'))
    line = F.concat(F.lit("<TextLine>"), F.array_join(F.transform(text.tokens(F.col("text")), word), "<SP/>"), F.lit("</TextLine>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "")
    whole = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Layout><Page ID="p"><PrintSpace><TextBlock>'), body, F.lit("</TextBlock></PrintSpace></Page></Layout></alto>"))
    documents = c.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path")).agg(whole.alias("content"))
    words = page_source.parse(documents).where("not is_space")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item_no", "text"))), lambda s: s["text"]), " ")
    return words.groupBy("path").agg(F.countDistinct("line_no").alias("n_lines"), F.count("*").alias("n_words"), joined.alias("text"))
