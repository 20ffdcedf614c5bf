import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.functions import images
from folioscore.operators import dimensions, evaluate, metrics, mets
from folioscore.sources import manifests, nodes

METS = """<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink">
<mets:dmdSec ID="A"><mets:mdWrap><mets:xmlData><mods:mods><mods:language><mods:languageTerm type="code">ger</mods:languageTerm></mods:language></mods:mods></mets:xmlData></mets:mdWrap></mets:dmdSec>
<mets:dmdSec ID="B"><mods:mods><mods:language><mods:languageTerm type="code">eng</mods:languageTerm></mods:language></mods:mods></mets:dmdSec>
<mets:fileSec><mets:fileGrp USE="X" DMDID="A"><mets:file ID="F1"><mets:FLocat xlink:href="one.xml"/></mets:file><mets:file ID="F2"><mets:FLocat xlink:href="two.xml"/></mets:file><mets:file ID="F3"/></mets:fileGrp></mets:fileSec>
<mets:structMap TYPE="PHYSICAL"><mets:div ID="P1"><mets:fptr FILEID="F1"/></mets:div></mets:structMap><mets:structMap TYPE="LOGICAL"><mets:div ID="L" TYPE="Volume"><mets:div ID="L1" DMDID="B Z" LABEL="part"/></mets:div></mets:structMap>
<mets:structLink><mets:smLink xlink:from="L1" xlink:to="P1"/><mets:smLink xlink:from="L" xlink:to="P1"/></mets:structLink></mets:mets>"""


def test_links_beat_groups_and_damaged_manifests_are_errors(spark):
    rows = manifests.parse(spark.createDataFrame([("m", METS), ("d", "<mets"), ("n", None)], "path string, content string"))
    assert rows.where("kind = 'error'").count() == 2
    tables = manifests.tables(rows)
    found = mets.dmd_values(mets.file_dmds(*tables), manifests.mods_values(rows, "language"))
    assert {tuple(r) for r in found.collect()} == {("one.xml", "eng"), ("two.xml", "ger")}
    kinds = mets.file_attribute(*tables, "value")
    assert {tuple(r) for r in kinds.collect()} == {("one.xml", "Volume"), ("two.xml", None)}
    with pytest.raises(ValueError):
        manifests.mods_path("nothing")


def test_specs_are_compiled_or_refused_before_anything_runs():
    names = lambda s, **k: [d.name for d in dimensions.parse(s, **k)[0]]
    assert names("directory, directory:all,directory:2,directory:-1,type,metadata:a b") == ["directory", "directory", "directory_2", "directory_-1", "type", "metadata_a b"]
    assert names("mods:dateIssued:decade+mods:.//mods:genre+mods:.//mods:originInfo/mods:dateIssued:century+mets:Type") == ["mods_dateIssued_decade", "mods_custom", "mods_custom_century", "mets_div_type"]
    assert dimensions.parse("a:b,type", strict=False)[0][0].name == "type" and dimensions.parse("type+directory")[1]
    assert dimensions.legacy_mods("genre, title") == "mods:genre,mods:title"
    for bad in ("foo", "directory:x", "metadata", "pattern", "pattern:(", "pattern:a:x", "pattern:a:1", "mods", "mods:foo", "mods:genre:month", "mets", ""):
        with pytest.raises(ValueError):
            dimensions.parse(bad)
    for needs in ("mods:genre", "mets:type"):
        with pytest.raises(ValueError):
            dimensions.parse(needs, manifest=False)


LINE = '<TextLine id="{0}"><Coords points="{1}"/>{2}<TextEquiv><Unicode>{3}</Unicode></TextEquiv></TextLine>'


def page(*regions):
    return '<PcGts xmlns="x"><Page imageFilename="i" imageWidth="30" imageHeight="40">' + "".join(f'<TextRegion id="r{k}"><Coords points="0,0 20,0 20,20 0,20"/>{r}</TextRegion>' for k, r in enumerate(regions)) + "</Page></PcGts>"


def test_pages_have_levels_their_default_shape_and_rules():
    word = '<Word id="w"><Coords points="1,1 3,1 3,3"/><TextEquiv><Unicode>word</Unicode></TextEquiv></Word>'
    rows = nodes.tree_rows("p", page(LINE.format("l", "1,1 9,1 9,9", word, "line"), "<TextEquiv><Unicode>own</Unicode></TextEquiv>"))
    assert [(r["level"], r.get("text"), r["ord"]) for r in rows] == [(7, None, []), (5, None, [0]), (3, None, [0, 0]), (2, "word", [0, 0, 0]), (5, "own", [1])]
    assert len(rows[0]["polygon"]) == 8
    empty = nodes.tree_rows("p", page())
    assert [r["level"] for r in empty] == [7] and empty[0]["polygon"][2] == {"x": 30.0, "y": 40.0}
    for bad in (page(LINE.format("l", "50,50 60,50 60,60", "", "x")), page(LINE.format("l", "1,1 2,2", "", "x")), page(LINE.format("l", "1,1 9,1 9,9", word.replace("word</U", "</U"), "x")), "<PcGts/>", "<other/>", "plain"):
        assert nodes.tree_rows("p", bad)[0]["error"]


ALTO = '<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Tags><OtherTag ID="{0}" VALUE="{1}"/></Tags><Layout><Page ID="p" WIDTH="9" HEIGHT="9"><PrintSpace><TextBlock ID="b" HPOS="0" VPOS="0" WIDTH="90" HEIGHT="90"><TextLine ID="l" HPOS="0" VPOS="0" WIDTH="90" HEIGHT="9"><String ID="s1" CONTENT="(Sand" HPOS="5" VPOS="1" WIDTH="9" HEIGHT="5"/><SP/><String ID="s2" CONTENT="Gate" HPOS="20" VPOS="1" WIDTH="9" HEIGHT="5"/><String ID="s3" CONTENT=")," HPOS="30" VPOS="1" WIDTH="2" HEIGHT="5"/><SP/><String ID="s4" CONTENT="7th" HPOS="70" VPOS="1" WIDTH="9" HEIGHT="5"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'


def test_alto_words_subject_and_frames():
    rows = nodes.tree_rows("a", ALTO.format("ulb_groundtruth_type", "article"))
    assert [r["text"] for r in rows if r["level"] == 2] == ["(Sand", "Gate),", "7th"] and rows[0]["subject"] == "article"
    frame = lambda content: nodes.frame_of("f", content)
    assert frame(ALTO.format("x", "y"))["frame"] == {"x0": 5, "y0": 1, "x1": 32, "y1": 6}
    assert frame(ALTO.format("ulb_groundtruth_points", "1,2 9,2 9,8 1,8"))["frame"] == {"x0": 1, "y0": 2, "x1": 9, "y1": 8}
    assert frame(page("<Border/>").replace("<Border/>", ""))["error"] and "frame" not in frame("plain")
    border = '<PcGts xmlns="x"><Page><Border><Coords points="1,1 7,1 7,7"/></Border></Page></PcGts>'
    assert frame(border)["frame"]["x1"] == 7


def test_cropping_drops_emptied_parents_and_resizes_the_rest():
    got = nodes.cropped("a", ALTO.format("x", "y"), [(0, 0), (40, 0), (40, 20), (0, 20)])
    assert dict(got["removed"]) == {"String": 1} and dict(got["resized"]) == {"TextLine": 1, "TextBlock": 1}
    left = nodes.tree_rows("a", got["content"])
    assert [r["text"] for r in left if r["level"] == 2] == ["(Sand", "Gate),"] and left[2]["polygon"][2] == {"x": 32.0, "y": 6.0}
    none = nodes.cropped("a", ALTO.format("x", "y"), [(200, 200), (300, 200), (300, 300)])
    assert dict(none["removed"])["TextBlock"] == 1 and [r["level"] for r in nodes.tree_rows("a", none["content"])] == [7]
    assert nodes.cropped("a", "<", [(0, 0), (1, 0), (1, 1)])["error"]


def test_training_lines_are_in_order_without_marks():
    word = '<Word id="w{0}"><Coords points="{1},0 {2},0 {2},9"/><TextEquiv><Unicode>{3}</Unicode></TextEquiv></Word>'
    words = word.format(1, 50, 60, "second") + word.format(2, 10, 20, "‏first‎")
    rows = nodes.training_rows("p", page(LINE.format("l1", "1,1 9,1 9,9", words, "x y"), LINE.format("l2", "1,1 9,1 9,9", "", "ab"), '<TextLine id="l3"><TextEquiv><Unicode>no place</Unicode></TextEquiv></TextLine>'), 3)
    assert [(r["element_id"], r["words"], r["valid"]) for r in rows] == [("l1", ["first", "second"], True), ("l3", [], False)]
    assert nodes.training_rows("p", page(LINE.format("l", "1,1 9,1 9,9", words, "")), 1)[0]["error"]
    assert nodes.training_rows("a", ALTO.format("x", "y"), 1)[0]["words"] == ["(Sand", "Gate", "),", "7th"]


def test_transcription_keeps_empty_lines_and_drops_what_the_frame_excludes(spark):
    word = '<Word id="w{0}"><Coords points="{1},1 {2},1 {2},3 {1},3"/><TextEquiv><Unicode>t{0}</Unicode></TextEquiv></Word>'
    doc = page(LINE.format("a", "1,1 9,1 9,9", word.format(1, 1, 3) + word.format(2, 14, 16), ""), LINE.format("b", "1,1 9,1 9,9", "", ""), LINE.format("c", "1,1 9,1 9,9", word.format(3, 14, 16), ""))
    tree = nodes.nodes(spark.createDataFrame([("p", doc), ("bad", "<")], "path string, content string"))
    frames = spark.createDataFrame([("p", (0.0, 0.0, 10.0, 10.0))], "path string, frame struct<x0: double, y0: double, x1: double, y1: double>")
    assert [tuple(r) for r in evaluate.page_texts(tree).collect()] == [("p", "t1 t2  t3", 0)]
    assert [tuple(r) for r in evaluate.page_texts(tree, frames).collect()] == [("p", "t1 ", 2)]


def test_preconditions(spark, tmp_path):
    none = spark.createDataFrame([], "path string")
    with pytest.raises(RuntimeError, match="missing evaluation data"):
        evaluate.require(none)
    with pytest.raises(RuntimeError):
        evaluate.require(none, str(tmp_path / "missing"))
    (tmp_path / "b.xml").write_text("<a/>")
    (tmp_path / "a.xml").write_text("<a/>")
    listed = evaluate.require(evaluate.by_path(evaluate.listing(spark, str(tmp_path))), str(tmp_path))
    assert [r["path"].rpartition("/")[2] for r in listed.collect()] == ["a.xml", "b.xml"]


def test_dictionary_metric_counts_unknown_words(spark):
    pairs = spark.createDataFrame([(1, "ein Hauſ uͤber"), (2, ""), (3, "x y")], "doc_id int, candidate string")
    words = spark.createDataFrame([("ein",), ("über",)], "word string")
    got = {r["doc_id"]: (r["DictLT"]["value"], r["DictLT"]["n_ref"]) for r in metrics.score_dictionary(pairs, words).collect()}
    assert got == {1: (66.67, 3), 2: (100.0, 0), 3: (0.0, 2)}


def test_grey_images():
    image = np.full((20, 30), 200, np.uint8)
    image[5:9, 4:9] = 10
    assert images.grey_range(image) == (184, 216) and images.grey_range(np.zeros((2, 2), np.uint8)) == (239, 255)
    best = max(range(255), key=lambda t: (lambda a, b: len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0)(image[image <= t].astype(float), image[image > t].astype(float)))
    assert images.otsu(image) == best and (images.binarise(image) == 0).sum() == 20
    assert images.crop(image, [(4, 5), (9, 5), (9, 9)]).shape == (4, 5) and images.pad(image, 2).shape == (24, 34) and images.pad(image, 2)[0, 0] == 200
    assert images.char_boxes(" aë ", 5, 6) == ["a 0 0 5 6 0", "ë 0 0 5 6 0", "\t 0 0 5 6 0"] and images.char_boxes("qͤ", 1, 1)[0].startswith("qͤ ") and images.char_boxes(" ", 1, 1) == []


def test_positions_are_counted_over_ranges(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(100000)).alias("a"), "id")
    rows = manifests.numbered(df, ["a", "id"], "n", ranges=7).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["a"], r["id"]))] == list(range(1, 1001))


def test_cropping_finds_one_hull_for_all_words_and_removes_each_word_once(monkeypatch):
    from folioscore.functions import geometry

    calls = []
    real = geometry.hull
    for module in (geometry, nodes):
        monkeypatch.setattr(module, "hull", lambda p: calls.append(1) or real(p))
    strings = "".join(f'<String ID="s{k}" CONTENT="w" HPOS="{k * 10}" VPOS="1" WIDTH="9" HEIGHT="5"/><SP/><SP ID="t{k}"/>' for k in range(500))
    doc = ALTO.format("x", "y").split("<String")[0] + strings + "</TextLine></TextBlock></PrintSpace></Page></Layout></alto>"
    got = nodes.cropped("a", doc, [(0, 0), (100, 0), (100, 20), (0, 20)])
    assert len(calls) == 1 and dict(got["removed"]) == {"String": 490}
    assert got["content"].count("SP ") == 510  # of the two spaces behind a word that goes, one stays


def test_middle_and_hull_are_as_numpy_and_the_other_form_have_them():
    from folioscore.functions import geometry

    rng = np.random.default_rng(1)
    for n in range(3, 12):
        for _ in range(30):
            p = rng.integers(0, 50, (n, 2)).astype(float)
            x, y = p.T
            u, v = np.roll(x, -1), np.roll(y, -1)
            cross = x * v - u * y
            want = (((x + u) * cross).sum() / (3 * cross.sum()), ((y + v) * cross).sum() / (3 * cross.sum())) if cross.sum() else (x.mean(), y.mean())
            assert nodes.middle([{"x": a, "y": b} for a, b in p.tolist()]) == want
            within = nodes.strictly(geometry.hull(p))
            for a, b in rng.integers(0, 50, (20, 2)).tolist():
                assert within(a, b) == geometry.strictly_in_hull(p, a, b)


def test_nodes_keep_numbers_of_their_documents(spark):
    df = spark.createDataFrame([("p", page(LINE.format("l", "1,1 9,1 9,9", "", "x")), 7), ("bad", "<", 5)], "path string, content string, removed int")
    got = nodes.nodes(df, "removed").groupBy("path").agg(F.max("removed").alias("removed"), F.count("removed").alias("n")).collect()
    assert {tuple(r) for r in got} == {("p", 7, 1), ("bad", 5, 1)}


def test_positions_agree_when_the_plan_for_the_sizes_reads_other_partitions(spark):
    given = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        df = spark.range(60000, numPartitions=7).select(F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(30000)).cast("string")).alias("a"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("w"))
        joined = df.join(spark.range(60000, numPartitions=3).withColumnRenamed("id", "other"), F.col("id") == F.col("other"))
        rows = manifests.numbered(joined, ["a", "id"], "n").select("a", "id", "n", "w").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["a"], r["id"]))] == list(range(1, 60001))


def test_texts_read_in_one_parse_are_those_of_the_nodes(spark, monkeypatch):
    word = '<Word id="w{0}"><Coords points="{1},1 {2},1 {2},3 {1},3"/><TextEquiv><Unicode>t{0}</Unicode></TextEquiv></Word>'
    odd = '<Word id="v"><Coords points="1,1 9,1 9,3 8,3 7,4 6,3 5,4 4,3 3,4"/><TextEquiv><Unicode>odd</Unicode></TextEquiv></Word>'
    doc = page(LINE.format("a", "1,1 9,1 9,9", word.format(1, 1, 3) + word.format(2, 14, 16) + odd, ""), LINE.format("b", "1,1 9,1 9,9", "", ""), LINE.format("c", "1,1 9,1 9,9", word.format(3, 14, 16), ""), LINE.format("d", "1,1 9,1 9,9", "", "own"), "<TextEquiv><Unicode>region</Unicode></TextEquiv>")
    docs = {"p": doc, "bad": "<", "none": None, "alto": ALTO.format("x", "y"), "plain": "text", "empty": page()}
    df = spark.createDataFrame(list(docs.items()), "path string, content string")
    frame = {"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 10.0}
    frames = spark.createDataFrame([(p, tuple(frame.values())) for p in docs], "path string, frame struct<x0: double, y0: double, x1: double, y1: double>")
    for given, box in ((None, None), (frames, frame)):
        want = {r["path"]: (r["text"], r["removed"]) for r in evaluate.page_texts(nodes.nodes(df), given).collect()}
        assert {p: t for p, c in docs.items() if (t := nodes.page_text(p, c, box)) is not None} == want and len(want) == 3


def test_scores_parse_every_document_once(spark):
    line = LINE.format("l", "1,1 9,1 9,9", '<Word id="w"><Coords points="1,2 3,2 3,4"/><TextEquiv><Unicode>word</Unicode></TextEquiv></Word><Word id="x"><Coords points="90,2 93,2 93,4"/><TextEquiv><Unicode>outside</Unicode></TextEquiv></Word>', "")
    candidates = spark.createDataFrame([("in/a.xml", page(line)), ("in/b.xml", page(line)), ("in/c.xml", "<")], "path string, content string")
    truth = spark.createDataFrame([("gt/a.art.gt.xml", page(LINE.format("l", "1,1 9,1 9,9", "", "word"))), ("gt/b.gt.xml", "<"), ("gt/c.gt.xml", page(LINE.format("l", "1,1 9,1 9,9", "", "word")))], "path string, content string")
    matched, _ = evaluate.entries(candidates, truth, F.lit("in"))
    assert matched.count() == 3
    scored = evaluate.scores(matched, candidates, truth, ["BoWs"])
    assert [(r["path"], r["reference"], r["candidate"], r["removed"], r["BoWs"]["value"]) for r in scored.collect()] == [("in/a.xml", "word", "word", 1, 100.0)]
    whole = evaluate.scores(matched, candidates, truth, ["BoWs"], ignore_geometry=True).collect()
    assert [(r["candidate"], r["removed"]) for r in whole] == [("word outside", 0)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("read_groundtruth(") == 1 and plan.count("read_candidate(") == 1 and "MapInArrow" not in plan
