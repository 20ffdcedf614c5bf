from folioscore.sources import pages

ALTO = '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page ID="p1"><PrintSpace><ComposedBlock><TextBlock ID="b"><TextLine ID="l"><String ID="s" CONTENT="a&amp;b" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"/><SP/></TextLine></TextBlock></ComposedBlock></PrintSpace></Page></Layout></alto>'
LINE = '<TextLine id="{0}"><Coords points="0,0 1,0 1,1"/><TextEquiv index="1"><Unicode>second</Unicode></TextEquiv><TextEquiv index="0"><Unicode>{0}</Unicode></TextEquiv></TextLine>'
PAGE = (
    '<pc:PcGts xmlns:pc="x"><pc:Page imageFilename="i.jpg"><pc:ReadingOrder><pc:RegionRefIndexed index="1" regionRef="r2"/><pc:RegionRefIndexed index="0" regionRef="r3"/></pc:ReadingOrder>'
    + "".join(f'<TextRegion id="r{k}">{LINE.format(f"t{k}")}</TextRegion>' for k in (1, 2, 3))
    + "</pc:Page></pc:PcGts>"
)


def test_alto(spark):
    rows = pages.document_rows("a", ALTO)
    assert [(r["text"], r["is_space"]) for r in rows] == [("a&b", False), ("", True)]
    assert rows[0]["polygon"][2] == {"x": 4.0, "y": 6.0}


def test_page_reading_order_and_least_index():
    assert [r["text"] for r in pages.document_rows("p", PAGE)] == ["t3", "t2", "t1"]


def test_errors_texts_and_empty(spark, tmp_path):
    assert pages.document_rows("x", "<alto>")[0]["error"]
    assert pages.document_rows("x", "<foo/>")[0]["error"] == "unknown root foo"
    assert [r["text"] for r in pages.document_rows("t", b"\xef\xbb\xbfone \ntwo")] == ["one", "two"]
    assert pages.document_rows("n", None) == []
    df = spark.createDataFrame([("a", ALTO), ("p", PAGE), ("e", "<"), ("n", None)], "path string, content string")
    got = pages.parse(df)
    assert got.count() == 6 and got.where("error is not null").count() == 1
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "q.xml").write_text(PAGE)
    assert pages.read(spark, str(tmp_path)).count() == 3
    assert [r["stem"] for r in pages.candidates(spark, str(tmp_path)).collect()] == ["q"]
    pages.write_lines(pages.read(spark, str(tmp_path)), str(tmp_path / "out"), ["region_no"])
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_rows_leave_the_parser_in_bounded_batches(spark):
    import pyarrow as pa

    texts = ["one\ntwo\n" + "x" * 100] * 999 + [None]
    given = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(1000)]), pa.array(texts)], names=["path", "content"])
    taken = []
    rows = lambda p, c: taken.append(p) or pages.document_rows(p, c)
    by_rows = pages.in_batches([given], rows, pages.ARROW, most=30)
    first = next(by_rows)
    assert first.num_rows == 30 and len(taken) == 10  # neither a batch for each document nor all at once
    by_chars = list(pages.in_batches([given], pages.document_rows, pages.ARROW, chars=1100))
    assert max(b.num_rows for b in by_chars) == 30
    want = [r for p, c in zip(given.column(0).to_pylist(), texts, strict=True) for r in pages.document_rows(p, c)]
    assert pa.Table.from_batches([first, *by_rows]).equals(pa.Table.from_pylist(want, pages.ARROW)) and pa.Table.from_batches(by_chars).num_rows == len(want)


def test_polygons_keep_nulls_and_empty_ones():
    given = [None, [], [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": None}], None]
    assert pages.polygons(given).to_pylist() == given and pages.polygons(given).type == pages.ARROW.field("polygon").type
