"""Page layout documents (ALTO, PAGE) and plain texts as flat rows of words and lines.

Rows: (path, format, page_id, region_id, region_no, line_id, line_no, item_id,
item_no, is_space, text, polygon, error), one per word, space element, or line
without words; numbers are the document's own order, regions by the reading
order where there is one, the unlisted last. Tags are matched by their local
names, so any namespace version and prefix will do. A document that can't be
parsed is one row with its error, and nothing else of it.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, format string, page_id string, region_id string, region_no int, line_id string, line_no int, "
    "item_id string, item_no int, is_space boolean, text string, polygon array<struct<x: double, y: double>>, error string"
)
_TEXTS, _NUMBERS = ("path", "format", "page_id", "region_id", "line_id", "item_id", "text", "error"), ("region_no", "line_no", "item_no")
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ORDER = ("path", "format", "page_id", "region_id", "region_no", "line_id", "line_no", "item_id", "item_no", "is_space", "text", "polygon", "error")
ARROW = pa.schema([(c, pa.string() if c in _TEXTS else pa.int32() if c in _NUMBERS else pa.bool_() if c == "is_space" else pa.list_(_POINT)) for c in _ORDER])


@lru_cache(4096)
def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _tag(e: ET.Element) -> str:
    return _local(e.tag)


def _below(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x.tag) in names and x is not e]


def _children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e if _local(x.tag) in names]


def _box(e: ET.Element) -> list[dict] | None:
    try:
        x, y, w, h = (float(e.get(k)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
    except (TypeError, ValueError):
        return None
    return [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def _points(e: ET.Element) -> list[dict]:
    coords = _children(e, "Coords")
    if not coords:
        raise ValueError(f"{e.get('id')} has no Coords")
    out = []
    for s in (coords[0].get("points") or "").split():
        a, b = s.split(",")
        out.append({"x": float(int(a)), "y": float(int(b))})
    if len(out) < 3:
        raise ValueError(f"{e.get('id')} has fewer than three points")
    return out


def _equivalent(e: ET.Element) -> tuple[str, int]:
    """(text of the least index, as strings go; how many have text)."""
    found = []
    for t in _children(e, "TextEquiv"):
        text = "".join(u.text or "" for u in _children(t, "Unicode")).replace("\n", " ").strip()
        if text:
            found.append((t.get("index") or "", len(found), text))
    return (min(found)[2], len(found)) if found else ("", 0)


def alto_rows(root: ET.Element) -> Iterator[dict]:
    pages = _below(root, "Page")
    if not pages:
        raise ValueError("no Page")
    for r, block in enumerate(_below(pages[0], "TextBlock")):
        for n, line in enumerate(_children(block, "TextLine")):
            for k, item in enumerate(_children(line, "String", "SP")):
                yield {"page_id": pages[0].get("ID"), "region_id": block.get("ID"), "region_no": r, "line_id": line.get("ID"), "line_no": n, "item_id": item.get("ID"), "item_no": k, "is_space": _tag(item) == "SP", "text": item.get("CONTENT") or "", "polygon": _box(item)}


def reading_order(page: ET.Element) -> dict[str, int]:
    out: dict[str, int] = {}
    for order in _below(page, "ReadingOrder")[:1]:
        for ref in _below(order, "RegionRefIndexed"):
            if re.fullmatch(r"\s*[+-]?\d+\s*", ref.get("index") or ""):
                out[ref.get("regionRef")] = int(ref.get("index"))
    return out


def page_rows(root: ET.Element) -> Iterator[dict]:
    pages = _below(root, "Page")
    if len(pages) != 1:
        raise ValueError(f"{len(pages)} Page elements")
    order = reading_order(pages[0])
    regions = _below(pages[0], "TextRegion") + _below(pages[0], "TableCell")
    regions = sorted(enumerate(regions), key=lambda p: (order.get(p[1].get("id"), float("inf")), p[0]))
    for r, (_, region) in enumerate(regions):
        for n, line in enumerate(_children(region, "TextLine")):
            own, variants = _equivalent(line)
            words = [(w, _equivalent(w)[0]) for w in _children(line, "Word")]
            words = [(w, t) for w, t in words if t]
            same = {"page_id": pages[0].get("imageFilename"), "region_id": region.get("id"), "region_no": r, "line_id": line.get("id"), "line_no": n, "is_space": False}
            if words and variants <= 1:
                for k, (w, t) in enumerate(words):
                    yield same | {"item_id": w.get("id"), "item_no": k, "text": t, "polygon": _points(w)}
            elif own:
                yield same | {"item_id": None, "item_no": 0, "text": own, "polygon": _points(line)}


def document_rows(path: str, content: bytes | str | None) -> list[dict]:
    raw = content.encode() if isinstance(content, str) else bytes(content or b"")
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    kind = "text"
    try:
        if raw.lstrip().startswith(b"<"):
            root = ET.fromstring(raw)
            kind = _tag(root).lower()
            if kind not in ("alto", "pcgts"):
                raise ValueError(f"unknown root {_tag(root)}")
            rows = list(alto_rows(root) if kind == "alto" else page_rows(root))
        else:
            rows = [{"line_no": n, "region_no": 0, "item_no": 0, "is_space": False, "text": s.strip()} for n, s in enumerate(raw.decode().splitlines())]
        return [{"path": path, "format": kind} | r for r in rows]
    except (ET.ParseError, ValueError) as e:
        return [{"path": path, "format": kind, "error": str(e)}]


def polygons(given: list[list[dict] | None]) -> pa.Array:
    """Lists of points as an Arrow array, built from flat columns."""
    ends, at = [0], 0
    for p in given:
        at += len(p) if p else 0
        ends.append(at)
    xs, ys = (pa.array([q[k] for p in given if p for q in p], pa.float64()) for k in "xy")
    none = pa.array([p is None for p in given], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([xs, ys], fields=list(_POINT)), mask=none)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; a column that a row lacks is null."""
    columns = []
    for f in schema:
        values = [r.get(f.name) for r in rows]
        columns.append(polygons(values) if f.name == "polygon" else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def in_batches(batches: Iterable[pa.RecordBatch], rows: Callable[..., list[dict]], schema: pa.Schema, most: int = 4096, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows that a function gives for each row of batches, some `most` to a batch or those of so many characters: neither one batch for each document nor all of a batch's at once."""
    out: list[dict] = []
    size = 0
    for b in batches:
        for i in range(b.num_rows):
            given = [c[i].as_py() for c in b.columns]
            out += rows(*given)
            size += sum(len(v) for v in given if isinstance(v, str | bytes))
            if len(out) >= most or size >= chars:
                yield batch_of(out, schema)
                out, size = [], 0
    if out:
        yield batch_of(out, schema)


def parse(documents: DataFrame) -> DataFrame:
    """The rows of documents (path, content)."""
    return documents.select("path", "content").mapInArrow(lambda batches: in_batches(batches, document_rows, ARROW), SCHEMA)


def read(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """The rows of all documents below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return parse(files)


def candidates(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """(path, name, stem) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def write_lines(lines: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """A folder of text files with one line per row, in order over all files."""
    lines.orderBy(*order).select(F.col(text).alias("value")).write.text(path)
