"""Page layout documents as trees: a row for each page, region, line and word, and what is read off them.

Nodes: (path, format, ord, id, parent_id, tag, level, subject, text, polygon,
error), in document order by `ord`, the numbers of a node and its parents from
the page on, regions by the reading order.  A node's own text is null where its
children's count instead.  A document that breaks a rule (no single page, a
region or line without three points, a line whose centre is outside its region's
hull) is one row with the error.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.geometry import hull, parse_polygon, strictly_in_hull
from .pages import _below, _box, _children, _equivalent, _points, _tag, in_batches, reading_order

LEVELS = {"Glyph": 1, "Word": 2, "String": 2, "TextLine": 3, "TableCell": 4, "TextRegion": 5, "TextBlock": 5, "ComposedBlock": 5, "TableRegion": 6, "Page": 7}
WORD, LINE, REGION, PAGE = 2, 3, 5, 7
SCHEMA = "path string, format string, ord array<int>, id string, parent_id string, tag string, level int, subject string, text string, polygon array<struct<x: double, y: double>>, error string"
ARROW = pa.schema([("path", pa.string()), ("format", pa.string()), ("ord", pa.list_(pa.int32())), ("id", pa.string()), ("parent_id", pa.string()), ("tag", pa.string()), ("level", pa.int32()), ("subject", pa.string()), ("text", pa.string()), ("polygon", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("error", pa.string())])


def level(tag: Column) -> Column:
    """The number of a tag's level; 0 for others."""
    out = F.lit(0)
    for name, number in LEVELS.items():
        out = F.when(tag == name, number).otherwise(out)
    return out


def centroid(polygon: list[dict]) -> tuple[float, float]:
    """The same as `geometry.centroid` for one polygon, added in the same order."""
    xs, ys = [p["x"] for p in polygon], [p["y"] for p in polygon]
    whole = sx = sy = 0.0
    for a, b, u, v in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True):
        c = a * v - u * b
        whole += c
        sx += (a + u) * c
        sy += (b + v) * c
    return (sx / (3 * whole), sy / (3 * whole)) if whole else (sum(xs) / len(xs), sum(ys) / len(ys))


def middle(polygon: list[dict]) -> tuple[float, float]:
    """The area-weighted centre of a polygon, the mean of its corners where there is no area."""
    if len(polygon) < 8:  # numpy adds so few in order, too
        return centroid(polygon)
    x, y = (np.array([p[k] for p in polygon], float) for k in "xy")
    u, v = np.roll(x, -1), np.roll(y, -1)
    cross = x * v - u * y
    area = cross.sum()
    return (float(((x + u) * cross).sum() / (3 * area)), float(((y + v) * cross).sum() / (3 * area))) if area else (float(x.mean()), float(y.mean()))


def inside(polygon: list[dict], other: list[dict]) -> bool:
    """Whether the centre of `other` lies strictly in the hull of a polygon."""
    return strictly_in_hull(np.array([(p["x"], p["y"]) for p in polygon]), *middle(other))


def strictly(area: np.ndarray) -> Callable[[float, float], bool]:
    """Whether a point lies strictly inside of a hull, as `geometry.strictly_in_hull` tells, for many points of one hull."""
    edges = [(a, b, u - a, v - b) for (a, b), (u, v) in zip(area.tolist(), np.roll(area, -1, 0).tolist(), strict=True)] if len(area) > 2 else []
    return lambda x, y: bool(edges) and all(dx * (y - b) - dy * (x - a) > 0 for a, b, dx, dy in edges)


def _rectangle(x0: float, y0: float, x1: float, y1: float) -> list[dict]:
    return [{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def page_nodes(root: ET.Element) -> Iterator[dict]:
    pages = _below(root, "Page")
    if len(pages) != 1:
        raise ValueError(f"{len(pages)} Page elements")
    page = pages[0]
    order = reading_order(page)
    regions = _below(page, "TextRegion") + _below(page, "TableCell")
    regions = [r for _, r in sorted(enumerate(regions), key=lambda p: (order.get(p[1].get("id"), float("inf")), p[0]))]
    whole = [p for r in regions for p in _points(r)] or _rectangle(0, 0, int(page.get("imageWidth") or 0), int(page.get("imageHeight") or 0))
    name = page.get("imageFilename")
    yield {"ord": [], "id": name, "tag": "Page", "level": PAGE, "polygon": whole}
    for r, region in enumerate(regions):
        lines = _below(region, "TextLine")
        own = _equivalent(region)[0]
        shape = _points(region)
        yield {"ord": [r], "id": region.get("id"), "parent_id": name, "tag": _tag(region), "level": LEVELS[_tag(region)], "text": None if lines else own or None, "polygon": shape}
        for n, line in enumerate(lines):
            here = _points(line)
            if not inside(shape, here):
                raise ValueError(f"{line.get('id')} isn't inside of {region.get('id')}")
            own, variants = _equivalent(line)
            words = _below(line, "Word") if variants <= 1 else []
            yield {"ord": [r, n], "id": line.get("id"), "parent_id": region.get("id"), "tag": "TextLine", "level": LINE, "text": None if words else own, "polygon": here}
            for k, word in enumerate(words):
                text = _equivalent(word)[0]
                if not text:
                    raise ValueError(f"{word.get('id')} has no text")
                yield {"ord": [r, n, k], "id": word.get("id"), "parent_id": line.get("id"), "tag": "Word", "level": WORD, "text": text, "polygon": _points(word)}


def alto_subject(root: ET.Element) -> str | None:
    """What a document says it is: the label of its first tag, else the value of the tag for it."""
    tags = _below(root, "OtherTag")
    return next((t.get("LABEL") for t in tags[:1] if t.get("LABEL")), None) or next((t.get("VALUE") for t in tags if t.get("ID") == "ulb_groundtruth_type"), None)


def line_words(line: ET.Element) -> list[tuple[ET.Element, str]]:
    """(first element, text) of a line's words: strings without a space element between them are one word if the line has any such element."""
    items = _children(line, "String", "SP")
    spaced = any(_tag(i) == "SP" for i in items)
    out: list[tuple[ET.Element, str]] = []
    join = False
    for i in items:
        if _tag(i) == "SP":
            join = False
        elif (i.get("CONTENT") or "").strip():
            out = [*out[:-1], (out[-1][0], out[-1][1] + i.get("CONTENT"))] if join else [*out, (i, i.get("CONTENT"))]
            join = spaced
    return out


def alto_nodes(root: ET.Element) -> Iterator[dict]:
    pages = _below(root, "Page")
    if not pages:
        raise ValueError("no Page")
    page = pages[0]
    blocks = _below(page, "TextBlock")
    size = [float(page.get(k) or 0) for k in ("WIDTH", "HEIGHT")]
    yield {"ord": [], "id": page.get("ID"), "tag": "Page", "level": PAGE, "subject": alto_subject(root), "polygon": _rectangle(0, 0, *size)}
    for r, block in enumerate(blocks):
        yield {"ord": [r], "id": block.get("ID"), "parent_id": page.get("ID"), "tag": "TextBlock", "level": REGION, "polygon": _box(block)}
        for n, line in enumerate(_children(block, "TextLine")):
            yield {"ord": [r, n], "id": line.get("ID"), "parent_id": block.get("ID"), "tag": "TextLine", "level": LINE, "polygon": _box(line)}
            for k, (e, text) in enumerate(line_words(line)):
                yield {"ord": [r, n, k], "id": e.get("ID"), "parent_id": line.get("ID"), "tag": "String", "level": WORD, "text": text, "polygon": _box(e)}


def _root(content: bytes | str | None) -> ET.Element:
    raw = content.encode() if isinstance(content, str) else bytes(content or b"")
    return ET.fromstring(raw.removeprefix(b"\xef\xbb\xbf"))


def tree_rows(path: str, content: bytes | str | None, root: ET.Element | None = None) -> list[dict]:
    """The nodes of a document, which may have been parsed already."""
    kind = None
    try:
        root = _root(content) if root is None else root
        kind = _tag(root).lower()
        if kind not in ("alto", "pcgts"):
            raise ValueError(f"unknown root {_tag(root)}")
        return [{"path": path, "format": kind} | n for n in (alto_nodes(root) if kind == "alto" else page_nodes(root))]
    except (ET.ParseError, ValueError, TypeError) as e:
        return [{"path": path, "format": kind, "error": str(e)}]


def _mapped(documents: DataFrame, rows: Callable[..., list[dict]], arrow: pa.Schema, schema: str, *more: str) -> DataFrame:
    return documents.select("path", "content", *more).mapInArrow(lambda batches: in_batches(batches, rows, arrow), schema)


def nodes(documents: DataFrame, *numbers: str) -> DataFrame:
    """The nodes of documents (path, content); columns of whole numbers are kept, in the first row of each document."""

    def rows(path: str, content: bytes | str | None, *kept: int | None) -> list[dict]:
        first, *others = tree_rows(path, content)
        return [first | dict(zip(numbers, kept, strict=True)), *others]

    arrow = pa.schema([*ARROW, *[(c, pa.int64()) for c in numbers]])
    return _mapped(documents.withColumns({c: F.col(c).cast("bigint") for c in numbers}), rows, arrow, ", ".join([SCHEMA, *[f"{c} bigint" for c in numbers]]), *numbers)


def frame_of(path: str, content: bytes | str | None, root: ET.Element | None = None) -> dict:
    """The box that a document's groundtruth covers: from its tag, its strings, or its lines, else its border; an error if a page has neither."""
    try:
        root = _root(content) if root is None else root
    except ET.ParseError:
        return {"path": path}  # a plain text has no frame
    points: list[tuple[int, int]] = []
    if _tag(root) == "alto":
        tag = next((t for t in _below(root, "OtherTag") if t.get("ID") == "ulb_groundtruth_points"), None)
        if tag is not None:
            p = [tuple(map(int, s.split(","))) for s in (tag.get("VALUE") or "").split()]
            points = [p[0], p[2]] if len(p) > 2 else []
        else:
            for s in _below(root, "String"):
                text = s.get("CONTENT") or ""
                if text.strip() and not text[0].isdecimal() and (box := _box(s)):
                    points += [(int(box[0]["x"]), int(box[0]["y"])), (int(box[2]["x"]), int(box[2]["y"]))]
    elif _tag(root).lower() == "pcgts":
        for name in ("TextLine", "Border"):
            for e in _below(root, name) if not points else ():
                for c in _children(e, "Coords"):
                    points += [tuple(map(int, s.split(","))) for s in (c.get("points") or "").split()]
        if not points:
            return {"path": path, "error": "no coordinates of page or lines"}
    if not points:
        return {"path": path}
    x, y = zip(*points, strict=True)
    return {"path": path, "frame": {"x0": min(x), "y0": min(y), "x1": max(x), "y1": max(y)}}


_FRAME = pa.struct([(k, pa.int32()) for k in ("x0", "y0", "x1", "y1")])


def frames(documents: DataFrame) -> DataFrame:
    """(path, frame, error) of documents: the box in the file's name, else what the content tells."""
    from ..functions.geometry import frame_from_name
    from ..functions.names import base_name

    found = _mapped(documents, lambda p, c: [frame_of(p, c)], pa.schema([("path", pa.string()), ("frame", _FRAME), ("error", pa.string())]), "path string, frame struct<x0: int, y0: int, x1: int, y1: int>, error string")
    named = frame_from_name(base_name(F.col("path")))
    return found.select("path", F.coalesce(named, "frame").alias("frame"), F.when(named.isNull(), F.col("error")).alias("error"))


def page_text(path: str, content: bytes | str | None, frame: dict | None = None, root: ET.Element | None = None) -> tuple[str, int] | None:
    """(text, removed) of one document as `evaluate.page_texts` gives them: the transcription in reading order and the number of words whose centre is outside of the frame; None for a document with an error."""
    rows = tree_rows(path, content, root)
    if rows[0].get("error") is not None:
        return None
    parts: dict[tuple[int, ...], list[str]] = {}
    removed = 0
    for r in rows:
        at, box = tuple(r["ord"]), r.get("polygon")
        if r["level"] == WORD:
            x, y = centroid(box) if frame is not None and box else (0, 0)
            if frame is None or (box and frame["x0"] < x < frame["x1"] and frame["y0"] < y < frame["y1"]):
                parts.setdefault(at[:2], []).append(r["text"])
            else:
                removed += 1
        elif r["level"] in (LINE, REGION, 4) and r.get("text") is not None:
            parts[at] = [r["text"]]
    return " ".join(" ".join(parts[k]) for k in sorted(parts)), removed


def _each(row: Callable[..., dict | None], kind: pa.DataType, columns: tuple[pa.Array, ...]) -> pa.Array:
    """A function's value for each row of columns, of which one row at a time is unpacked."""
    return pa.array([row(*[c[i].as_py() for c in columns]) for i in range(len(columns[0]))], kind)


_READ = pa.struct([("text", pa.string()), ("frame", _FRAME), ("error", pa.string())])
_TEXT = pa.struct([("text", pa.string()), ("removed", pa.int64())])


@F.arrow_udf(from_arrow_type(_READ))
def read_groundtruth(path: pa.Array, content: pa.Array) -> pa.Array:
    """(text, frame, error) of documents from one parse of each: the transcription, null for a document that breaks a rule, and what `frame_of` tells."""

    def one(p: str, c: bytes | str | None) -> dict:
        try:
            root = _root(c)
        except ET.ParseError:
            return {}
        found = frame_of(p, c, root)
        text = page_text(p, c, root=root)
        return {"text": text and text[0], "frame": found.get("frame"), "error": found.get("error")}

    return _each(one, _READ, (path, content))


@F.arrow_udf(from_arrow_type(_TEXT))
def read_candidate(path: pa.Array, content: pa.Array, frame: pa.Array) -> pa.Array:
    """(text, removed) of documents inside of their frames; null for a document that breaks a rule."""

    def one(p: str, c: bytes | str | None, f: dict | None) -> dict | None:
        text = page_text(p, c, f)
        return text and {"text": text[0], "removed": text[1]}

    return _each(one, _TEXT, (path, content, frame))


FILTERED = "path string, content string, removed map<string,int>, resized map<string,int>, error string"
_COUNTS = pa.map_(pa.string(), pa.int32())


def cropped(path: str, content: bytes | str | None, polygon: list[tuple[float, float]]) -> dict:
    """A document without the words outside of a polygon, nor the lines and regions that lose all of them; boxes of the others follow from what is left."""
    removed: dict[str, int] = {}
    resized: dict[str, int] = {}
    try:
        root = _root(content)
        alto = _tag(root) == "alto"
        if not alto and _tag(root).lower() != "pcgts":
            raise ValueError(f"unknown root {_tag(root)}")
        within = strictly(hull(np.array(polygon)))
        shape = _box if alto else _points

        def count(into: dict[str, int], e: ET.Element) -> None:
            into[_tag(e)] = into.get(_tag(e), 0) + 1

        def drop(parent: ET.Element, e: ET.Element) -> None:
            at = list(parent).index(e)
            parent.remove(e)
            count(removed, e)
            if alto and at < len(parent) and _tag(parent[at]) == "SP":
                parent.remove(parent[at])

        def keep(e: ET.Element) -> list[tuple[float, float]]:
            """The corners of what is left below an element."""
            if LEVELS[_tag(e)] == WORD:
                p = shape(e)
                return [(q["x"], q["y"]) for q in p] if p and within(*middle(p)) else []
            left: list[tuple[float, float]] = []
            stay: list[ET.Element] = []
            gone = False  # whether the element before went, with the space after it
            for c in e:
                if gone and alto and _tag(c) == "SP":
                    gone = False
                    continue
                corners = keep(c) if _tag(c) in LEVELS else None
                gone = corners == []
                if gone:
                    count(removed, c)
                else:
                    stay.append(c)
                    left += corners or []
            if len(stay) < len(e):
                e[:] = stay
            if left and _tag(e) != "Page":
                x, y = zip(*left, strict=True)
                put(e, int(min(x)), int(min(y)), int(max(x)), int(max(y)))
            return left

        def put(e: ET.Element, x0: int, y0: int, x1: int, y1: int) -> None:
            if alto:
                new = {"HPOS": str(x0), "VPOS": str(y0), "WIDTH": str(x1 - x0), "HEIGHT": str(y1 - y0)}
                changed = any(e.get(k) != v for k, v in new.items())
                e.attrib.update(new)
            else:
                coords = _children(e, "Coords")[0]
                new_points = f"{x0},{y0} {x1},{y0} {x1},{y1} {x0},{y1}"
                changed = coords.get("points") != new_points
                coords.set("points", new_points)
            if changed:
                count(resized, e)

        for page in _below(root, "Page")[:1]:
            tops = [(p, c) for p in page.iter() for c in p if _tag(c) in ("TextBlock", "TextRegion", "TableCell")]
            for parent, region in tops:
                if not keep(region):
                    drop(parent, region)
        return {"path": path, "content": ET.tostring(root, encoding="unicode"), "removed": list(removed.items()), "resized": list(resized.items())}
    except (ET.ParseError, ValueError, TypeError) as e:
        return {"path": path, "error": str(e)}


def filter_documents(documents: DataFrame, polygon: str) -> DataFrame:
    """FILTERED of documents (path, content): what is left inside of a list of points, with the elements removed and resized by tag."""
    corners = parse_polygon(polygon)
    return _mapped(documents, lambda p, c: [cropped(p, c, corners)], pa.schema([("path", pa.string()), ("content", pa.string()), ("removed", _COUNTS), ("resized", _COUNTS), ("error", pa.string())]), FILTERED)


TRAINING = "path string, element_id string, line_no int, words array<string>, polygon array<struct<x: double, y: double>>, valid boolean, error string"
_TRAINING = pa.schema([("path", pa.string()), ("element_id", pa.string()), ("line_no", pa.int32()), ("words", pa.list_(pa.string())), ("polygon", ARROW.field("polygon").type), ("valid", pa.bool_()), ("error", pa.string())])


def training_rows(path: str, content: bytes | str | None, least: int) -> list[dict]:
    """The lines of a document of at least `least` characters with their words in reading order from left to right."""
    from ..functions.text import DIRECTION_MARKS

    out: list[dict] = []
    try:
        root = _root(content)
        for n, line in enumerate(_below(root, "TextLine")):
            row: dict = {"path": path, "line_no": n, "valid": True}
            if _tag(root) == "alto":
                words = [s.get("CONTENT") or "" for s in _children(line, "String")]
                if len(" ".join(words)) >= least:
                    out.append(row | {"element_id": line.get("ID"), "words": words, "polygon": _box(line)})
                continue
            own = next((u.text for t in _children(line, "TextEquiv") for u in _children(t, "Unicode")), None)
            parts = _children(line, "Word")
            if not (own or "").strip():
                if any(u.text for w in parts for u in _below(w, "Unicode")):
                    raise ValueError(f"{line.get('id')} has words but no text")
                continue
            if len(own.strip()) < least:
                continue
            placed = []
            for k, e in enumerate(parts or [line]):
                coords = next((c.get("points") for c in _children(e, "Coords")), None)
                if not coords:
                    if parts:
                        raise ValueError(f"{e.get('id')} in {line.get('id')} has no coordinates")
                    out.append(row | {"element_id": line.get("id"), "words": [], "valid": False})
                    break
                xs = [int(p.split(",")[0]) for p in coords.split()]
                text = next((u.text for u in _below(e, "Unicode") if u.text), None)
                placed.append((int(sum(xs) / len(xs)), k, text))
            else:
                shape = [tuple(map(float, p.split(","))) for c in _children(line, "Coords") for p in (c.get("points") or "").split()]
                words = [t.strip().translate({ord(m): None for m in DIRECTION_MARKS}) for _, _, t in sorted(placed, key=lambda p: p[:2]) if t]
                out.append(row | {"element_id": line.get("id"), "words": words, "polygon": [{"x": a, "y": b} for a, b in shape]})
        return out
    except (ET.ParseError, ValueError, TypeError) as e:
        return [{"path": path, "valid": False, "error": str(e)}]


def training_lines(documents: DataFrame, least: int = 1) -> DataFrame:
    """TRAINING of documents: one row per line; lines without coordinates aren't valid, a document that breaks a rule is one row with its error."""
    return _mapped(documents, lambda p, c: training_rows(p, c, least), _TRAINING, TRAINING)


def training_pairs(lines: DataFrame, reorder: bool = False) -> DataFrame:
    """(folder, file, content): the text halves of training pairs, for valid lines with text."""
    from ..functions import names, text

    stem = names.stem(names.base_name(F.col("path")))
    short = F.split_part(names.base_name(F.col("path")), F.lit("."), F.lit(1))
    label = F.when(short.rlike(r"^\d+$"), F.concat(F.lit("p"), short.cast("int").cast("string"))).otherwise(short)
    content = text.line_text(F.col("words"), reorder)
    return lines.where("valid").select("path", "line_no", names.page_label(stem).alias("folder"), F.concat(label, F.lit("_"), "element_id", F.lit(".gt.txt")).alias("file"), content.alias("content")).where("content <> ''")


def shapes(nodes_: DataFrame) -> DataFrame:
    """(path, level, ord, id, polygon, text): what a drawing of a page shows, nodes of region, line and word level with three points or more."""
    return nodes_.where(F.col("level").isin(WORD, LINE, REGION) & (F.size("polygon") >= 3)).select("path", "level", "ord", "id", "polygon", "text")


def image_path(path: Column, image: Column) -> Column:
    """Where a page's image lies: below the folder above that of the page."""
    return F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.regexp_replace(path, r"[^/]*/[^/]*$", ""), image))
