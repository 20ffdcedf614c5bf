"""A compact exchange of hashed features: which of a document's features do other documents have?

A map task gathers the distinct features of its documents into *loads* of a few
million, sorts each load by feature and cuts it by ranges of hash values, one
row per bucket.  Rows are packed: ascending features as byte planes of their
differences, the documents as 16-bit numbers inside the load, both compressed.
A bucket's reducer sees all occurrences of its features and answers every load
with what it knows about each feature that counts, again packed; the answers of
a load meet in one task.

Features are 64-bit hashes, whatever the size of the input.  Two given features
collide with a probability of 2**-64, so a document's n of N features in all
are taken for another one with a probability of at most n N 2**-64.

So a feature costs seven or eight bytes, a frequent feature is one entry per
document and load, nowhere a row of its own, and a document's features come
together without its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .textblocks import U, buffers, mix, pack, runs, slices, span_hashes, unpack

ROWS = "bucket int, load bigint, part int, body binary"
#: Bytes of text in a load, and documents, which have 16-bit numbers.
LOAD, DOCS = 10 << 20, 60_000


def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(name, slices) of the loads of a partition; the same rows give the same loads and names, should a task run again."""
    parts: list[pa.RecordBatch] = []
    marks: list[np.ndarray] = []
    size = rows = 0

    def name() -> int:
        every = np.concatenate(marks)
        return int(mix(every + np.arange(len(every), dtype=U)).sum(dtype=U).view(np.int64))

    for b in batches:
        for part in slices(b, "text"):
            if parts and (size + part.nbytes > LOAD or rows + part.num_rows > DOCS):
                yield name(), parts
                parts, marks, size, rows = [], [], 0, 0
            data, off = buffers(part.column("text"))
            marks.append(mix(part.column("doc_id").to_numpy().view(U)) ^ span_hashes(data, off[:-1], off[1:]))
            parts.append(part)
            size += part.nbytes
            rows += part.num_rows
    if parts:
        yield name(), parts


def edges(count: int) -> np.ndarray:
    """The borders of `count` even ranges of 64-bit hashes."""
    return np.array([(k << 64) // count for k in range(1, count)], U)


def planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned integers, byte by byte."""
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(U)


def join(parts: list[bytes], level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts))


def split(packed: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def batch(rows: list[tuple]) -> pa.RecordBatch:
    b, l, p, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(l, pa.int64()), pa.array(p, pa.int32()), pa.array(body, pa.binary())], ["bucket", "load", "part", "body"])


def send(docs: DataFrame, features: Callable[[pa.RecordBatch], list[np.ndarray]], count: int, meta: Callable[[list[pa.RecordBatch], list[np.ndarray]], list[np.ndarray]] | None = None) -> DataFrame:
    """Rows of ROWS: part 0 has the sorted features of a load in a bucket and their documents, part 1 (with `meta`) arrays as long as the documents.

    `features` gives the distinct 64-bit features of each row of a batch of (doc_id, text, ...).
    """
    cut = edges(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for load, parts in loads(batches):
            held = [h for part in parts for h in features(part)]
            prints, number = load_features(held)
            at = np.concatenate([[0], np.searchsorted(prints, cut), [len(prints)]])
            rows = [(k, load, 0, join([pack(prints[at[k] : at[k + 1]]), planes(number[at[k] : at[k + 1]], 2)])) for k in range(count) if at[k + 1] > at[k]]
            if meta is not None:
                rows.append((int(load % count), load, 1, join([m.tobytes() for m in meta(parts, held)])))
            if rows:
                yield batch(rows)

    return docs.mapInArrow(run, ROWS)


def load_features(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(features, documents) of a load in the order in which they are sent."""
    prints = np.concatenate(held) if held else np.zeros(0, U)
    number = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
    order = np.argsort(prints, kind="stable")
    return prints[order], number[order]


def read(bodies: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The features and documents of rows of part 0."""
    parts = [split(b) for b in bodies]
    return [unpack(f) for f, _ in parts], [unplanes(d, 2).astype(np.uint16) for _, d in parts]


def grouped(prints: list[np.ndarray], numbers: list[np.ndarray], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, length, mark): the runs of equal features in `order`; a mark is a hash of (load, document)."""
    every, number = np.concatenate(prints), np.concatenate(numbers)
    name = np.repeat(np.array(owner, np.int64).view(U), [len(p) for p in prints])
    order = np.argsort(every, kind="stable")
    start, length = runs(every[order])
    return order, start, length, mix(name + mix(number.astype(U)))


def shared(sent: DataFrame, least: int = 2) -> DataFrame:
    """The entries whose feature at least `least` documents have: rows of ROWS per load, part 0 with features, documents, frequency classes and anchors, part 1 as sent.

    The frequency class of a feature is 8 * log2 of its documents, rounded
    down; its anchor is the least hash (of 40 bits) of (load, document) over
    them, so the features that the same documents share have the same anchor.
    """

    def reduce(table: pa.Table) -> pa.Table:
        loads, parts, bodies = (table.column(c).to_pylist() for c in ("load", "part", "body"))
        out = [(0, load, 1, body) for load, part, body in zip(loads, parts, bodies, strict=True) if part == 1]
        own = [k for k, part in enumerate(parts) if part == 0]
        if own:
            prints, numbers = read([bodies[k] for k in own])
            owner = [loads[k] for k in own]
            order, start, length, mark = grouped(prints, numbers, owner)
            anchor = np.minimum.reduceat(mark[order], start) >> U(24)
            kept = np.zeros(len(order), bool)
            kept[order] = np.repeat(length >= least, length)
            klass = np.empty(len(order), np.uint8)
            klass[order] = np.repeat(np.minimum(255, 8 * np.log2(length)).astype(np.uint8), length)
            where = np.empty(len(order), U)
            where[order] = np.repeat(anchor, length)
            at = 0
            for load, f, d in zip(owner, prints, numbers, strict=True):
                m = kept[at : at + len(f)]
                if m.any():
                    out.append((0, load, 0, join([pack(f[m]), planes(d[m], 2), klass[at : at + len(f)][m].tobytes(), planes(where[at : at + len(f)][m], 5)])))
                at += len(f)
        return pa.Table.from_batches([batch(out)]) if out else table.schema.empty_table()

    return sent.groupBy("bucket").applyInArrow(reduce, ROWS)


def whole_loads(docs: DataFrame) -> DataFrame:
    """Rows of ROWS, one for each load: its doc_ids, text_keys, and texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for load, parts in loads(batches):
            raw = [buffers(p.column("text")) for p in parts]
            size = np.concatenate([np.diff(off) for _, off in raw])
            ids = np.concatenate([p.column("doc_id").to_numpy() for p in parts])
            keys = np.concatenate([p.column("text_key").to_numpy() for p in parts])
            yield batch([(0, load, -1, join([ids.tobytes(), keys.tobytes(), size.tobytes(), b"".join(data.tobytes() for data, _ in raw)], level=3))])

    return docs.mapInArrow(run, ROWS)


def open_load(body: bytes) -> pa.RecordBatch:
    """(doc_id, text_key, text) of a row of `whole_loads`."""
    ids, keys, size, data = split(body)
    off = np.concatenate([[0], np.cumsum(np.frombuffer(size, np.int64))]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(keys, np.int64)), text], ["doc_id", "text_key", "text"])
