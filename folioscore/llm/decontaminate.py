"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words; every window of
``n`` words of every item (the whole item where it is shorter) is a pattern.
One automaton over word numbers holds them all.  A document's words are found
and hashed from its bytes at once, become word numbers (0: not a benchmark
word), and are scanned once; a match at words i..j maps back to the characters
of the original text between the start of word i and the end of word j.

Defined results: rows without doc_id or text, and items without item_id or
text, take no part; items of fewer than ``least`` words are no patterns, since
they would match ordinary text; an empty benchmark or table gives no match; an
item that occurs twice in a text gives two rows; repeated rows give their
matches once; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, texts, without
from .textblocks import buffers, folded, lower, slices, span_hashes, words


def item_words(items: list[tuple[int, str]]) -> list[tuple[int, list[bytes]]]:
    out = []
    for item, text in items:
        data, off = buffers(folded(pa.array([text], pa.string())))
        s, e, _ = words(data, off)
        out.append((item, [data[i:j].tobytes() for i, j in zip(s, e, strict=True)]))
    return out


class Patterns:
    """The automaton, built from plain rows on whichever worker needs it."""

    def __init__(self, items: list[tuple[int, str]], n: int, least: int) -> None:
        kept = [(i, w) for i, w in item_words(items) if len(w) >= least]
        vocabulary = sorted({x for _, w in kept for x in w})
        joined = np.frombuffer(b"".join(vocabulary), np.uint8) if vocabulary else np.zeros(0, np.uint8)
        end = np.cumsum([len(x) for x in vocabulary]).astype(np.int64) if vocabulary else np.zeros(0, np.int64)
        hashes = span_hashes(joined, end - [len(x) for x in vocabulary], end) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        number = {x: k + 1 for k, x in enumerate(vocabulary)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, w in kept:
            ids = [number[x] for x in w]
            size = min(n, len(ids))
            for k in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[k : k + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in found.items():
            self.automaton.add_word(key, (len(key), sorted(owners)))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], 0)

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, last word), overlapping or touching windows of an item merged."""
        open_: dict[int, list[int]] = {}
        out = []
        for end, (size, owners) in self.automaton.iter(tuple(ids.tolist())):
            for item in owners:
                span = open_.get(item)
                if span is not None and end - size + 1 <= span[1] + 1:
                    span[0], span[1] = min(span[0], end - size + 1), end
                else:
                    if span is not None:
                        out.append((item, *span))
                    open_[item] = [end - size + 1, end]
        return sorted(out + [(i, *s) for i, s in open_.items()])


#: The automata that this worker has built, by the name of their block of items.
_built: dict[str, Patterns] = {}


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, start, end): every passage of a document that covers windows of an item; end is exclusive, all counts from 0.

    The items are sent to all tasks, at most about ``block_bytes`` at a time: a
    larger benchmark is cut into blocks of whole items, each with an automaton
    and a scan of its own, and nothing else changes.
    """
    return _matches(texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, n, least, block_bytes, []).distinct()


def _matches(plain: DataFrame, benchmark: DataFrame, n: int, least: int, block_bytes: int, keep: list[str]) -> DataFrame:
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    blocks = max(1, -(-int(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = [_scan(plain, known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else known, n, least, keep) for k in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _scan(plain: DataFrame, known: DataFrame, n: int, least: int, keep: list[str]) -> DataFrame:
    """The matches of a block of items, with the columns `keep` (of integers) of the documents."""
    items = plain.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in known.orderBy("item_id", "text").collect()])
    name = uuid.uuid4().hex
    columns = [*keep, "doc_id", "item_id", "first_word", "last_word", "start", "end"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Patterns(items.value, n, least)
        p = _built[name]
        for batch in batches if p.any else ():
            for part in slices(batch, "text"):
                data, off = buffers(lower(part, "text"))
                s, e, doc = words(data, off)
                ids = p.ids(span_hashes(data, s, e)).astype(np.int64)
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                known = np.concatenate([[0], np.cumsum(ids > 0)])
                out: list[tuple[int, ...]] = []
                for k in np.flatnonzero(known[edge[1:]] - known[edge[:-1]] >= least):
                    spans = p.spans(ids[edge[k] : edge[k + 1]])
                    if spans:
                        raw = part.column("text")[int(k)].as_py()
                        own, own_off = buffers(pa.array([raw]))
                        ws, we, _ = words(own, own_off)
                        chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                        mine = [part.column(c)[int(k)].as_py() for c in [*keep, "doc_id"]]
                        out += [(*mine, i, a, b, int(chars[ws[a]]), int(chars[we[b]])) for i, a, b in spans]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], columns)

    return plain.mapInArrow(scan, ", ".join(f"{c} bigint" for c in columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """docs without the documents that hold a window of a benchmark item; the decision is made for (doc_id, text), and rows without id or text stay."""
    return without(docs, _matches(keyed_texts(docs), benchmark, n, least, block_bytes, ["text_key"]))
