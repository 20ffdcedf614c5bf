"""Exact duplicates through content-defined chunk recipes.

A gear hash over the last 32 bytes cuts every text into chunks of about a
kilobyte.  The different chunks meet once, by hash: every task sends each of
its chunks once, however often it occurs, so a chunk that a third of all
documents share is a few rows.  A hash that stands for one byte string is its
verified identifier; where it stands for several, their rank is added.  A
document is then the ordered list of its identifiers, and only those lists are
compared; long texts don't move again.

Defined results: rows without doc_id or text take no part; an empty text equals
any other empty text; a row repeated with the same doc_id and text is one
document; rows that share a doc_id but not the text are documents of their own.
An empty table gives an empty result, and other columns, whatever their names,
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, fresh, keyed_texts, materialise
from .textblocks import buffers, slices, span_hashes

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNKS = "doc_id bigint, text_key bigint, pos int, chunk_hash bigint, chunk binary"


def chunk_starts(data: np.ndarray, off: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of the chunks; every document has one at least, an empty one if it is empty."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    lo = np.searchsorted(at, off[:-1], "right")
    hi = np.searchsorted(at, off[1:], "left")
    starts: list[int] = []
    owner: list[int] = []
    for i in range(len(off) - 1):
        last = int(off[i])
        starts.append(last)
        owner.append(i)
        for c in [*at[lo[i] : hi[i]].tolist(), int(off[i + 1])]:
            while c - last > most:
                last += most
                starts.append(last)
                owner.append(i)
            if c - last >= least and c < off[i + 1]:
                last = c
                starts.append(last)
                owner.append(i)
    return np.array(starts, np.int64), np.array(owner, np.int64)


def chunks(docs: DataFrame, bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """(doc_id, text_key, pos, chunk_hash, chunk): the chunks of all texts in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffers(part.column("text"))
                start, doc = chunk_starts(data, off, bits, least, most)
                end = np.append(start[1:], len(data))
                first = np.searchsorted(doc, np.arange(part.num_rows))
                spans = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)])
                own = [part.column(c).take(pa.array(doc)) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)), pa.array(span_hashes(data, start, end).view(np.int64)), spans], ["doc_id", "text_key", "pos", "chunk_hash", "chunk"])

    return keyed_texts(docs).mapInArrow(cut, CHUNKS)


def recipes(docs: DataFrame, bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """(doc_id, text_key, recipe, n_rows): the ordered list of verified chunk identifiers of every document, and its rows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffers(part.column("text"))
                start, doc = chunk_starts(data, off, bits, least, most)
                keys = span_hashes(data, start, np.append(start[1:], len(data))).view(np.int64)
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.ListArray.from_arrays(pa.array(edge), pa.array(keys))], ["doc_id", "text_key", "hashes"])

    lists = keyed_texts(docs).mapInArrow(listed, "doc_id bigint, text_key bigint, hashes array<bigint>").groupBy("doc_id", "text_key").agg(F.first("hashes").alias("hashes"), F.count("*").alias("n_rows"))
    every = chunks(docs, bits, least, most)
    different = every.select("chunk_hash", "chunk").distinct()
    twice = materialise(different.groupBy("chunk_hash").agg(F.count("*").alias("n")).where("n > 1").select("chunk_hash"))
    if twice.isEmpty():
        return lists.select("doc_id", "text_key", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(1).alias("rank"))).alias("recipe"), "n_rows")
    return ranked(lists, every, twice)


def ranked(lists: DataFrame, every: DataFrame, twice: DataFrame) -> DataFrame:
    """`recipes` where some hashes stand for several chunks: those get the rank of their bytes."""
    rank = every.join(twice, "chunk_hash", "left_semi").select("chunk_hash", "chunk").distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy("chunk_hash").orderBy("chunk")))
    fixes = every.join(rank, ["chunk_hash", "chunk"]).groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_set(F.struct("pos", "rank"))).alias("fix"))
    whole = lists.join(fixes, ["doc_id", "text_key"], "left")
    named = F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), F.coalesce(F.try_element_at("fix", i), F.lit(1)).alias("rank")))
    return whole.select("doc_id", "text_key", named.alias("recipe"), "n_rows")


def _groups(made: DataFrame) -> DataFrame:
    """(recipe, first, copies, rows) of every recipe: its first document, how many it has, and their rows; aggregated in part before anything is moved."""
    return made.groupBy("recipe").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"), F.sum("n_rows").alias("rows"))


def exact_duplicates(docs: DataFrame, **cut: int) -> DataFrame:
    """(doc_id, keep_id, copies): each document whose text a document with a smaller id has too, with the smallest such id and the number of documents that share the text."""
    made = materialise(recipes(docs, **cut))
    groups = _groups(made).where("copies > 1")
    return made.join(groups, "recipe").where("doc_id <> first.doc_id").select("doc_id", F.col("first.doc_id").alias("keep_id"), "copies")


def drop_exact_duplicates(docs: DataFrame, **cut: int) -> DataFrame:
    """docs with one row of every distinct text, that of the smallest doc_id; all rows without doc_id or text stay.

    The decision is made for (doc_id, text), so a row that repeats goes too, and
    so does the second text of a doc_id if another document has it.
    """
    made = materialise(recipes(docs, **cut))
    key, first, at, his, own = (fresh(docs, c) for c in ("text_key_", "is_first_", "row_at_", "id_of_", "key_of_"))
    marked = made.join(_groups(made).where("rows > 1"), "recipe").select(F.col("doc_id").alias(his), F.col("text_key").alias(own), (F.struct("doc_id", "text_key") == F.col("first")).alias(first))
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")))
    on = (keyed["doc_id"].cast("bigint") == marked[his]) & (keyed[key] == marked[own]) & keyed["text"].isNotNull()
    joined = keyed.join(marked.hint("shuffle_hash"), on, "left")
    alone = joined.where(F.col(first).isNull()).select(*columns(docs))
    # Only the documents that stay and have copies get here; of their repeated rows the first in the order of all values stays.
    order = Window.partitionBy("doc_id", key).orderBy(F.to_json(F.struct(*columns(docs))))
    once = joined.where(F.col(first)).withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).select(*columns(docs))
    return alone.unionByName(once)
