"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents in the order of their hashed ids, cut
into quanta of at most ``quantum`` tokens.  The served tokens of a source should
be its target share of all served tokens; what it lacks is its deficit.  The
packer serves, again and again, the source with the largest deficit relative
to its share, and cuts the stream of quanta into windows of ``window`` tokens;
a quantum that reaches over the end of a window goes on in the next.  So every
window holds the target proportions to within a quantum per source.  Inside a
window a document's quanta are put together again, ordered by source.

That loop needs no loop: the source with the largest relative deficit is the
one whose next quantum has the least *virtual time*, the tokens up to its
middle in its queue divided by its share.  So the stream is all quanta in the
order of virtual time, and a position in it is a running sum.  Deficits carry over from
window to window, and since virtual time is the same everywhere also over the
borders of partitions.  Both running sums go over even ranges (of hashed ids,
then of virtual time), whose totals are added up first, so no task sees a whole
source or the whole stream.

The shares are given (``targets``), or the sources' tokens to the power of
``temper``: 1 is the mixture as it is, less lifts small sources and lowers
large ones.  A source that runs dry leaves its share to the rest, in
proportion; every token is packed, so the last windows hold what the largest
sources have beyond their shares.

Defined results: rows without doc_id or text, and texts without tokens, are not
packed; a null source is a source of its own; sources without a target get no
place; a repeated row is packed once; rows that share a doc_id but not the text
are packed each; a document whose rows name several sources is packed once, for
the first of them in order, a null source last; an empty table gives no window;
the last window may be short.  Other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets, materialise, texts
from .textblocks import buffers, slices, span_hashes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before byte-pair encoding: contractions, words, numbers, signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str):
    """The byte-pair encoding of a file of ranks, read once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text_key, source, tokens) of every distinct document that has tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffers(part.column("text"))
                n = np.array([len(enc.encode_ordinary(t)) for t in part.column("text").to_pylist()], np.int64)
                key = span_hashes(data, off[:-1], off[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key), part.column("source"), pa.array(n)], ["doc_id", "text_key", "source", "tokens"])

    plain = texts(docs, "source").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return plain.mapInArrow(count, "doc_id bigint, text_key bigint, source string, tokens bigint").where("tokens > 0").groupBy("doc_id", "text_key").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def _range(key: Column, count: int) -> Column:
    """The even range, of `count`, that a uniform 64-bit hash falls in."""
    return F.floor((F.shiftrightunsigned(key, 32)) * F.lit(count) / F.lit(float(1 << 32))).cast("int")


def _running(df: DataFrame, by: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one, in the order (by; part, order), found by ranges."""
    totals = df.groupBy(*by, part).agg(F.sum(value).alias("__total"))
    before = totals.select(*by, part, (F.sum("__total").over(Window.partitionBy(*by).orderBy(part)) - F.col("__total")).alias("__ahead"))
    inner = df.withColumn("__in", F.sum(value).over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value))
    return inner.join(before, [*by, part]).withColumn(out, F.col("__in") + F.col("__ahead")).drop("__in", "__ahead")


def pack(docs: DataFrame, window: int = 4096, quantum: int = 128, targets: dict[str, float] | None = None, temper: float = 1.0, tokenizer: str = TOKENIZER) -> DataFrame:
    """(window_id, slot, doc_id, source, token_start, token_end): the parts of documents in every window; slot is the part's first position in it, token_start and token_end count within the document."""
    counted = materialise(token_counts(docs, tokenizer))
    return pack_counts(counted, buckets(docs, 64 << 20), window, quantum, targets, temper)


def _stretches(sources: DataFrame, ranges: int) -> Callable[[Column], Column]:
    """The stretch, of `ranges`, that a virtual time falls in, by the tokens served up to it: all stretches hold about as many, however uneven the sources.

    Tokens served up to a time t are the sum of share * min(t, end) over the
    sources; sources with nearly the same end are taken together, which moves
    borders of stretches but not the order of the stream.
    """
    near = F.floor(F.log2("finish") * 16)
    rows = sources.groupBy(near.alias("near")).agg(F.max("finish").alias("finish"), F.sum("share").alias("share")).orderBy("near").collect()
    at = np.array([0.0] + [r["finish"] for r in rows])
    share = np.array([r["share"] for r in rows])
    speed = np.cumsum(share[::-1])[::-1]
    served = np.concatenate([[0.0], np.cumsum(np.diff(at) * speed)])

    @F.pandas_udf("int")
    def stretch(time: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.interp(time, at, served) / max(served[-1], 1e-300) * ranges, ranges - 1).astype(np.int32))

    return stretch


def pack_counts(counted: DataFrame, ranges: int, window: int, quantum: int, targets: dict[str, float] | None = None, temper: float = 1.0) -> DataFrame:
    spark = counted.sparkSession
    queue = counted.withColumn("source", F.coalesce("source", F.lit("\0"))).withColumn("key", F.xxhash64("doc_id", "text_key"))
    if targets is None:
        share = queue.groupBy("source").agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("share"))
    else:
        share = spark.createDataFrame([(k if k is not None else "\0", float(v)) for k, v in targets.items() if v > 0], "source string, share double")
    queue = queue.withColumn("range", _range(F.col("key"), ranges))
    order = ["key", "doc_id", "text_key"]
    placed = _running(queue, ["source"], "range", order, "tokens", "ahead").join(share, "source")
    cut = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / quantum).cast("bigint")))
    pieces = (
        placed.select("doc_id", "text_key", "key", "source", "tokens", "ahead", "share", cut.alias("k"))
        .withColumn("from", F.col("k") * quantum)
        .withColumn("size", F.least(F.lit(quantum), F.col("tokens") - F.col("from")))
        .withColumn("time", (F.col("ahead") + F.col("from") + F.col("size") / 2) / F.col("share"))
    )
    whole = queue.groupBy("source").agg(F.sum("tokens").alias("total")).join(share, "source").withColumn("finish", F.col("total") / F.col("share"))
    pieces = pieces.withColumn("stretch", _stretches(whole, ranges)(F.col("time"))).withColumn("all", F.lit(0))
    stream = _running(pieces, ["all"], "stretch", ["time", "source", "key", "doc_id", "text_key", "k"], "size", "at")
    window_id = F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("size") - 1) / window)))
    parts = stream.select("*", window_id.alias("window_id"))
    first = F.greatest(F.col("at"), F.col("window_id") * window) - F.col("at") + F.col("from")
    last = F.least(F.col("at") + F.col("size"), (F.col("window_id") + 1) * window) - F.col("at") + F.col("from")
    joined = (
        parts.select("window_id", "source", "key", "doc_id", "text_key", first.alias("first"), last.alias("last"))
        .repartition("window_id")
        .groupBy("window_id", "source", "key", "doc_id", "text_key")
        .agg(F.min("first").cast("bigint").alias("token_start"), F.max("last").cast("bigint").alias("token_end"))
    )
    size = F.col("token_end") - F.col("token_start")
    inside = Window.partitionBy("window_id").orderBy("source", "key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        F.col("window_id").cast("bigint").alias("window_id"),
        (F.sum(size).over(inside) - size).alias("slot"),
        "doc_id",
        F.when(F.col("source") != "\0", F.col("source")).alias("source"),
        "token_start",
        "token_end",
    )
