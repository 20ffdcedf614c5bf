"""Repeated passages through paragraph MinHash banding.

Two kinds of paragraphs are compared.  *Lines*, the text's own paragraphs, have
``bands`` band keys of ``rows`` MinHash values each over their word trigrams;
the bands are tuned: the fewest for which paragraphs of the threshold's
similarity collide with the probability ``recall``.  *Pieces* are cut where the
text itself says so, before a word whose hash with the word before is the least
among ``REACH`` words on either side, whatever the line ends.  A passage that is
pasted into other texts, at any place, is cut there as it is cut here but for
its first and last words; so its pieces are equal, and every word of a text,
however short its lines, belongs to a piece.

`exchange` tells every load which of its paragraphs' features other documents
have, so only those become rows.  Equal pieces meet by their hash.  Lines that
collide in a band with a line that isn't equal are joined, verified by exact
Jaccard similarity of their trigram sets, and clustered by connected
components.  In each cluster the document of the smallest id keeps its
paragraphs.  Pieces in a row make a span, which is then extended word by word
over both texts to the true ends of the passage: the words that it shares with
the keeper before its first and after its last piece lie in at most two pieces
there, and both sides bring these along where the passage may end.  Spans that
touch are one, and those of at least ``min_words`` words are to go.

Pieces and lines are told apart by 64-bit hashes (a paragraph is taken for
another one of N at a probability of N / 2**64), the words of an extension by 32
bits.

Defined results: rows without doc_id or text take no part; a passage that
repeats only inside one document stays; rows that share a doc_id, repeated or
not, lose nothing to each other, and their spans are told by the text's own
positions; in a tie of ids the first row stays too; a passage of fewer than
about 2 * REACH words, or one without a cut in it (a word repeated over and
over), is found as a line only; empty texts have no span, and an empty table
gives none; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import exchange
from .common import buckets, keyed_texts, materialise
from .components import components
from .ngram_join import overlaps
from .textblocks import U, buffers, folded, mix, ngrams, slices, span_hashes, words

LEAST_WORDS, REACH, BLOCK = 4, 5, 1024
PIECE, LINE = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
UNITS = "doc_id bigint, text_key bigint, first bigint, words bigint, start bigint, end bigint, exact bigint, left binary, right binary, bands array<bigint>, grams binary"
KINDS = [pa.int64()] * 7 + [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
NAMES = [c.split()[0] for c in UNITS.split(", ")]


def tuned_bands(threshold: float, recall: float, rows: int = 2) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def cut_pieces(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of the first word of every piece."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = doc[1:] != doc[:-1]
    key = np.full(n, np.iinfo(np.uint64).max, U)
    key[1:] = mix(h[1:] + mix(h[:-1]))
    key[fresh] = np.iinfo(np.uint64).max
    least = ~fresh
    for k in range(1, min(REACH, n - 1) + 1):
        same = doc[k:] == doc[:-k]
        least[k:] &= ~same | (key[k:] < key[:-k])
        least[:-k] &= ~same | (key[:-k] <= key[k:])
    return np.flatnonzero(fresh | least)


class Paragraphs:
    """The pieces and lines of a batch's texts with their features."""

    def __init__(self, texts: pa.Array, bands: int, rows: int) -> None:
        data, off = buffers(folded(texts))
        starts, ends, doc = words(data, off)
        self.h = span_hashes(data, starts, ends)
        n = len(self.h)
        self.piece = cut_pieces(doc, self.h)
        self.piece_words = np.diff(np.append(self.piece, n))
        lines = np.concatenate([[0], np.cumsum(data == 10)])[starts] if n else starts
        self.line = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lines[1:] != lines[:-1])])) if n else np.zeros(0, np.int64)
        self.line_words = np.diff(np.append(self.line, n))
        self.piece_doc, self.line_doc = (doc[a] if n else np.zeros(0, np.int64) for a in (self.piece, self.line))
        self.first_word = np.searchsorted(doc, np.arange(len(texts))) if n else np.zeros(len(texts), np.int64)
        self.piece_exact, self.line_exact = (self._exact(a, c) ^ salt for a, c, salt in ((self.piece, self.piece_words, PIECE), (self.line, self.line_words, LINE)))
        # The trigrams of a line are those that start in it and end in it.
        owner = np.repeat(np.arange(len(self.line)), self.line_words)
        grams, at = ngrams(self.h, owner, 3)
        self.grams, self.gram_edge = grams, np.searchsorted(owner[at] if len(at) else at, np.arange(len(self.line) + 1))
        has = self.gram_edge[1:] > self.gram_edge[:-1]
        self.bands = np.zeros((bands, len(self.line)), U)
        for b in range(bands):
            for r in range(rows):
                low = np.zeros(len(self.line), U)
                if has.any():
                    low[has] = np.minimum.reduceat(mix(grams ^ mix(np.array([1 + b * rows + r], U))), self.gram_edge[:-1][has])
                self.bands[b] = mix(self.bands[b] + low + U(b + 1))
        self.piece_long, self.line_long = self.piece_words >= LEAST_WORDS, self.line_words >= LEAST_WORDS

    def _exact(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0, U)
        place = np.arange(len(self.h)) - np.repeat(first, count)
        return mix(np.add.reduceat(mix(self.h + mix(place.astype(U))), first))

    def features(self, texts: int) -> list[np.ndarray]:
        p, q = self.piece_long, self.line_long
        every = np.concatenate([self.piece_exact[p], self.line_exact[q], *self.bands[:, q]])
        owner = np.concatenate([self.piece_doc[p], np.tile(self.line_doc[q], 1 + len(self.bands))])
        order = np.lexsort((every, owner))
        every, owner = every[order], owner[order]
        edge = np.searchsorted(owner, np.arange(texts + 1))
        return [every[a:b][np.concatenate([[True], every[a + 1 : b] != every[a : b - 1]])] if b > a else every[:0] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def answered(sent: DataFrame) -> DataFrame:
    """For every row of part 0 that was sent, in its order: the documents that have the feature, 0 if no other has, and a hash of these documents."""

    def reduce(table: pa.Table) -> pa.Table:
        owner = table.column("load").to_pylist()
        bucket = table.column("bucket").to_pylist()
        prints, numbers = exchange.read(table.column("body").to_pylist())
        order, start, length, mark = exchange.grouped(prints, numbers, owner)
        who = np.add.reduceat(mark[order], start) >> U(32)
        count, sign = np.zeros(len(order), U), np.zeros(len(order), U)
        count[order] = np.repeat(np.where(length > 1, length, 0).astype(U), length)
        sign[order] = np.repeat(np.where(length > 1, who, U(0)), length)
        edge = np.cumsum([0, *map(len, prints)])
        return pa.Table.from_batches([exchange.batch([(b, load, 0, exchange.join([exchange.planes(count[i:j], 5), exchange.planes(sign[i:j], 4)])) for b, load, i, j in zip(bucket, owner, edge[:-1], edge[1:], strict=True)])])

    return sent.groupBy("bucket").applyInArrow(reduce, exchange.ROWS)


def near_words(h: np.ndarray, place: np.ndarray, origin: int) -> bytes:
    """Words beside a piece, from the nearest on: hashes of 32 bits, and how far their outer ends lie from the piece's end."""
    return np.concatenate([(h >> U(32)).astype(np.uint32), np.abs(place - origin).astype(np.uint32)]).tobytes()


def repeated_paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """UNITS: the pieces that other documents have too (with the words beside them where the set of these documents changes), and the lines that share a band with a different line (with bands and grams)."""
    plain = keyed_texts(docs)
    if any(x in plain._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "MapIn", "Nondeterministic")):
        plain = materialise(plain)  # the two scans below must see the same partitions

    def feature(part: pa.RecordBatch) -> list[np.ndarray]:
        return Paragraphs(part.column("text"), bands, rows).features(part.num_rows)

    def pick(table: pa.Table) -> pa.Table:
        part, bucket, body = (table.column(c).to_pylist() for c in ("part", "bucket", "body"))
        # Loads with equal texts have one name, and each of them got the same answer.
        told = {b: x for p, b, x in zip(part, bucket, body, strict=True) if p == 0}
        answers = [exchange.split(told[b]) for b in sorted(told)]
        count = np.concatenate([exchange.unplanes(c, 5) for c, _ in answers]) if answers else np.zeros(0, U)
        sign = np.concatenate([exchange.unplanes(s, 4) for _, s in answers]) if answers else np.zeros(0, U)
        out: list[tuple] = []
        for load in (x for p, x in zip(part, body, strict=True) if p == -1):
            own = exchange.open_load(load)
            chunks = list(slices(own, "text"))
            made = [Paragraphs(c.column("text"), bands, rows) for c in chunks]
            prints, number = exchange.load_features([f for c, p in zip(chunks, made, strict=True) for f in p.features(c.num_rows)])
            if len(prints) != len(count):
                raise RuntimeError("the documents came in other partitions than when they were sent")
            some = count > 0
            key = mix(prints[some] + mix(number[some].astype(U)))
            order = np.argsort(key)
            key, held, who = key[order], count[some][order], sign[some][order]

            def look(feature: np.ndarray, doc: np.ndarray, key: np.ndarray = key, held: np.ndarray = held, who: np.ndarray = who) -> tuple[np.ndarray, np.ndarray]:
                if not len(key):
                    return np.zeros(len(feature), U), np.zeros(len(feature), U)
                mine = mix(feature + mix(doc.astype(U)))
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                hit = key[at] == mine
                return np.where(hit, held[at], U(0)), np.where(hit, who[at], U(0))

            before = 0
            for chunk, p in zip(chunks, made, strict=True):
                out += unit_rows(chunk, p, before, look)
                before += chunk.num_rows
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(KINDS), KINDS, strict=True)], NAMES)

    sent = exchange.send(plain, feature, buckets(docs, 12 << 20))
    return exchange.whole_loads(plain).unionByName(answered(sent)).groupBy("load").applyInArrow(pick, UNITS)


def unit_rows(chunk: pa.RecordBatch, p: Paragraphs, before: int, look) -> list[tuple]:
    """The rows of UNITS of a chunk whose first text has the number `before` in its load."""
    data, off = buffers(chunk.column("text"))
    ws, we, _ = words(data, off)
    if len(ws) != len(p.h):
        raise RuntimeError("lower case changed the number of words")
    out: list[tuple] = []
    count, sign = look(p.piece_exact, p.piece_doc + before)
    count = np.where(p.piece_long, count, U(0))
    sign = np.where(count > 0, sign, U(0))
    line_count, _ = look(p.line_exact, p.line_doc + before)
    band_count = np.array([look(b, p.line_doc + before)[0] for b in p.bands]).reshape(len(p.bands), len(p.line))
    # A band that more documents have than the line has lines in it that aren't equal.
    wide = (band_count > np.maximum(line_count, U(1))) & p.line_long
    hit, lines = np.flatnonzero(count > 0), np.flatnonzero(wide.any(0))
    if not len(hit) and not len(lines):
        return out
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cs, ce = chars[ws], chars[we]
    ids, keys = chunk.column("doc_id").to_numpy(), chunk.column("text_key").to_numpy()
    total = len(p.piece)
    end_of = p.piece + p.piece_words
    for u in hit.tolist():
        d, a, b = int(p.piece_doc[u]), int(p.piece[u]), int(end_of[u])
        base, first = int(chars[off[d]]), int(p.first_word[d])
        left = right = None
        if u and p.piece_doc[u - 1] == d and sign[u - 1] != sign[u]:
            low = int(p.piece[u - 2]) if u > 1 and p.piece_doc[u - 2] == d else int(p.piece[u - 1])
            left = near_words(p.h[low:a][::-1], cs[low:a][::-1], int(cs[a]))
        if u + 1 < total and p.piece_doc[u + 1] == d and sign[u + 1] != sign[u]:
            high = int(end_of[u + 2]) if u + 2 < total and p.piece_doc[u + 2] == d else int(end_of[u + 1])
            right = near_words(p.h[b:high], ce[b:high], int(ce[b - 1]))
        out.append((int(ids[d]), int(keys[d]), a - first, b - a, int(cs[a]) - base, int(ce[b - 1]) - base, int(p.piece_exact[u].view(np.int64)), left, right, None, None))
    for u in lines.tolist():
        d, a, n = int(p.line_doc[u]), int(p.line[u]), int(p.line_words[u])
        base, first = int(chars[off[d]]), int(p.first_word[d])
        grams = np.unique(p.grams[p.gram_edge[u] : p.gram_edge[u + 1]])
        out.append((int(ids[d]), int(keys[d]), a - first, n, int(cs[a]) - base, int(ce[a + n - 1]) - base, int(p.line_exact[u].view(np.int64)), None, None, p.bands[wide[:, u], u].view(np.int64).tolist(), grams.tobytes()))
    return out


def similar_paragraphs(heads: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): links between the hashes of different paragraphs that share a band and are similar.

    A band with many paragraphs is cut into blocks whose pairs are groups of
    their own; small groups share a task's call.
    """

    def verify(table: pa.Table) -> pa.Table:
        rows = table.select(["band", "block_a", "block_b", "side", "exact", "grams"]).to_pydict()
        groups: dict[tuple[int, int, int], tuple[list[int], list[int]]] = {}
        for k in sorted(range(table.num_rows), key=lambda k: rows["exact"][k]):
            groups.setdefault((rows["band"][k], rows["block_a"][k], rows["block_b"][k]), ([], []))[rows["side"][k]].append(k)
        found: list[tuple[int, int]] = []
        for (_, a, b), (left, right) in sorted(groups.items()):
            if a != b and not (left and right):
                continue
            sets = [[np.frombuffer(rows["grams"][k], U) for k in side] for side in (left, right)]
            found += _forest(_links([[rows["exact"][k] for k in side] for side in (left, right)], sets, threshold))
        found = _forest(found)
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    each = heads.select(F.explode("bands").alias("band"), "exact", "grams")
    crowd = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = each.join(crowd, "band").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("exact"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = pairs.select("band", F.least("mine", "other").alias("block_a"), F.greatest("mine", "other").alias("block_b"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "exact", "grams")
    bucket = F.pmod(F.xxhash64("band", "block_a", "block_b"), F.lit(buckets(heads, 1 << 20, "grams")))
    return sides.groupBy(bucket.alias("bucket")).applyInArrow(verify, "a bigint, b bigint").distinct()


def _links(exact: list[list[int]], sets: list[list[np.ndarray]], threshold: Fraction) -> list[tuple[int, int]]:
    """The pairs of similar sets, by their hashes: of one side with itself where the other is empty."""
    one = not sets[1]
    if one and len(sets[0]) == 2:
        c = len(np.intersect1d(*sets[0], assume_unique=True))
        return [(exact[0][0], exact[0][1])] if c * threshold.denominator >= (len(sets[0][0]) + len(sets[0][1]) - c) * threshold.numerator else []
    a, b = np.array([len(s) for s in sets[0]]), np.array([len(s) for s in sets[0 if one else 1]])
    c = overlaps(sets[0], None if one else sets[1]).astype(np.int64)
    good = c * threshold.denominator >= (a[:, None] + b[None, :] - c) * threshold.numerator
    if one:
        good &= np.tri(len(good), k=-1, dtype=bool).T
    return [(exact[0][i], exact[0 if one else 1][j]) for i, j in zip(*np.nonzero(good), strict=True)]


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that first connect two components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in edges:
        p, q = root(a), root(b)
        if p != q:
            parent[p] = q
            out.append((a, b))
    return out


@F.pandas_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("chars", T.LongType())]))
def extension(own: pd.Series, other: pd.Series) -> pd.DataFrame:
    """How many of the words beside a piece two texts share, and where the last of them ends in the first."""
    out = []
    for a, b in zip(own, other, strict=True):
        n = d = 0
        if a is not None and b is not None and a is not pd.NA and b is not pd.NA:
            x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            size = min(len(x), len(y)) // 2
            differ = np.flatnonzero(x[:size] != y[:size])
            n = int(differ[0]) if len(differ) else size
            d = int(x[len(x) // 2 + n - 1]) if n else 0
        out.append((n, d))
    return pd.DataFrame(out, columns=["words", "chars"])


def piece_spans(pieces: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, last, start, end, keep_id): the rows of pieces whose words a document of a smaller id has too, extended to the ends of what both have; first and last are word numbers."""
    kept = pieces.groupBy("exact").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("top")).where("top > keep_id").select("exact", "keep_id")
    known = pieces.join(kept, "exact")
    gone = known.where("doc_id > keep_id").drop("bands", "grams")
    by = Window.partitionBy("doc_id", "text_key").orderBy("first", "start")
    fresh = F.coalesce(F.col("first") > F.lag(F.col("first") + F.col("words")).over(by), F.lit(True)).cast("int")
    isles = gone.withColumn("fresh", fresh).withColumn("isle", F.sum("fresh").over(by))
    spans = isles.groupBy("doc_id", "text_key", "isle").agg(
        F.min("first").alias("first"), (F.max(F.col("first") + F.col("words")) - 1).alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep_id").alias("keep_id"),
        F.min_by(F.struct("exact", "keep_id", "left"), "first").alias("head"), F.max_by(F.struct("exact", "keep_id", "right"), "first").alias("tail"),
    )
    # The keeper's words beside the same piece; it may hold the piece at several places.
    keeper = known.where("doc_id = keep_id").select("exact", "keep_id", "left", "right")
    for side, end in (("left", "head"), ("right", "tail")):
        theirs = keeper.where(F.col(side).isNotNull()).select(F.col("exact").alias("e"), F.col("keep_id").alias("k"), F.col(side).alias("their"))
        asked = spans.where(F.col(end)[side].isNotNull()).select("doc_id", "text_key", "isle", F.col(end)["exact"].alias("e"), F.col(end)["keep_id"].alias("k"), F.col(end)[side].alias("own"))
        more = asked.join(theirs, ["e", "k"]).select("doc_id", "text_key", "isle", extension("own", "their").alias("x")).groupBy("doc_id", "text_key", "isle").agg(F.max("x").alias(f"more_{side}"))
        spans = spans.join(more, ["doc_id", "text_key", "isle"], "left")
    grown = lambda side, what: F.coalesce(F.col(f"more_{side}")[what], F.lit(0))
    return spans.select(
        "doc_id", "text_key", (F.col("first") - grown("left", "words")).alias("first"), (F.col("last") + grown("right", "words")).alias("last"),
        (F.col("start") - grown("left", "chars")).alias("start"), (F.col("end") + grown("right", "chars")).alias("end"), "keep_id",
    )


def line_spans(lines: DataFrame, threshold: Fraction) -> DataFrame:
    """The same for lines that are similar to one of a document of a smaller id, directly or by a chain."""
    heads = materialise(lines.groupBy("exact").agg(F.first("bands").alias("bands"), F.first("grams").alias("grams")))
    roots = components(similar_paragraphs(heads, threshold), "a", "b")
    clustered = lines.drop("bands", "grams", "left", "right").join(roots.select(F.col("node").alias("exact"), "root"), "exact")
    firsts = clustered.groupBy("root").agg(F.min("doc_id").alias("keep_id"))
    gone = clustered.join(firsts, "root").where("doc_id > keep_id")
    return gone.select("doc_id", "text_key", "first", (F.col("first") + F.col("words") - 1).alias("last"), "start", "end", "keep_id")


def repeated_spans(docs: DataFrame, threshold: float = 0.8, recall: float = 0.95, min_words: int = 20, rows: int = 2) -> DataFrame:
    """(doc_id, start, end, words, keep_id): the spans of characters to remove, end exclusive, and the smallest id of the documents that keep their paragraphs."""
    t = Fraction(threshold).limit_denominator(1000)
    units = materialise(repeated_paragraphs(docs, tuned_bands(threshold, recall, rows), rows))
    spans = piece_spans(units.where("bands is null")).unionByName(line_spans(units.where("bands is not null"), t))
    by = Window.partitionBy("doc_id", "text_key").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isles = spans.withColumn("fresh", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int")).withColumn("isle", F.sum("fresh").over(by))
    whole = isles.groupBy("doc_id", "text_key", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("words"), F.min("keep_id").alias("keep_id"))
    return whole.where(F.col("words") >= min_words).select("doc_id", "start", "end", "words", "keep_id").distinct()
